"""Streaming posting upsert (A14 as Structured Streaming) and first
sightings.

Sightings arrive as files; a stateful streaming aggregation keeps, per
posting, the last sighting, the last failed / flagged sighting orders and
the sighting count (the same single-pass formulation as the batch job, so
the state per key is a handful of values — never the key's rows).  Each
micro-batch's updated keys are appended to a changelog table in the
shared folder through ``foreachBatch``; the current state is the latest
changelog row per key.  The checkpoint makes the stream restartable after
executor or driver loss.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import shared_dir

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def event_sightings(df: DataFrame) -> DataFrame:
    """Events as sightings: user = posting, (ts, event_id) = order, an
    'error' is a failed fetch, 'purchase' / 'signup' are the two flags."""
    return df.select(
        F.col("user_id").alias("external_id"), F.struct("ts", "event_id").alias("seq"), "ts",
        (F.col("event_type") == "error").alias("failed"),
        (F.col("event_type") == "purchase").alias("is_promoted"),
        (F.col("event_type") == "signup").alias("is_featured"),
        "value", "event_type")


def state_aggregate(s: DataFrame) -> DataFrame:
    """Per key: last sighting, last failed / flagged orders, count."""
    return s.groupBy("external_id").agg(
        F.max_by(F.struct("failed", "value", "event_type"), F.col("seq")).alias("last"),
        F.max(F.when(F.col("failed"), F.col("seq"))).alias("lf"),
        F.max(F.when(~F.col("failed") & F.col("is_promoted"), F.col("seq"))).alias("lp"),
        F.max(F.when(~F.col("failed") & F.col("is_featured"), F.col("seq"))).alias("lx"),
        F.count(F.lit(1)).alias("n"))


def finish_state(g: DataFrame) -> DataFrame:
    def after_fail(c):
        return F.col(c).isNotNull() & (F.col("lf").isNull() | (F.col(c) > F.col("lf")))
    active = ~F.col("last.failed")
    return g.select(
        F.col("external_id").alias("user_id"), active.alias("is_active"),
        F.when(active, F.col("last.value")).alias("value"),
        F.when(active, F.col("last.event_type")).alias("event_type"),
        (active & after_fail("lp")).alias("is_promoted"), (active & after_fail("lx")).alias("is_featured"),
        (F.col("n") - 1).alias("repeats"))


def _source(spark: SparkSession, source: str, max_files: int | None) -> DataFrame:
    """Stream over a folder of part files, or over one single file."""
    r = spark.readStream.schema(EVENT_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return r.parquet(source)
    return r.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())


def run_state_stream(spark: SparkSession, source: str, run_dir: str, max_files_per_trigger: int | None = None) -> str:
    """Drain ``source`` (a folder or a file) with an availableNow trigger
    into the changelog; returns the changelog path."""
    changelog, ckpt = f"{run_dir}/changelog", f"{run_dir}/checkpoint"
    stream = _source(spark, source, max_files_per_trigger)
    updates = state_aggregate(event_sightings(stream))
    _drain(updates, changelog, ckpt)
    return changelog


def _drain(updates: DataFrame, changelog: str, ckpt: str) -> None:
    def sink(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(changelog)
    q = (updates.writeStream.outputMode("update").foreachBatch(sink)
                .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()


def current_state(spark: SparkSession, changelog: str) -> DataFrame:
    """Latest changelog row per key (a max_by over the epoch)."""
    log = spark.read.parquet(changelog)
    latest = log.groupBy("external_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "external_id"]),
                                                     F.col("epoch")).alias("r"))
    return finish_state(latest.select("external_id", "r.last", "r.lf", "r.lp", "r.lx", "r.n"))


def first_seen_aggregate(events: DataFrame) -> DataFrame:
    """First sighting of each (user, event type) by (ts, event_id): the
    result does not depend on how the files fall into micro-batches."""
    first = F.min_by(F.struct("event_id", "ts", "value", "props"), F.struct("ts", "event_id"))
    return events.groupBy("user_id", "event_type").agg(first.alias("first"))


def run_first_seen(spark: SparkSession, source: str, run_dir: str) -> str:
    """The same over a stream: every batch's updated keys go to a changelog."""
    changelog, ckpt = f"{run_dir}/first_seen", f"{run_dir}/checkpoint_fs"
    _drain(first_seen_aggregate(_source(spark, source, None)), changelog, ckpt)
    return changelog


def first_seen(spark: SparkSession, changelog: str) -> DataFrame:
    log = spark.read.parquet(changelog)
    return (log.groupBy("user_id", "event_type").agg(F.max_by("first", "epoch").alias("f"))
               .select("f.event_id", "f.ts", "user_id", "event_type", "f.value", "f.props"))


SEEN_WINDOW = "30 days"
SEEN_DELAY = "7 days"


def first_in_window(events: DataFrame, window: str = SEEN_WINDOW) -> DataFrame:
    """First sighting of each (user, event type) in every window of event
    time, by (ts, event_id).  Rows without a time belong to no window."""
    first = F.min_by(F.struct("event_id", "ts", "value", "props"), F.struct("ts", "event_id"))
    return events.where(F.col("ts").isNotNull()).groupBy(F.window("ts", window).alias("w"), "user_id", "event_type").agg(first.alias("first"))


def run_first_in_window(spark: SparkSession, source: str, run_dir: str, window: str = SEEN_WINDOW, delay: str = SEEN_DELAY,
                        max_files_per_trigger: int | None = None) -> str:
    """The same over a stream, in bounded state: a window's keys are let go
    once the watermark (latest event time seen, less ``delay``) has passed its
    end; rows for such a window come too late and change nothing."""
    changelog, ckpt = f"{run_dir}/first_window", f"{run_dir}/checkpoint_fw"
    _drain(first_in_window(_source(spark, source, max_files_per_trigger).withWatermark("ts", delay), window), changelog, ckpt)
    return changelog


def first_seen_window(spark: SparkSession, changelog: str) -> DataFrame:
    log = spark.read.parquet(changelog)
    return (log.groupBy("w", "user_id", "event_type").agg(F.max_by("first", "epoch").alias("f"))
               .select(F.col("w.start").alias("window_start"), "f.event_id", "f.ts", "user_id", "event_type", "f.value", "f.props"))


def new_run_dir(spark: SparkSession, name: str) -> str:
    return shared_dir(spark, "streams", name, uuid.uuid4().hex[:12])
