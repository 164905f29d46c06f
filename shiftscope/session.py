"""Spark session helpers shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Board timestamps are handled as zone-free local times (TIMESTAMP_NTZ);
# the session zone only matters for zone-aware columns.
SESSION_TZ = "UTC"


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "shiftscope") -> SparkSession:
    """Local/test session. On a cluster the submitter's settings win:
    ``getOrCreate`` returns the existing session untouched except for
    the conf keys set below, which are all safe at any scale."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", SESSION_TZ)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "16g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names it; only when it is unset (local tests) do we create
    one of our own."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        # one process only: the executors of "local-cluster[...]" are processes of their own
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="shiftscope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never localCheckpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def compile_wide_rows(spark: SparkSession) -> None:
    """The JVM does not compile methods of more than 8,000 bytes, and one
    generated method holds a whole wide projection: have Spark split such a
    projection instead.  A limit that the submitter set stays."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":
        spark.conf.set(key, "8000")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A folder name of its own under the shared checkpoint folder, so that
    no two builds of a query ever write to the same place."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per
    application: functions of ``mapInPandas`` are pickled by reference, so
    workers started outside the repository must be able to import it."""
    sc = spark.sparkContext
    if getattr(sc, "_shiftscope_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="shiftscope-ship-"), "shiftscope.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("shiftscope", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._shiftscope_shipped = True


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))
