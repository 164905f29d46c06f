"""Relational core: union, URL canonicalisation, dedup, anti-join, joins,
completeness merge and posting upsert (U1, P5, P7, P9, W1, J1–J6, A13–A15, O2).

Keep-first / keep-last / best-row per key are written as aggregations
(``min_by`` / ``max_by`` over an explicit ``seq``), not as windows: the
aggregate runs a map-side partial step, so a key that holds a third of
all rows is reduced inside every input partition before the shuffle and
no single task ever receives that key's raw rows.  Rows whose key is
NULL bypass the shuffle entirely where the semantics keep them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.lookups import SCHEDULE_DIM_SCHEMA


# -- P5 / P6 / P7 / P9 ------------------------------------------------------
def url_canon(u: Column) -> Column:
    """Scheme lower-cased (default https), leading 'www.'s dropped, the
    board host (incl. its m. mirror) forced to 'www.avito.ru', other hosts
    kept as written; query and fragment dropped.  NULL/'' pass through."""
    t = F.trim(u)
    scheme = F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    netloc = F.regexp_extract(t, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    path = F.regexp_extract(t, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)
    host = F.regexp_replace(F.lower(netloc), r"^(?:www\.)+", "")
    host = F.when(host.startswith("m.avito.ru"), F.lit("avito.ru")).otherwise(host)
    out_host = F.when(host.endswith("avito.ru"), F.lit("www.avito.ru")).otherwise(netloc)
    out = F.concat(F.when(scheme == "", F.lit("https")).otherwise(scheme), F.lit("://"), out_host, path)
    return F.when(u.isNull() | (u == ""), u).otherwise(out)


def mobile_url(u: Column) -> Column:
    """https + 'm.' host (www. removed) + path only."""
    host = F.replace(F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), F.lit("www."), F.lit(""))
    host = F.when(host.startswith("m."), host).otherwise(F.concat(F.lit("m."), host))
    path = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)
    return F.concat(F.lit("https://"), host, path)


def external_id(u: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(u, F.lit("")), lx.EXTERNAL_ID_RE, 1), F.lit("")).try_cast("long")


def is_item_url(u: Column) -> Column:
    return F.lower(F.trim(F.coalesce(u, F.lit("")))).rlike(lx.ITEM_URL_RE)


def export_url(u: Column) -> Column:
    """Export clean-up: collapse repeated 'www.', drop the query, board host
    variants -> 'https://www.avito.ru'."""
    t = F.regexp_replace(u, r"^https?://(?:www\.){2,}", "https://www.")
    t = F.regexp_replace(t, r"\?.*$", "")
    t = F.regexp_replace(t, r"^https?://avito\.ru", "https://www.avito.ru")
    return F.regexp_replace(t, r"^https?://m\.avito\.ru", "https://www.avito.ru")


# -- U1 ---------------------------------------------------------------------
def union_sources(*frames: DataFrame) -> DataFrame:
    """Union by name (missing columns NULL), tagging each row with the rank
    of its source so order-dependent steps stay deterministic."""
    out = None
    for rank, df in enumerate(frames):
        d = df.withColumn("source_rank", F.lit(rank))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


# -- W1 ---------------------------------------------------------------------
def keep_first(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """First row (smallest ``seq``) per key; NULL keys compare equal."""
    cols = [c for c in df.columns]
    best = F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(seq)).alias("_r")
    return df.groupBy(*keys).agg(best).select("_r.*")


def dedup_first(df: DataFrame, url: str = "url", title: str = "title", employer: str = "employer",
                seq: str = "seq") -> DataFrame:
    """Keep-first by (canonical) URL, then by (title, employer).

    Rows without a URL are all kept by the URL pass: their group key is
    (NULL, seq), unique per row, so they neither collapse into one group
    nor pile up in one shuffle partition — and the input is read once.
    In the second pass NULL employers compare equal."""
    key = F.struct(F.col(url).alias("u"), F.when(F.col(url).isNull(), F.col(seq)).alias("s"))
    cols = df.columns
    first = (df.groupBy(key.alias("_key"))
               .agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(seq)).alias("_r")).select("_r.*"))
    return keep_first(first, [title, employer], seq)


# -- J2 ---------------------------------------------------------------------
def drop_shift_rated(df: DataFrame, rates: DataFrame, url: str = "url") -> DataFrame:
    """Postings minus URLs that have a shift rate; NULL/blank URLs stay."""
    shift_urls = (rates.where(F.lower(F.col("type")) == "shift")
                       .select(F.trim(F.col("url")).alias("_u")).where(F.col("_u") != "").distinct())
    # rows without a URL always stay: they get a surrogate key that can
    # never match a URL and comes from the row's content, so they spread over
    # the shuffle, and a task that runs again sends them to the same place
    u = F.trim(F.col(url))
    surrogate = F.concat(F.lit("\u0000"), F.xxhash64(*[F.col(c) for c in df.columns]).cast("string"))
    keyed = df.withColumn("_u", F.when(u.isNull() | (u == ""), surrogate).otherwise(u))
    return keyed.join(shift_urls, "_u", "left_anti").drop("_u")


# -- J3 / S14 -----------------------------------------------------------------
def read_schedule_overrides(spark: SparkSession, path: str, key: str = "graph_schedule_defaults") -> DataFrame:
    """Overrides from a JSON configuration: the object under ``key``, or the
    whole file where it has none, ``{schedule: {hours_per_shift, shifts_per_month}}``.
    Entries that are no objects are ignored; amounts that are no numbers are NULL."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json(F.coalesce(F.get_json_object("value", f"$.{key}"), F.col("value")), "map<string,string>")
    e = text.select(F.explode(entries).alias("schedule", "o")).where(F.col("o").rlike(r"^\s*\{"))
    amount = lambda f: F.get_json_object("o", f"$.{f}").try_cast("double")
    return e.select("schedule", amount("shifts_per_month").alias("shifts_per_month"), amount("hours_per_shift").alias("hours_per_shift"))


def schedule_config(spark: SparkSession, overrides: DataFrame | list[tuple[str, float | None, float | None]] | None = None,
                    profile: str = "board") -> DataFrame:
    """Built-in schedule table merged with (schedule, shifts, hours)
    overrides: a missing or non-positive override falls back to the built-in
    value; entries with neither value positive are dropped."""
    base = spark.createDataFrame([(s, float(n), None if h is None else float(h))
                                  for s, n, h in lx.SCHEDULE_PROFILES[profile]], SCHEDULE_DIM_SCHEMA)
    if overrides is None:
        return base
    if not isinstance(overrides, DataFrame):
        overrides = spark.createDataFrame([(s, None if n is None else float(n), None if h is None else float(h))
                                           for s, n, h in overrides], SCHEDULE_DIM_SCHEMA)
    j = base.alias("b").join(overrides.alias("o"), "schedule", "full_outer")

    def pick(c):
        return F.when(F.col(f"o.{c}") > 0, F.col(f"o.{c}")).otherwise(F.coalesce(F.col(f"b.{c}"), F.lit(0.0)))
    out = j.select("schedule", pick("shifts_per_month").alias("shifts_per_month"),
                   pick("hours_per_shift").alias("hours_per_shift"))
    return out.where((F.col("shifts_per_month") > 0) | (F.col("hours_per_shift") > 0))


def schedule_lookup(df: DataFrame, dim: DataFrame, schedule: str = "schedule") -> DataFrame:
    """Left join with the schedule table.  How to join is left to Spark, which
    measures the table: a configuration may hold any number of entries."""
    d = dim.withColumnRenamed("schedule", "_dim_schedule")
    return df.join(d, df[schedule] == d["_dim_schedule"], "left").drop("_dim_schedule")


# -- J4 -----------------------------------------------------------------------
def prefill(df: DataFrame, url: str = "url", title: str = "title", blob: str = "full_text",
            seq: str = "seq") -> DataFrame:
    """Per URL: the first title and the last text blob seen."""
    return df.where(F.col(url).isNotNull()).groupBy(url).agg(
        F.min_by(F.col(title), F.col(seq)).alias("first_title"),
        F.max_by(F.col(blob), F.col(seq)).alias("last_blob"))


# -- A13 ----------------------------------------------------------------------
def filled_count(cols: list[str]) -> Column:
    return sum((F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0) for c in cols),
               F.lit(0))


def best_record(df: DataFrame, key: Column, data_cols: list[str], seq: str = "seq", columns: list[str] | None = None) -> DataFrame:
    """Per key keep the row with the most filled data columns; on a tie
    the later row (greater seq) wins.  Of the row only ``columns`` (all) are
    carried through the shuffle: the data columns are counted before it."""
    rank = F.struct(filled_count(data_cols).alias("f"), F.col(seq).alias("s"))
    row = F.struct(*[F.col(c) for c in columns or df.columns])
    return df.groupBy(key.alias("_k")).agg(F.max_by(row, rank).alias("_r")).select("_r.*")


# -- A14 ----------------------------------------------------------------------
def posting_state(sightings: DataFrame, id_col: str = "external_id", seq: str = "seq",
                  failed: str = "failed", promoted: str = "is_promoted", featured: str = "is_featured",
                  record_cols: list[str] | None = None, stub_cols: list[str] | None = None) -> DataFrame:
    """Current state per posting from its sightings.

    The last sighting wins; a failed last sighting leaves an inactive stub
    (of the record only ``stub_cols`` stay);
    promoted/featured are OR-ed over the successful sightings after the
    last failure.  One aggregation: 'any flag after the last failure' is
    'last flagged seq > last failed seq', so no per-key replay is needed."""
    rec, stub = record_cols or [], stub_cols or []
    last = F.max_by(F.struct(F.col(failed).alias("failed"), *[F.col(c) for c in [*stub, *rec]]), F.col(seq))
    g = sightings.groupBy(id_col).agg(
        last.alias("_last"),
        F.max(F.when(F.col(failed), F.col(seq))).alias("_lf"),
        F.max(F.when(~F.col(failed) & F.col(promoted), F.col(seq))).alias("_lp"),
        F.max(F.when(~F.col(failed) & F.col(featured), F.col(seq))).alias("_lx"),
        F.count(F.lit(1)).alias("sightings"))

    def after_fail(c):
        return F.col(c).isNotNull() & (F.col("_lf").isNull() | (F.col(c) > F.col("_lf")))
    active = ~F.col("_last.failed")
    return g.select(
        id_col,
        active.alias("is_active"),
        *[F.col(f"_last.{c}").alias(c) for c in stub],
        *[F.when(active, F.col(f"_last.{c}")).alias(c) for c in rec],
        (active & after_fail("_lp")).alias("is_promoted"),
        (active & after_fail("_lx")).alias("is_featured"),
        (F.col("sightings") - 1).alias("repeats"),
    )


# -- A15 ----------------------------------------------------------------------
def qa_sample(df: DataFrame, id_col: str, seq: str = "seq", k: int = 10) -> DataFrame:
    """Up to k distinct ids in first-seen order, each with its latest content."""
    cols = [c for c in df.columns if c not in (id_col, seq)]
    g = df.groupBy(id_col).agg(F.min(F.col(seq)).alias("_first"),
                               F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(seq)).alias("_r"))
    return g.orderBy("_first").limit(k).select(id_col, "_r.*")


# -- O2 -----------------------------------------------------------------------
def fill_to_n(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """Dedup the landed pages in one pass, then the first n rows by seq."""
    return dedup_first(df).orderBy(seq).limit(n)


# -- U2 -----------------------------------------------------------------------
def link_union(*link_sets: DataFrame, col: str = "link") -> DataFrame:
    out = None
    for d in link_sets:
        d = d.select(F.col(col))
        out = d if out is None else out.union(d)
    return out.distinct().orderBy(col)


# -- J6 -----------------------------------------------------------------------
def feed_grid(places: DataFrame, queries: list[str], categories: list[str] | None = None) -> DataFrame:
    """Every place x category x query feed (empty categories -> one NULL).

    The multiplier lists are job parameters (bounded config), expanded with
    ``explode`` of a literal array per place row — not a join of data."""
    cats = F.array(*[F.lit(c) for c in categories]) if categories else F.array(F.lit(None).cast("string"))
    return (places.withColumn("category", F.explode(cats))
                  .withColumn("query", F.explode(F.array(*[F.lit(q) for q in queries]))))
