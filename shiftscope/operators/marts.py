"""Summary tables.

Every mart is one aggregation with map-side partial aggregation, so a
hot key (one title or city holding a third of all rows) is combined per
input partition before the shuffle; only per-partition partial buffers
cross the network.  Exact medians use ``median`` (exact, interpolated;
its buffer holds value counts, and measures here are rounded to 0.1, so
the distinct values per group stay small).  Top-k reports end in
``orderBy(...).limit(k)``, planned as TakeOrderedAndProject: each task
keeps k rows, the driver merges k x tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as lx

MEASURES = [("salary_from_k", "from"), ("salary_to_k", "to"), ("hourly", "hourly")]


# -- A1 -------------------------------------------------------------------
def exact_mean(c: Column) -> Column:
    """Mean whose value does not depend on the order rows are summed in:
    an exact decimal sum, then one division.  (A floating sum changes with
    partitioning, which can flip a value sitting on a rounding edge.)"""
    n = F.count(c)
    return F.when(n > 0, F.sum(c.cast("decimal(38,6)")).cast("double") / n)


def job_stats(df: DataFrame, title="title", measures=MEASURES) -> DataFrame:
    """Per-title count + min/median/mean/max of each measure (0.1).

    NULL titles are dropped; '' is shown as '(не указано)'.  Ordered by
    count desc, title asc."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for col, p in measures:
        c = F.col(col)
        aggs += [F.bround(F.min(c), 1).alias(f"{p}_min"),
                 F.bround(F.median(c), 1).alias(f"{p}_median"),
                 F.bround(exact_mean(c), 1).alias(f"{p}_mean"),
                 F.bround(F.max(c), 1).alias(f"{p}_max")]
    out = (df.where(F.col(title).isNotNull())
             .groupBy(F.col(title).alias("title_key"))
             .agg(*aggs))
    label = F.when(F.col("title_key") == "", F.lit(lx.UNKNOWN_LABEL)).otherwise(F.col("title_key"))
    cols = [c for c in out.columns if c != "title_key"]
    return out.select(label.alias("title"), *cols).orderBy(F.desc("n"), "title")


# -- A2 / A9 / A11 ---------------------------------------------------------
def top_values(df: DataFrame, key: Column, k: int, name: str = "value",
               total: bool = False) -> DataFrame:
    """Count per value, count desc then value asc, first k (NULLs dropped)."""
    out = df.select(key.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(
        F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), F.asc(name)).limit(k)


def top_cities(df: DataFrame, city="city", k: int = 10) -> DataFrame:
    """Top cities; NULL city counts as '(не указано)'."""
    return top_values(df, F.coalesce(F.col(city), F.lit(lx.UNKNOWN_LABEL)), k, "city")


def host_top(df: DataFrame, url="url", k: int = 5) -> DataFrame:
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"https?://([^/]+)/", 1)
    return top_values(df, F.when(host != "", host), k, "host")


def value_freq(df: DataFrame, col: str, k: int = 6) -> DataFrame:
    """Top-k values of a column with their share of *all* rows (%)."""
    counts = df.groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # rows are read once: the total rides along as one more row, first in order
    total = F.col("value").isNull()
    rows = counts.rollup("value").agg(F.sum("n").alias("n"), F.grouping("value").alias("all")).where((F.col("all") == 1) | ~total)
    top = rows.orderBy(F.desc("all"), F.desc("n"), "value").limit(k + 1)
    n_all = F.max(F.when(F.col("all") == 1, F.col("n"))).over(Window.partitionBy())
    return top.select("value", "n", (F.col("n") * 100.0 / n_all).alias("pct"), "all").where("all = 0").drop("all")


# -- A3 -------------------------------------------------------------------
def split_benefit_items(cell: Column) -> Column:
    """Split on ';', strip ' ;,•-'; an item with ',' splits again (when
    that yields more than one piece)."""
    parts = F.transform(F.split(cell, ";"), lambda p: F.btrim(p, F.lit(" ;,•-")))
    parts = F.filter(parts, lambda p: p != "")
    nested = F.transform(parts, lambda p: F.when(
        F.size(F.filter(F.transform(F.split(p, ","), lambda s: F.trim(s)), lambda s: s != "")) > 1,
        F.filter(F.transform(F.split(p, ","), lambda s: F.trim(s)), lambda s: s != ""),
    ).otherwise(F.array(p)))
    return F.flatten(nested)


def top_benefits(df: DataFrame, col="benefits", k: int = 15) -> DataFrame:
    items = df.select(F.explode(split_benefit_items(F.col(col))).alias("benefit"))
    return (items.groupBy("benefit").agg(F.count(F.lit(1)).alias("n"))
                 .orderBy(F.desc("n"), "benefit").limit(k))


# -- A4 -------------------------------------------------------------------
def share(df: DataFrame, key: Column) -> DataFrame:
    """Category share in % (0.1); NULL counts as '(не указано)'.  The total is
    the sum of the (few) counts; the rows are read once."""
    cats = df.select(F.coalesce(key, F.lit(lx.UNKNOWN_LABEL)).alias("category"))
    counts = cats.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over one row a category
    return counts.select("category", F.bround(F.col("n") * 100.0 / total, 1).alias("share_pct"))


# -- A5 -------------------------------------------------------------------
def pub_hist(df: DataFrame, date_col="posted_date") -> DataFrame:
    d = F.col(date_col)
    if dict(df.dtypes).get(date_col) == "string":
        d = F.try_to_date(d)
    return (df.select(d.alias("day")).where(F.col("day").isNotNull())
              .groupBy("day").agg(F.count(F.lit(1)).alias("n")).orderBy("day"))


# -- A6 / A10 --------------------------------------------------------------
def hourly_share(df: DataFrame, hourly="hourly") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"),
                  (F.avg(F.when(F.col(hourly).isNotNull(), 1.0).otherwise(0.0)) * 100.0).alias("hourly_share_pct"))


def coverage(df: DataFrame, salary_from="salary_from", salary_to="salary_to",
             hours="hours_text", failed=None) -> DataFrame:
    """% of records with a salary, with working hours, and failure count."""
    def truthy(c):
        return c.isNotNull() & (c != 0)
    has_sal = truthy(F.col(salary_from)) | truthy(F.col(salary_to))
    has_h = F.col(hours).isNotNull() & (F.col(hours) != "")
    aggs = [F.count(F.lit(1)).alias("records"),
            (F.count_if(has_sal) * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("salary_pct"),
            (F.count_if(has_h) * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("hours_pct")]
    if failed is not None:
        aggs.append(F.count_if(F.col(failed)).alias("failures"))
    return df.agg(*aggs)


# -- A7 -------------------------------------------------------------------
def pay_summary(df: DataFrame, hourly="hourly", from_k="salary_from_k", to_k="salary_to_k") -> DataFrame:
    """n, hourly median/min/max within (50, 100000), monthly (k) median/min/
    max within (10, 10000); monthly = midpoint, else the known end."""
    def pos(c):
        return F.when(F.col(c) > 0, F.col(c))
    h, f, t = pos(hourly), pos(from_k), pos(to_k)
    lo, hi = lx.HOURLY_BOUNDS
    hh = F.when((h > lo) & (h < hi), h)
    m = F.coalesce(F.when(f.isNotNull() & t.isNotNull(), (f + t) / 2.0), f, t)
    mlo, mhi = lx.MONTHLY_K_BOUNDS
    mm = F.when((m > mlo) & (m < mhi), m)
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.median(hh).alias("hourly_median"), F.min(hh).alias("hourly_min"),
                  F.max(hh).alias("hourly_max"),
                  F.median(mm).alias("monthly_median"), F.min(mm).alias("monthly_min"),
                  F.max(mm).alias("monthly_max"))


# -- A8 -------------------------------------------------------------------
def token_freq(df: DataFrame, col: str, k: int = 8) -> DataFrame:
    """lower, squeeze spaces, split on ; or , , trim, drop blanks; top k with
    the share of all rows (%)."""
    norm = F.regexp_replace(F.lower(F.coalesce(F.col(col), F.lit(""))), r"\s+", " ")
    toks = F.filter(F.transform(F.split(norm, "[;,]"), lambda t: F.trim(t)), lambda t: t != "")
    # a NULL entry stands for the row itself: rows and tokens in one aggregation
    entries = df.select(F.explode(F.concat(toks, F.array(F.lit(None).cast("string")))).alias("token"))
    counts = entries.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    n_all = F.max(F.when(F.col("token").isNull(), F.col("n"))).over(Window.partitionBy())
    # the row count leads the ranking, so the top k + 1 hold it and the top k tokens
    top = counts.orderBy(F.col("token").isNotNull(), F.desc("n"), "token").limit(k + 1)
    return top.select("token", "n", (F.col("n") * 100.0 / n_all).alias("pct")).where(F.col("token").isNotNull())


# -- A12 ------------------------------------------------------------------
def source_counts(df: DataFrame, source="source") -> DataFrame:
    """Rows per source plus the total (source NULL) via ROLLUP."""
    return df.rollup(source).agg(F.count(F.lit(1)).alias("n"))


# -- O1 -------------------------------------------------------------------
def mid_salary(from_k: Column, to_k: Column) -> Column:
    return F.coalesce(F.when(from_k.isNotNull() & to_k.isNotNull(), (from_k + to_k) / 2.0), from_k, to_k)


def top_hourly(df: DataFrame, k: int = 10, order_key="seq") -> DataFrame:
    """Top-k postings by hourly rate (NULLs dropped) with the mid salary."""
    return (df.where(F.col("hourly").isNotNull())
              .orderBy(F.desc("hourly"), F.asc(order_key)).limit(k)
              .select("posting_id", "title", "employer", "hourly",
                      mid_salary(F.col("salary_from_k"), F.col("salary_to_k")).alias("mid_salary_k"), "url"))
