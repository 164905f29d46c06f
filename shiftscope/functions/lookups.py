"""Literal lookups compiled into the plan.

Small fixed tables (schedules, currencies, city slugs) become literal
``map`` expressions: the lookup is evaluated inside whole-stage codegen,
with no join, no shuffle and no broadcast of a data-dependent size.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicon as lx


def literal_map(pairs) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs))


def lookup(pairs, key: Column) -> Column:
    """NULL for a missing or NULL key."""
    return F.when(key.isNotNull(), F.try_element_at(literal_map(pairs), key))


def schedule_shifts(key: Column, profile: str = "metrics") -> Column:
    return lookup([(s, float(n)) for s, n, _ in lx.SCHEDULE_PROFILES[profile]], key)


def schedule_hours(key: Column, profile: str = "metrics") -> Column:
    return lookup([(s, float(h)) for s, _, h in lx.SCHEDULE_PROFILES[profile] if h is not None], key)


SCHEDULE_DIM_SCHEMA = T.StructType([
    T.StructField("schedule", T.StringType(), False),
    T.StructField("shifts_per_month", T.DoubleType(), True),
    T.StructField("hours_per_shift", T.DoubleType(), True),
])


def schedule_dim(spark: SparkSession, profile: str = "board") -> DataFrame:
    """The built-in schedule table of one profile as a (tiny) DataFrame."""
    rows = [(s, float(n), None if h is None else float(h)) for s, n, h in lx.SCHEDULE_PROFILES[profile]]
    return spark.createDataFrame(rows, SCHEDULE_DIM_SCHEMA)


def currency_code(token: Column) -> Column:
    """Token -> ISO code; unknown tokens upper-cased; NULL/blank -> NULL."""
    t = F.lower(F.trim(token))
    return (F.when(F.coalesce(t, F.lit("")) == "", F.lit(None).cast("string"))
             .otherwise(F.coalesce(lookup(lx.CURRENCY_CODES, t), F.upper(F.trim(token)))))
