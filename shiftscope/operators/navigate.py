"""Nested records to flat rows by a table of paths.

A table row names a column, the paths that may hold it (dotted, in order of
preference) and how an entry counts as missing; :func:`flat` compiles the table
into one projection over the record's structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text

# how a value counts as there: as it is, as a non-blank text, as a non-zero number
RAW, TEXT, NUMBER = "raw", "text", "number"

#: board record -> flat record: (column, paths in order, kind)
BOARD_PATHS: list[tuple[str, list[str], str]] = [
    ("external_id", ["external_id"], RAW),
    ("title", ["title"], TEXT),
    ("employer_name", ["employer_name"], RAW),
    ("published", ["posted_date", "posted_at_raw"], RAW),
    ("salary_from", ["salary_from"], RAW),
    ("salary_to", ["salary_to"], RAW),
    ("salary_currency", ["salary_currency"], RAW),
    ("salary_period", ["salary_period"], RAW),
    ("shift_length_hours", ["working_hours.normalized.shift_based.shift_length_hours",
                            "working_hours.normalized.shift_based.shift_length"], NUMBER),
    ("schedule_hint", ["schedule_hint"], TEXT),
    ("shift_pattern", ["working_hours.normalized.shift_based.pattern"], RAW),
    ("experience", ["experience_required.normalized", "experience_required.raw"], TEXT),
    ("employment_type", ["employment_type"], RAW),
    ("benefits", ["benefits"], RAW),
    ("duties_raw", ["duties_raw"], RAW),
    ("url_detail", ["url_detail", "url_listing"], TEXT),
    ("region", ["location_area", "region"], TEXT),
]


def _there(c: Column, kind: str) -> Column:
    if kind == TEXT:
        return F.nullif(c, F.lit(""))
    if kind == NUMBER:
        return F.nullif(c.cast("double"), F.lit(0.0))
    return c


def first_of(paths: list[str], kind: str) -> Column:
    """The first path that holds something, else NULL."""
    return F.coalesce(*[_there(F.col(p), kind) for p in paths])


def flat(records: DataFrame, table: list[tuple[str, list[str], str]] = BOARD_PATHS) -> DataFrame:
    return records.select(*[first_of(paths, kind).alias(name) for name, paths, kind in table])


def pick_region(region: Column, config_region: str | None, config_city: str) -> Column:
    """The record's area or region, cleaned; without one, the configured
    region, else the configured city."""
    return F.coalesce(F.nullif(clean_text(region), F.lit("")), F.lit(config_region or config_city))
