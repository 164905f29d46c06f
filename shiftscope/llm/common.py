"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, read_table, shared_folder, ship_package  # noqa: F401

#: White space and words as every operator here understands them (the six
#: ASCII white-space characters; nothing else separates words).
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_RE = rf"[^{SPACE_CLASS}]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_of(c: Column) -> Column:
    """NULL text is the empty text."""
    return F.coalesce(c, F.lit(""))


def word_array(c: Column) -> Column:
    """Words of a text, in order (NULL: none)."""
    return F.array_remove(F.split(text_of(c), rf"[{SPACE_CLASS}]+"), "")


def word_count(c: Column) -> Column:
    return F.regexp_count(text_of(c), F.lit(WORD_RE)).cast("long")


def blob_id(c: Column) -> Column:
    """Content address of a text: SHA-256 of its UTF-8 bytes, bare lower-case hex."""
    return F.sha2(text_of(c).cast("binary"), 256)


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a side measured to hold at most ``rows`` rows;
    beyond that the side is left to a shuffled join (AQE splits skew).

    ``df`` should be cheap to read (a checkpoint or a written table)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
