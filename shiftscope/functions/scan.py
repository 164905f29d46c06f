"""Parsers on Python strings, for row-wise jobs whose many short steps Spark
would interpret one by one (lambdas have no generated code): shift length
(T4), schedules (T5), script (T7).

The rules and patterns are those of ``operators.extract``; ``\\s`` and ``\\d``
are ASCII (``re.A``), as in Java.  :func:`parse_rows` runs a parser over the
rows of a task: no shuffle, and a bounded number of rows held at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .. import lexicon as lx
from ..operators import extract as X

#: rows held as Python objects at a time
PIECE = 2000

STEP = Decimal("0.01")
TO_BLANKS = str.maketrans(X.NBSP + "–—−", " ---")
BLANKS = re.compile(r"\s+", re.A)
UNEVEN = re.compile("[ –—−\t\n\x0b\f\r]|  ")

TIME_RANGE = re.compile(X.TIME_RANGE_RE, re.A)
TIME_RANGE_HINT = re.compile(r"[0-9]\s*(?:до|по|[-—–])", re.A)
HOURS = re.compile(X.HOURS_RE, re.A)
HOURS_HINT = re.compile(r"[0-9]\s*[-‑]?\s*ч", re.A)

GAP = X.GAP
SEP = X.SCHED_SEP.replace(r"\s", GAP)
NUMBER = "([1-9][0-9]?)"
PAIR_HINT = re.compile(f"[0-9]{SEP}[1-9]", re.A)
PAIR = re.compile(X.E0 + NUMBER + SEP + NUMBER + X.E1, re.A)
WORDS_THROUGH = re.compile(f"{X.E0}({X.NUM_WORDS}){GAP}+через{GAP}+({X.NUM_WORDS}){X.E1}", re.A)
NUMBERS_THROUGH = re.compile(f"{X.E0}{NUMBER}{GAP}+через{GAP}+{NUMBER}{X.E1}", re.A)
ROTATION = re.compile(f"{X.E0}вахт[{X.WORD_CLASS}]*{GAP}*{NUMBER}{SEP}{NUMBER}{X.E1}", re.A)
WORD_NUMBERS = {w: str(n) for w, n in lx.SCHEDULE_NUMBER_WORDS}
PHRASES = [(re.match("[а-я]+", p).group(), re.compile(p.replace(r"\w", f"[{X.WORD_CLASS}]").replace(r"\s", GAP), re.A), value)
           for p, value in lx.SCHEDULE_PHRASES]

UKRAINIAN, RUSSIAN, LATIN = (re.compile(c) for c in ("[ієїґ]", "[а-яё]", "[a-z]"))


def round_even(x: float) -> float:
    """To two digits, half to even, by the decimal form (Spark's ``bround``)."""
    return x if x.is_integer() else float(Decimal(repr(x)).quantize(STEP, ROUND_HALF_EVEN))


def script_lang(low: str) -> str | None:
    return "uk" if UKRAINIAN.search(low) else "ru" if RUSSIAN.search(low) else "en" if LATIN.search(low) else None


def schedule_text(text: str | None) -> str:
    return ((text or "") + " ").lower().replace("–", "-").replace("х", "x")


def schedule_list(t: str) -> str | None:
    """``extract.schedule_list`` of a text in its normal form (:func:`schedule_text`)."""
    found = [f"{m[1]}/{m[2]}" for m in PAIR.finditer(t)] if PAIR_HINT.search(t) else []
    if "через" in t:
        found += [f"{WORD_NUMBERS[m[1]]}/{WORD_NUMBERS[m[2]]}" for m in WORDS_THROUGH.finditer(t)]
        found += [f"{m[1]}/{m[2]}" for m in NUMBERS_THROUGH.finditer(t)]
    if "вахт" in t:
        found += [f"{m[1]}/{m[2]}" for m in ROTATION.finditer(t)]
    found += [value for first, phrase, value in PHRASES if first in t and phrase.search(t)]
    return ", ".join(dict.fromkeys(found)) if found else None


def shift_norm(text: str | None) -> str:
    low = (text or "").lower().replace("ч.", "ч").replace("час.", "час")
    if UNEVEN.search(low):
        low = BLANKS.sub(" ", low.translate(TO_BLANKS))
    return low.strip(" ")


def shift_length(t: str) -> tuple[float | None, str, bool]:
    """(hours, confidence, ambiguous): ``extract.shift_length`` of a normalised
    text (:func:`shift_norm`)."""
    best, best_by, all_hours = None, None, set()

    def offer(weight, hours, confidence):
        nonlocal best, best_by
        all_hours.add(round_even(hours))
        if best is None or (weight, hours) > best_by:
            best, best_by = (hours, confidence), (weight, hours)

    if TIME_RANGE_HINT.search(t):
        for m in TIME_RANGE.finditer(t):
            raw = m[0].strip(" ")
            if (":" in raw or raw.startswith("с ")) and not any(w in t[m.end():m.end() + 6] for w in lx.SHIFT_TAIL_STOP):
                start, end = int(m[1]), int(m[3])
                lasts = (end + int(m[4] or 0) / 60.0) - (start + int(m[2] or 0) / 60.0)
                lasts = lasts + 24.0 if lasts <= 0 else lasts
                if start <= 23 and end <= 23 and 0.5 <= lasts <= 24.0:
                    offer(3.0, round_even(lasts), "high")
    if HOURS_HINT.search(t):
        for m in HOURS.finditer(t):
            hours = float(m[1].replace(",", "."))
            if 1 <= hours <= 24 and not any(w in t[m.end():m.end() + 6] for w in lx.SHIFT_TAIL_STOP):
                near = t[max(m.start() - 25, 0):m.end() + 25]
                weight = ((-3.0 if any(w in near for w in lx.SHIFT_BAD_WORDS) else 0.0)
                          + (3.0 if any(w in near for w in lx.SHIFT_GOOD_WORDS) else 0.0)
                          + (1.5 if "смен" in near else 0.0) + (1.0 if "рабоч" in near or "граф" in near else 0.0) + hours / 50.0)
                offer(weight, hours, "high" if "смен" in near or "граф" in near else "medium")
    if best is None or best_by[0] <= -1.0:
        return None, "low", False
    ambiguous = len(all_hours) > 1
    return best[0], "medium" if ambiguous else best[1], ambiguous


def strings(column: pa.Array) -> list[str | None]:
    """A column's texts; bytes that are no UTF-8 are replaced, as the JVM does."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def parse_rows(df: DataFrame, drop: list[str], parsed: StructType, parse: Callable[[pa.RecordBatch], list[list]]) -> DataFrame:
    """``df`` without the columns ``drop``, then the columns ``parsed``, of
    which ``parse`` gives the values for a piece of rows, a list a column."""
    from pyspark.sql.pandas.types import to_arrow_schema
    rest = [c for c in df.columns if c not in drop]
    at = [df.columns.index(c) for c in rest]
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, PIECE):
                piece = b.slice(start, PIECE)
                found = [pa.array(values, f.type) for values, f in zip(parse(piece), arrow)]
                yield pa.RecordBatch.from_arrays([*[piece.column(i) for i in at], *found], names=[*rest, *arrow.names])

    return df.mapInArrow(run, StructType([*[df.schema[c] for c in rest], *parsed]))
