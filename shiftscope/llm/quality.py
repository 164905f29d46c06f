"""Quality rules: a threshold table compiled into one Spark projection.

Every rule is a row ``(name, metric, low, high, min_words)``: a text passes
when ``low <= metric <= high`` (an open bound is None); texts of fewer than
``min_words`` words are not held to the rule.  Metrics are native column
expressions over the whole text; no user function runs, no row is shuffled.

Defined results: NULL and empty texts have no words, all counts 0 and fail
(fewer than ten words).  Repeated rows are judged each on its own.  Extra
input columns pass through :func:`apply_rules` untouched; metric columns
live in one struct named by the caller, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import SPACE_CLASS, WORD_RE, text_of

# fixed values: frequent function words of the corpus languages (en de fr es)
STOP_WORDS = (
    "the of and to in is that was for it with as on be at by this an are from a "
    "der die das und den von ist mit ein eine sich nicht zu auf für im dem des "
    "la el los las que en un una por con para se del al es de no "
    "le les et est une pour dans qui au du ou par sur"
).split()

# A stop word counts as written in lower case, capitalised or in capitals.
STOP_FORMS = sorted({f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())})

#: (rule, metric, low, high, applies from so many words)
RULES: list[tuple[str, str, float | None, float | None, int]] = [
    ("word_length", "mean_word_length", 2.5, 12.0, 10),
    ("symbols", "symbol_ratio", None, 0.1, 10),
    ("capitals", "capital_ratio", None, 0.3, 10),
    ("exclamations", "exclamation_ratio", None, 0.1, 10),
    ("stop_words", "stop_word_ratio", 0.02, None, 50),
    ("word_runs", "word_run_ratio", None, 0.2, 10),
    ("duplicate_lines", "duplicate_line_ratio", None, 0.6, 10),
    ("bullet_lines", "bullet_line_ratio", None, 0.9, 50),
    ("ellipsis_lines", "ellipsis_line_ratio", None, 0.5, 50),
]

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def repeated_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words lying in a window of ``width`` words that occurs twice or more.

    ``hashes``: 64-bit hashes of the words; windows are compared by a hash of those.  Texts
    without a repeated window (a primitive distinct count tells) skip the
    position work.  All steps are linear or n log n in the text's length."""
    n = F.size(hashes)
    wins = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(F.slice(hashes, i, width)))

    def covered(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), from_sorted))

    def from_sorted(s: Column) -> Column:
        hits = F.filter(s, lambda e, j: (F.get(s, j - 1)["x"] == e["x"]) | (F.get(s, j + 1)["x"] == e["x"]))
        return let(F.sort_array(F.transform(hits, lambda e: e["i"])), span_total)

    def span_total(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return F.when(n < width, F.lit(0)).otherwise(let(wins, covered))


def with_metrics(df: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """Add one struct column ``out`` with all base counts, metrics, the base
    verdict, the names of the failed rules and ``kept``."""
    t = text_of(F.col(f"`{text}`"))
    keep = [F.col(f"`{c}`") for c in df.columns]
    has_word = lambda line: line.rlike(f"[^{SPACE_CLASS}]")
    s = df.select(
        *keep,
        F.array_remove(F.split(t, rf"[{SPACE_CLASS}]+"), "").alias("__words"),
        F.filter(F.split(t, "\n"), has_word).alias("__lines"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("__symbols"),
        F.length(F.regexp_replace(t, r"[^A-Z]+", "")).alias("__caps"),
        (F.length(t) - F.length(F.replace(t, F.lit("!!"), F.lit("!")))).alias("__excl"))
    w, lines = F.col("__words"), F.col("__lines")
    s = s.select(*keep, "__symbols", "__caps", "__excl", "__words", "__lines",
                 F.transform(w, lambda x: F.xxhash64(x)).alias("__hashes"))
    h = F.col("__hashes")
    s = s.select(
        *keep, "__symbols", "__caps", "__excl",
        F.size(w).cast("long").alias("__n"),
        F.length(F.array_join(w, "")).cast("long").alias("__chars"),
        F.size(lines).cast("long").alias("__n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("__dup_lines"),
        repeated_words(h).cast("long").alias("__repeats"),
        F.size(F.filter(w, lambda x: x.isin(*STOP_FORMS))).alias("__stops"),
        F.size(F.filter(h, lambda x, i: x == F.get(h, i - 1))).alias("__runs"),
        F.size(F.filter(lines, lambda x: x.rlike(rf"^[{SPACE_CLASS}]*[-•*]"))).alias("__bullets"),
        F.size(F.filter(lines, lambda x: x.rlike(rf"(\.\.\.|…)[{SPACE_CLASS}]*$"))).alias("__dots"))
    n, nl = F.col("__n"), F.col("__n_lines")
    metrics = {
        "mean_word_length": _ratio(F.col("__chars"), n),
        "symbol_ratio": _ratio(F.col("__symbols"), n),
        "capital_ratio": _ratio(F.col("__caps"), F.col("__chars")),
        "exclamation_ratio": _ratio(F.col("__excl"), n),
        "stop_word_ratio": _ratio(F.col("__stops"), n),
        "word_run_ratio": _ratio(F.col("__runs"), n),
        "duplicate_line_ratio": _ratio(F.col("__dup_lines"), nl),
        "bullet_line_ratio": _ratio(F.col("__bullets"), nl),
        "ellipsis_line_ratio": _ratio(F.col("__dots"), nl),
    }
    base_failed = (n < MIN_WORDS) | (100 * F.col("__repeats") > MAX_REPEAT_PERCENT * n)
    s = s.select(*keep, F.struct(
        n.alias("n_words"), F.col("__chars").alias("word_chars"), F.col("__symbols").alias("n_symbols"),
        F.col("__dup_lines").alias("n_dup_lines"), F.col("__repeats").alias("n_repeat_words"),
        base_failed.alias("base_failed"), *[m.alias(k) for k, m in metrics.items()]).alias("__q"))
    q = F.col("__q")
    failed = F.array_compact(F.array(*[
        F.when((q["n_words"] >= least) & ~_within(q[metric], lo, hi), F.lit(rule))
        for rule, metric, lo, hi, least in RULES]))
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *metrics]
    return s.select(*keep, F.struct(
        *[q[f].alias(f) for f in fields], failed.alias("failed_rules"),
        (~q["base_failed"] & (F.size(failed) == 0)).alias("kept")).alias(out))


def _within(c: Column, lo: float | None, hi: float | None) -> Column:
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (c >= lo)
    if hi is not None:
        ok = ok & (c <= hi)
    return ok


def apply_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``df`` (all its columns) whose text passes every rule."""
    name, wall = "__quality_verdict", "__quality_part"
    # the partition number is not deterministic to the optimizer: the filter
    # stays above the projection instead of being pushed down with every
    # metric written out again for each time the verdict uses it
    judged = with_metrics(df, text, name).withColumn(wall, F.spark_partition_id())
    return judged.filter(F.col(name)["kept"] & (F.col(wall) >= 0)).select(*[F.col(f"`{c}`") for c in df.columns])


def op3_quality(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, base verdict, verdict, failed rules."""
    q = F.col("q")
    return with_metrics(docs.select("doc_id", "text"), "text", "q").select(
        "doc_id", *[q[f].alias(f) for f in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
        F.array_join(q["failed_rules"], ",").alias("failed_rules"))


def oracle_sql() -> str:
    """The same result in DuckDB SQL, from the same threshold table."""
    ws = SPACE_CLASS
    stops = ", ".join(f"'{w}'" for w in STOP_FORMS)
    metric = {
        "mean_word_length": "word_chars / nz", "symbol_ratio": "n_symbols / nz", "capital_ratio": "caps / nullif(word_chars, 0)",
        "exclamation_ratio": "excl / nz", "stop_word_ratio": "stops / nz", "word_run_ratio": "runs / nz",
        "duplicate_line_ratio": "n_dup_lines / nl", "bullet_line_ratio": "bullets / nl",
        "ellipsis_line_ratio": "dots / nl"}
    cases = []
    for rule, m, lo, hi, least in RULES:
        bad = [f"coalesce({metric[m]}, 0) < {lo}"] * (lo is not None) + [f"coalesce({metric[m]}, 0) > {hi}"] * (hi is not None)
        cases.append(f"CASE WHEN n_words >= {least} AND ({' OR '.join(bad)}) THEN '{rule}' END")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w0 AS (SELECT r, unnest(regexp_extract_all(text, '{WORD_RE}')) AS w, generate_subscripts(regexp_extract_all(text, '{WORD_RE}'), 1) AS i FROM d),
w AS (SELECT *, lag(w) OVER (PARTITION BY r ORDER BY i) AS before,
  CASE WHEN lead(w, 4) OVER o IS NOT NULL THEN w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o END AS win
  FROM w0 WINDOW o AS (PARTITION BY r ORDER BY i)),
wa AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (w IN ({stops})) AS stops,
  count(*) FILTER (w = before) AS runs FROM w GROUP BY r),
hits AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM w WHERE win IS NOT NULL) WHERE c > 1),
rep AS (SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM hits) GROUP BY r),
l0 AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
la AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
  count(*) FILTER (regexp_matches(line, '^[{ws}]*[-•*]')) AS bullets,
  count(*) FILTER (regexp_matches(line, '(\\.\\.\\.|…)[{ws}]*$')) AS dots
  FROM l0 WHERE regexp_matches(line, '[^{ws}]') GROUP BY r),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS caps,
  length(text) - length(replace(text, '!!', '!')) AS excl,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  nullif(coalesce(n_words, 0), 0)::DOUBLE AS nz, nullif(coalesce(n_lines, 0), 0)::DOUBLE AS nl,
  stops, runs, bullets, dots
  FROM d LEFT JOIN wa USING (r) LEFT JOIN rep USING (r) LEFT JOIN la USING (r)),
v AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  concat_ws(',', {', '.join(cases)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND failed_rules = '') AS kept, failed_rules FROM v"""
