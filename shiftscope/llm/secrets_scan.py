"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by its content (SHA-256).  The ledger,
a Parquet table in a shared folder, says which pairs of blob and rule
version were scanned and what was found.  A scan takes the distinct blobs
whose pair the ledger does not hold yet, scans only those, appends them, and
joins the findings back to every path (row) that holds the blob, so a later
run over more versions, or a run with the same rules, scans new blobs only;
another rule table has another version and scans all blobs again.

Text is shuffled once, already reduced to one copy per blob inside every
task; the join back moves identifiers only (AQE splits a hot blob).

Defined results: NULL text is the empty blob, without findings.  Repeated
rows keep their rows; a blob is scanned once.  Overlapping kinds are all
reported.  An empty table gives an empty result and adds nothing to the
ledger.  Extra columns pass through :func:`scan`; added ones start with
``scan_``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blob_id, shared_folder, text_of


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0       # what min_length is measured on
    min_length: int = 0
    base: bool = False


#: The base kinds, in the order of listing, then further ones.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, rule number, end) of all findings, in order; code points."""
    out = []
    for k, r in enumerate(rules):
        # a run of fewer than min_length characters cannot count: leave those of one class out at once
        pattern = re.sub(r"\+$", "{%d,}" % r.min_length, r.pattern) if r.kind == "hex" else r.pattern
        for m in re.finditer(pattern, text):
            if m.end(r.group) - m.start(r.group) >= r.min_length:
                out.append((m.start(), k, m.end()))
    out.sort()
    return out


def _spans(found: list[tuple[int, int, int]], rules: tuple[Rule, ...], base_only: bool) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in found if rules[k].base or not base_only)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, text`` -> ``blob, rule_version, spans, base_spans, counts``."""
    version = rule_version(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(b.schema.get_field_index("blob")), b.column(b.schema.get_field_index("text"))
            for lo in range(0, b.num_rows, 256):
                rows = []
                for i in range(lo, min(lo + 256, b.num_rows)):
                    found = find(texts[i].as_py() or "", rules)
                    rows.append((ids[i].as_py(), version, _spans(found, rules, False), _spans(found, rules, True),
                                 [sum(1 for f in found if f[1] == k) for k in range(len(rules))]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)],
                                                 names=["blob", "rule_version", "spans", "base_spans", "counts"])

    return blobs.select("blob", "text").mapInArrow(
        run, "blob string, rule_version string, spans string, base_spans string, counts array<long>")


def read_ledger(spark, path: str) -> DataFrame | None:
    """The ledger's table, or None where none was written yet.  Scans that
    ran at the same time may both have appended a pair; equal content and
    rules give equal findings, so any one of its rows stands for it."""
    try:
        rows = spark.read.schema("blob string, rule_version string, spans string, base_spans string, counts array<long>") \
            .parquet(path)
        return rows.groupBy("blob", "rule_version").agg(
            *[F.any_value(c).alias(c) for c in ("spans", "base_spans", "counts")])
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def scan(versions: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``versions`` (without its text) with the findings of its
    blob: ``scan_blob, scan_spans, scan_base_spans, scan_counts``."""
    spark, version = versions.sparkSession, rule_version(rules)
    t = F.col(f"`{text}`")
    v = versions.withColumn("scan_blob", blob_id(t))
    todo = v.select(F.col("scan_blob").alias("blob"), text_of(t).alias("text")).groupBy("blob").agg(
        F.any_value("text").alias("text"))
    seen = read_ledger(spark, ledger)
    if seen is not None:
        todo = todo.join(seen.filter(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    scan_blobs(todo, rules).write.mode("append").parquet(ledger)
    found = read_ledger(spark, ledger).filter(F.col("rule_version") == version).select(
        F.col("blob").alias("scan_blob"), F.col("spans").alias("scan_spans"), F.col("base_spans").alias("scan_base_spans"),
        F.col("counts").alias("scan_counts"))
    return v.drop(text).join(found, "scan_blob", "left")


def op5_secrets(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Per document: counts of the base kinds, digest of their spans, all spans.

    ``ledger`` names a ledger to go on with; without it the scan starts a new
    one in the shared folder."""
    got = scan(docs.select("doc_id", "text"), ledger or shared_folder(docs.sparkSession, "secret-ledger"))
    c = F.col("scan_counts")
    return got.select("doc_id", *[F.get(c, F.lit(i)).alias(f"n_{r.kind}") for i, r in enumerate(RULES) if r.base],
                      F.sha2(F.col("scan_base_spans").cast("binary"), 256).alias("base_sha256"),
                      F.col("scan_spans").alias("spans"))
