"""Queries of the corpus operators: each applies its operator, with
production parameters, to its whole table."""

from __future__ import annotations

from ..plans.catalog import Query
from . import ann, langid, lm, minhash, mixing, pii, qda, quality, secrets_scan, spm, turns, warc, whiten
from .common import read_table

QUERIES: dict[str, Query] = {}


def _over(table: str, name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = Query(name, lambda spark, sf_dir: build(read_table(spark, sf_dir, table)), sql)


_over("documents", "op1_mixing", mixing.op1_mixing)
_over("documents", "op2_lm", lm.op2_lm)
_over("documents", "op3_quality", quality.op3_quality, quality.oracle_sql())
_over("documents", "op4_pii", pii.op4_pii)
_over("documents", "op5_secrets", secrets_scan.op5_secrets)
_over("documents", "op6_sentencepiece", spm.op6_sentencepiece)
_over("embeddings", "op7_ann", ann.op7_ann)
_over("documents", "op8_langid", langid.op8_langid)
_over("pages", "op9_warc", warc.op9_warc, warc.ORACLE_SQL)
_over("documents", "op10_minhash", minhash.op10_minhash, minhash.ORACLE_SQL)
QUERIES["op11_qda"] = Query("op11_qda", lambda spark, sf_dir: qda.op11_qda(
    read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")), None)
_over("embeddings", "op12_whiten", whiten.op12_whiten)
_over("conversations", "op13_turns", turns.op13_turns)
