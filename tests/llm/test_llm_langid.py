import zlib

import numpy as np
from pyspark.sql import functions as F

from llm_data import ODD_TEXTS, docs, empty
from shiftscope.llm import langid
from shiftscope.session import read_table

SF01 = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_fold(spark):
    docs(spark)
    d = read_table(spark, SF01, "documents")
    lang = {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}
    got = langid.op8_langid(d).collect()
    assert len(got) == len(lang)
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) / len(out) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)
    # labels of the held-out fold are not seen
    wrong = d.withColumn("lang", F.when(langid.held_out(3), F.lit("xx")).otherwise(F.col("lang")))
    again = {r.doc_id: (r.lang_pred, r.score) for r in langid.op8_langid(wrong).collect()}
    assert again == {r.doc_id: (r.lang_pred, r.score) for r in got}


def test_filter_returns_all_languages_of_a_key():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 63, 500).astype(np.uint64), rng.integers(0, 1 << 63, 500).astype(np.uint64)
    langs = [f"l{i:02}" for i in range(70)]                     # two slices of languages
    f = langid.Filter(langs, {x: (a if x == "l01" else np.concatenate((a, b)) if x == "l69" else np.zeros(0, np.uint64)) for x in langs}, "l00")
    n = f.counts(np.concatenate((a, b)), np.repeat([0, 1], 500), 2)
    assert n[0, 1] == n[0, 69] == n[1, 69] == 500 and n[1, 1] <= 5 and n[:, 0].sum() == 0


def test_ngrams_stay_in_their_text():
    keys, doc, letters = langid.ngrams(["ab cd", "", "x", "AB CD", "12 !"])
    assert letters.tolist() == [4, 0, 1, 4, 0]
    assert sorted(keys[doc == 0]) == sorted(keys[doc == 3]) and not (doc == 4).any()


def test_odd_rows(spark):
    d = docs(spark, ODD_TEXTS + ["123 456 !!!"])
    got = {r.doc_id: r for r in langid.op8_langid(d).collect()}
    for i in (0, 1, 2, len(ODD_TEXTS)):
        assert got[i].lang_pred == "und" and got[i].score == 0
    assert all(r.lang_pred in ("en", "de", "und") for r in got.values())
    assert langid.op8_langid(empty(spark)).count() == 0
    nolang = docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.op8_langid(nolang).collect()} == {"und"}
