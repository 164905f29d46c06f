"""Quadratic discriminant against a dense restatement, and held-out accuracy."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_data import ODD_TEXTS, SF01, docs, empty, words
from shiftscope.llm import qda
from shiftscope.session import read_table


def plain_features(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if x.strip(" ")]
    n = {"words": len(w), "lines": len(lines), "chars": sum(map(len, w)), "symbols": len(re.findall(r"[#*$%&|<>{}\[\]=~^@\\_]", t)),
         "capitals": sum(c.isupper() for c in t), "shouts": len(re.findall("[!?]{2}", t)),
         "bare": sum(not any(c.isalnum() for c in x) for x in w), "repeats": sum(a == b for a, b in zip(w, w[1:])),
         "pairs": sum(a == b for a, b in zip(w, w[2:])), "same_lines": len(lines) - len(set(lines)),
         "stops": len(re.findall(r"[.!?]", t)), "commas": len(re.findall(r"[,;:]", t)), "digits": sum(c.isdecimal() for c in t)}
    width = {"words": 8.0, "lines": 2.0, "chars": 40.0}
    out = {name: math.log((n[a] + p * width[b]) / (n[b] + width[b])) for name, a, b, p in qda.RATIOS if a in n}
    out["word_length"] = math.log((n["chars"] + 40) / (n["words"] + 8))
    out["longest"] = math.log(max([8, *map(len, w)]))
    return out


def test_features_of_odd_texts(spark):
    got = qda.features(docs(spark).select("doc_id", "text"), keep=["doc_id"]).collect()
    seen = {r["doc_id"]: dict(zip(qda.FEATURES, r["features"])) for r in got if r["doc_id"] is not None}
    for i, t in enumerate(ODD_TEXTS):
        for name, v in plain_features(t).items():
            assert seen[i][name] == pytest.approx(v, rel=1e-12, abs=1e-12), (i, name)
    assert len(got) == docs(spark).count()


def test_model_is_the_dense_one(spark):
    rng = np.random.default_rng(1)
    d = len(qda.FEATURES)
    x = np.vstack([rng.standard_normal((300, d)), rng.standard_normal((60, d)) * 2 + 1])
    w = np.array([[0, 1]] * 300 + [[1, 0]] * 50 + [[2, 1]] * 10)
    rows = spark.createDataFrame([(r.tolist(), int(a), int(b)) for r, (a, b) in zip(x, w)], "features array<double>, w0 long, w1 long")
    model = qda.fit(rows)
    n = w.sum(axis=0).astype(float)
    centre = (x * w.sum(axis=1)[:, None]).sum(axis=0) / n.sum()
    spread = np.sqrt(((x - centre) ** 2 * w.sum(axis=1)[:, None]).sum(axis=0) / n.sum())
    z = np.clip((x - centre) / spread, -qda.CLIP, qda.CLIP)
    means = [np.average(z, axis=0, weights=w[:, c]) for c in (0, 1)]
    scatter = [((z - means[c]) * w[:, [c]]).T @ (z - means[c]) for c in (0, 1)]
    pooled = sum(scatter) / n.sum()
    logs = []
    for c in (0, 1):
        extra = qda.POOL_ROWS * d
        s = qda.shrunk((scatter[c] + extra * pooled) / (n[c] + extra), n[c] + extra)
        delta = z - means[c]
        logs.append(math.log(n[c] / n.sum()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,ij->i", delta, np.linalg.solve(s, delta.T).T))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-9)


def test_shrinkage_keeps_the_trace_and_gets_weaker():
    rng = np.random.default_rng(2)
    a = np.diag([5.0, 1.0, 0.1])
    for n, least in ((5, 0.05), (10_000, 0)):
        s = qda.shrunk(np.cov(rng.multivariate_normal(np.zeros(3), a, n).T), n)
        assert np.linalg.eigvalsh(s).min() > 0 and s[0, 0] < 8
    assert np.trace(qda.shrunk(a, 50)) == pytest.approx(np.trace(a), rel=1e-6)


def test_held_out_accuracy(spark):
    d, labels = read_table(spark, SF01, "documents"), read_table(spark, SF01, "labels")
    got = qda.op11_qda(d, labels)
    assert got.count() == d.count()
    truth = labels.where("quality is not null").select("doc_id", "quality")
    rows = got.join(truth, "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.97 * len(held)


def test_held_out_labels_and_other_columns_are_never_used(spark):
    d, labels = read_table(spark, SF01, "documents"), read_table(spark, SF01, "labels")
    one = {r["doc_id"]: r["score"] for r in qda.op11_qda(d, labels).collect()}
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    other = d.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s")).withColumn("score", F.lit(3)).withColumn("features", F.lit("f"))
    two = {r["doc_id"]: r["score"] for r in qda.op11_qda(other, flipped.withColumn("w0", F.lit(9))).collect()}
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)


def test_missing_labels_and_odd_rows(spark):
    d = docs(spark)
    schema = "doc_id long, quality int, toxic int"
    none = qda.op11_qda(d, spark.createDataFrame([], schema)).collect()
    assert len(none) == d.count() and {r["score"] for r in none} == {0.5}
    only = qda.op11_qda(d, spark.createDataFrame([(i, 1, 0) for i in range(9)] + [(3, None, 0), (4, 7, 1), (None, 0, 0)], schema)).collect()
    assert {r["score"] for r in only} == {1.0} and {r["predicted"] for r in only} == {1}
    both = qda.op11_qda(d, spark.createDataFrame([(i, i % 2, 0) for i in range(12)] * 2, schema)).collect()
    assert all(0 <= r["score"] <= 1 for r in both) and [r["held_out"] for r in both if r["doc_id"] is None] == [False]
    assert qda.op11_qda(empty(spark), spark.createDataFrame([(1, 1, 0)], schema)).count() == 0
