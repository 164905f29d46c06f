import numpy as np
import pytest

from llm_data import docs
from shiftscope.llm import ann
from shiftscope.session import read_table
from llm_data import SF001
from pyspark.sql import functions as F


def brute(rows, is_query, k=20):
    out = {}
    for qi, q in rows:
        if not is_query(qi):
            continue
        s = sorted(((-float((np.array(v) * np.array(q)).sum()), i) for i, v in rows if i != qi))[:k]
        out[qi] = [(i, -x) for x, i in s]
    return out


def check(got, want):
    have = {}
    for r in got:
        have.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(have) == {q for q, x in want.items() if x}
    hit = total = 0
    for q, x in have.items():
        x.sort()
        assert [r for r, _, _ in x] == list(range(1, len(want[q]) + 1))
        hit += len({i for _, i, _ in x} & {i for i, _ in want[q]})
        total += len(x)
        for (_, i, s), (j, t) in zip(x, want[q]):
            if i == j:
                assert s == pytest.approx(t, rel=1e-12, abs=1e-12)
    return hit / total


def test_recall_on_the_table(spark):
    docs(spark)
    d = read_table(spark, SF001, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in d.collect()]
    assert check(ann.op7_ann(d).collect(), brute(rows, lambda i: i % 20 == 0)) >= 0.99


def test_invalid_tied_and_repeated_vectors(spark):
    docs(spark)
    rng = np.random.default_rng(1)
    good = [(i, rng.standard_normal(12).tolist()) for i in range(300)]
    hot = [(i, [0.5] * 12) for i in range(300, 420)]           # one vector in a third of the rows
    bad = [(1000, None), (1020, [0.0] * 12), (1040, [None] * 12), (1060, [float("nan")] * 12), (1080, [float("inf")] * 12), (1100, [1.0] * 5), (None, [1.0] * 12)]
    d = spark.createDataFrame([(i, v, 1, 2) for i, v in good + hot + bad + good[:20]], "vec_id long, embedding array<float>, rank int, score int")
    rows = [(i, np.float32(v).astype(float)) for i, v in good + hot]
    got = ann.op7_ann(d).collect()
    want = brute(rows, lambda i: i % 20 == 0)
    assert check(got, want) == 1.0
    assert {(r.query_id, r["rank"]): r.vec_id for r in got} == {(q, k + 1): i for q, x in want.items() for k, (i, _) in enumerate(x)}
    blocks = ann.nearest(d, F.col("vec_id") % 20 == 0, block=37, query_block=3).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in blocks} == {(r.query_id, r["rank"], r.vec_id) for r in got}


def test_few_candidates_and_empty(spark):
    docs(spark)
    d = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.op7_ann(d).collect()}
    assert got == {(0, 1): 3, (0, 2): 20, (20, 1): 3, (20, 2): 0}
    assert ann.op7_ann(d.limit(0)).count() == 0


@pytest.mark.parametrize("scale, offset", [(1e20, 0.0), (1e30, 0.0), (1e-30, 0.0), (1.0, 1e7)])
def test_large_components_and_distant_centres_lose_nothing(spark, scale, offset):
    docs(spark)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(16) * scale + offset).tolist()) for i in range(400)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, lambda i: i % 20 == 0)
    assert {(r.query_id, r["rank"]): r.vec_id for r in ann.op7_ann(d).collect()} == {
        (q, k + 1): i for q, x in want.items() for k, (i, _) in enumerate(x)}
