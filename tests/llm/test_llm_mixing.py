import math

import numpy as np
from pyspark.sql import functions as F

from llm_data import docs, empty, words
from shiftscope.llm import mixing
from shiftscope.session import read_table
from llm_data import SF001


def brute_targets(sizes, weights, cap=3):
    """Share, cut at the cap, share what is over among the others, again and again."""
    t = [sum(sizes) * w / sum(weights) for w in weights]
    for _ in range(1000):
        over = sum(max(0, x - cap * s) for x, s in zip(t, sizes))
        if over < 1e-9:
            break
        free = [i for i, (x, s) in enumerate(zip(t, sizes)) if x < cap * s]
        t = [min(x, cap * s) for x, s in zip(t, sizes)]
        for i in free:
            t[i] += over * weights[i] / sum(weights[j] for j in free)
    return t


def test_targets_water_fill():
    for sizes in ([10, 1000, 5], [100, 100, 100, 100], [1, 1, 10000], [0, 5, 7], []):
        w = [float((5, 2, 1)[i % 3]) for i in range(len(sizes))]
        assert np.allclose(mixing.targets(sizes, w), brute_targets(sizes, w), rtol=1e-9, atol=1e-6)


def test_taken_meets_targets_and_caps(spark):
    d = read_table(spark, SF001, "documents")
    got = mixing.op1_mixing(d).toPandas()
    again = mixing.op1_mixing(d).toPandas()
    src = d.select("doc_id", "source", "text").toPandas()
    size = {r.doc_id: len(words(r.text)) for r in src.itertuples()}
    assert {r.doc_id: r.size for r in got.itertuples()} == size
    assert (got.taken <= 3 * got["size"]).all()
    m = got.merge(src[["doc_id", "source"]], on="doc_id")
    by = m.groupby("source").agg(taken=("taken", "sum"), size=("size", "sum"), target=("target", "first"), ss=("source_size", "first"))
    assert (by["size"] == by.ss).all()
    assert (abs(by.taken - by.target) <= 1).all()
    want = brute_targets(list(by["size"]), [float((5, 2, 1)[i % 3]) for i in range(len(by))])
    assert np.allclose(by.target, want)
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_mix_gives_the_texts_of_the_draws(spark):
    d = read_table(spark, SF001, "documents")
    taken = {r.doc_id: r.taken for r in mixing.op1_mixing(d).collect()}
    m = mixing.mix(d, shard_words=20_000)
    assert m.columns == [*d.columns, "mix_shard", "mix_copy"]
    rows = m.collect()
    full = {r.doc_id: r.text for r in d.collect()}
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
        assert full[r.doc_id].startswith(r.text)
    assert got == {k: v for k, v in taken.items() if v}
    sizes = {}
    for r in rows:
        sizes[r.mix_shard] = sizes.get(r.mix_shard, 0) + 1
    assert len(sizes) > 1


def test_split_tree_deals_exact_disjoint_quotas():
    quota = np.array([50, 7, 0, 1000])
    draws = [np.arange(q) for q in quota]
    out = mixing.split_tree(quota, draws, 13, 5)
    whole = np.array([np.bincount(x, minlength=13) for x in out])
    assert whole.sum() == quota.sum() and (whole.sum(axis=1) == quota).all()
    assert abs(whole.sum(axis=0) - quota.sum() / 13).max() <= 4
    assert all((np.diff(x) >= 0).all() for x in out)          # runs of the sequence
    part = mixing.split_tree(quota, [x[::3] for x in draws], 13, 5)  # any task sees the same tree
    assert all((a[::3] == b).all() for a, b in zip(out, part))


def test_permutation_is_a_bijection(spark):
    d = spark.range(0, 6 * 7).selectExpr("cast(id as int) mix_block", "3 mix_ix", "6 mix_a", "7 mix_b")
    for e in range(3):
        p = [r[0] for r in d.select(mixing._permuted(F.lit(e), 9)).collect()]
        assert sorted(p) == list(range(42)) and p != list(range(42))


def test_odd_rows(spark):
    d = docs(spark)
    got = mixing.op1_mixing(d).collect()
    assert len(got) == d.count()
    text = {r.doc_id: r.text for r in d.collect()}
    for r in got:
        assert r["size"] == len(words(text[r.doc_id])) and 0 <= r.taken <= 3 * r["size"]
    by = {r.doc_id: (r.source_size, r.target) for r in got}
    src = {r.doc_id: r.source for r in d.collect()}
    total = {}
    for r in got:
        s = src[r.doc_id]
        total[s] = total.get(s, 0) + r.taken
    for k, (_, t) in by.items():
        assert abs(total[src[k]] - t) <= 3  # repeated rows share the cut
    assert mixing.op1_mixing(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(d).select(d.columns).count() > 0


def test_first_words_keeps_white_space(spark):
    t = "  a b\n\nc  d  "
    d = spark.createDataFrame([(t, k) for k in range(1, 5)], "text string, k int")
    got = [r[0] for r in d.orderBy("k").select(mixing.first_words(F.col("text"), F.col("k"))).collect()]
    assert got[0] == "  a" and got[2] == "  a b\n\nc" and [len(words(x)) for x in got] == [1, 2, 3, 4]


def test_hypergeometric_follows_its_law_at_every_size():
    rng = np.random.Generator(np.random.PCG64(3))
    for good, bad, n in ((7, 5, 6), (3, 2_000_000_000, 700_000_000), (40, 2 * 10 ** 12, 10 ** 11), (5, 0, 3), (0, 9, 4)):
        x = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(20_000)])
        logs = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
        for k in range(max(0, n - bad), min(good, n) + 1):
            if good + bad < 100:
                p = math.exp(logs(good, k) + logs(bad, n - k) - logs(good + bad, n))
            else:  # few good ones among very many: as good as binomial
                p = math.exp(logs(good, k) + k * math.log(n / (good + bad)) + (good - k) * math.log1p(-n / (good + bad)))
            assert abs((x == k).mean() - p) < 5 * math.sqrt(p * (1 - p) / len(x)) + 1e-9, (good, bad, n, k)
    for good, bad, n in ((10 ** 12, 3 * 10 ** 12, 2 * 10 ** 12), (6 * 10 ** 8, 5 * 10 ** 8, 10 ** 6)):
        x = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(20_000)], dtype=float)
        total, share = good + bad, good / (good + bad)
        sd = math.sqrt(n * share * (1 - share) * (total - n) / (total - 1))
        z = (x - n * share) / sd
        assert abs(z.mean()) < 0.04 and abs(z.std() - 1) < 0.03 and abs((np.abs(z) < 1).mean() - 0.6827) < 0.02


def test_splits_beyond_the_generators_range_keep_all_draws():
    have = np.array([4 * 10 ** 12, 10, 3 * 10 ** 9, 0], dtype=np.int64)
    left = mixing._mvh(np.random.Generator(np.random.PCG64(1)), have, 2 * 10 ** 12)
    assert left.sum() == 2 * 10 ** 12 and (left <= have).all() and (left >= 0).all()


def test_blocks_of_very_large_sources(spark):
    big = mixing.Source("a", 0, 1, 1.0, 3_000_000, 3_000_000, 0, 1)
    d = spark.createDataFrame([(i, "a") for i in range(50)], "doc_id long, source string")
    got = [r[0] for r in mixing.with_source(d, [big], 1).select("mix_block").collect()]
    assert all(0 <= x < big.blocks for x in got) and max(got) > 1 << 31
    at = [r[0] for r in mixing.with_source(d, [big], 1).select(mixing._permuted(F.lit(0), 1)).collect()]
    assert all(0 <= x < big.blocks for x in at) and len(set(at)) == 50
