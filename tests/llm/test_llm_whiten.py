"""Whitening against a dense eigenvalue solver."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_data import SF001
from shiftscope.llm import whiten
from shiftscope.session import read_table


def covariance(values, dim, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.asarray(values)) @ q.T


@pytest.mark.parametrize("dim,wanted,values", [
    (12, 32, np.linspace(1, 2, 12)), (64, 32, np.linspace(1, 1.001, 64)), (300, 8, 1 / (1 + np.arange(300.0))),
    (200, 32, np.concatenate([np.full(40, 5.0), np.linspace(0.1, 4.9, 160)])), (150, 5, np.exp(-np.arange(150.0))),
    (400, 6, np.linspace(1, 1.5, 400))])
def test_eigenpairs(dim, wanted, values):
    a = covariance(values, dim)
    passes = []

    def product(x):
        passes.append(x.shape[1])
        return a @ x

    e, v, residual = whiten.jacobi_davidson(product, dim, wanted)
    want = np.sort(values)[::-1][:min(wanted, dim)]
    assert len(e) == len(want) and np.allclose(e, want, rtol=0, atol=1e-13 * want[0])
    assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-13
    assert np.linalg.norm(a @ v - v * e, axis=0).max() <= 1e-13 * want[0] and residual <= 1e-13
    assert max(passes) <= max(whiten.BASIS * wanted, wanted + 4) + 1


def test_minres_solves_the_projected_equation():
    a = covariance(np.linspace(1, 9, 20), 20)
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((20, 3)))[0]
    rhs = np.random.default_rng(3).standard_normal((20, 2))
    theta = np.array([3.3, 7.1])
    t = whiten.minres(lambda x: a @ x, theta, rhs, q, steps=40, least=1e-12)
    p = np.eye(20) - q @ q.T
    for j in range(2):
        assert np.allclose(p @ (a - theta[j] * np.eye(20)) @ p @ t[:, j], p @ rhs[:, j], atol=1e-9)


def expected(vectors, components=32):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    wide = n * x - s
    y = wide.astype(float) / n
    cov = y.T @ y / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    keep = [i for i in range(min(components, len(e))) if e[i] > 1e-11 * e[0]]
    return n, [int((r ** 2).sum()) for r in wide], y @ (q[:, keep] / np.sqrt(e[keep])), e[keep] / np.trace(cov)


def check(df, ids, vectors, components=32):
    n, deviation, white, explained = expected(vectors, components)
    rows = {}
    for r in whiten.whiten(df, components).collect():
        rows.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(rows) == set(ids)
    for j in range(white.shape[1]):
        col = np.array([rows[i][j + 1]["whitened"] for i in ids])
        assert min(np.abs(col - white[:, j]).max(), np.abs(col + white[:, j]).max()) < 1e-6
    for i, d in zip(ids, deviation):
        mine = rows[i]
        assert set(mine) == set(range(1, white.shape[1] + 1))
        for j, r in mine.items():
            assert (r["n"], r["deviation"]) == (n, d)
            assert r["explained"] == pytest.approx(explained[j - 1], rel=1e-9)
            assert r["identity_error"] <= 1e-6 and r["residual"] <= 1e-12


def test_table(spark):
    d = read_table(spark, SF001, "embeddings")
    rows = d.collect()
    check(d, [r.vec_id for r in rows], [r.embedding for r in rows])
    assert whiten.op12_whiten(d).count() == 32 * len(rows)


def test_invalid_repeated_and_other_lengths(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(v) for v in np.float32(rng.standard_normal(6) * (1 + np.arange(6)))]) for i in range(60)]
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (102, [float("nan")] * 6), (103, [float("inf")] * 6), (104, [1.0] * 5), (105, [])]
    d = spark.createDataFrame([(i, v, 3, "n") for i, v in good + bad], "vec_id long, embedding array<float>, component int, n string")
    check(d, [i for i, _ in good], [v for _, v in good])
    check(d, [i for i, _ in good], [v for _, v in good], 3)
    twice = d.unionAll(d.where("vec_id = 7")).unionAll(d.where("vec_id = 8").withColumn("vec_id", F.lit(None).cast("long")))
    got = whiten.op12_whiten(twice).where("component = 1").collect()
    assert len(got) == 62 and sum(r["vec_id"] is None for r in got) == 1 and sum(r["vec_id"] == 7 for r in got) == 2


def test_flat_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten.op12_whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten.op12_whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    assert whiten.op12_whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], schema)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0, float(-i)]) for i in range(9)], schema)     # one direction only
    assert {r["component"] for r in whiten.op12_whiten(line).collect()} == {1}


def test_large_components(spark):
    rows = [(i, [float(2 ** 33) * (i % 7), float(i), -float(i * i)]) for i in range(40)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    n, deviation, _, _ = expected([v for _, v in rows])
    got = {r["vec_id"]: r for r in whiten.op12_whiten(d).where("component = 1").collect()}
    assert [got[i]["deviation"] for i in range(40)] == [v if v < 2 ** 63 else None for v in deviation]
