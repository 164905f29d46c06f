"""Whitening of embeddings: leading eigenvectors of their covariance by a
block Jacobi-Davidson method whose products run over the rows.

The covariance matrix is never formed.  One product is one pass: every task
reads its rows, subtracts the exact mean (integer sums), multiplies by the
block of vectors and by its own transpose, and sends ``dimensions x vectors``
partial sums, which Spark adds up.  On the driver live only vectors of the
embedding's own length: the subspace, its image, and the corrections.

Method: Rayleigh-Ritz on an orthonormal subspace; pairs whose residual has
reached double precision are locked, in order, and projected out; for the
others the projected correction equation ``(I-QQ')(V-theta)(I-QQ')t = -r`` is
solved by a few steps of MINRES, all wanted pairs sharing each pass; the
corrections extend the subspace, which is restarted from its best Ritz vectors
when it grows beyond ``BASIS`` times the wanted pairs (or holds the whole
space, where Rayleigh-Ritz is exact).

Defined results: NULL vectors, and those with NULL or non-finite entries, take
no part; neither do vectors whose length is not the table's most frequent one
(ties: the longer).  Entries beyond +-2^55 count as that.  Repeated rows and
NULL ids are rows like others.  Components whose eigenvalue is not above 1e-11
of the largest hold nothing but rounding and are left out, so a table of equal
vectors (or a single one) gives no rows, like an empty table.  A ``deviation``
beyond a long is NULL.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder

COMPONENTS = 32
SCALE, OFFSET = 64.0, 1_000_000
LIMIT = float(2 ** 55)
BASIS = 4                 # largest subspace, in wanted pairs
INNER = 6                 # steps of MINRES for one correction
INNER_RESIDUAL = 0.05
OUTER = 200
LEAST_SHARE = 1e-11       # of the largest eigenvalue
SEED = 12
LONG_MAX = 2 ** 63 - 1

Product = Callable[[np.ndarray], np.ndarray]


# -- the eigenvalue problem (vectors of one embedding's length) ----------------
def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Columns of ``new`` made orthonormal to all bases and to each other;
    directions that vanish are dropped."""
    out = np.zeros((len(new), 0))
    for j in range(new.shape[1]):
        v = new[:, j] / max(np.linalg.norm(new[:, j]), 1e-300)
        for _ in range(3):
            for b in (*bases, out):
                v = v - b @ (b.T @ v)
            size = np.linalg.norm(v)
            if size < 1e-10:
                break
            v = v / size
        else:
            out = np.column_stack([out, v])
    return out


def minres(product: Product, theta: np.ndarray, rhs: np.ndarray, q: np.ndarray, steps: int = INNER,
           least: float = INNER_RESIDUAL) -> np.ndarray:
    """``steps`` of MINRES for ``(I-qq')(V - theta_j)(I-qq') t_j = rhs_j``, one
    product for all columns together in each step."""
    def away(z):
        return z - q @ (q.T @ z)

    b = away(rhs)
    beta = np.linalg.norm(b, axis=0)
    start = np.maximum(beta, 1e-300)
    v, v_old = b / start, np.zeros_like(b)
    w, w_old, t = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    c, c_old, s, s_old = np.ones(len(theta)), np.ones(len(theta)), np.zeros(len(theta)), np.zeros(len(theta))
    eta, link = beta.copy(), np.zeros(len(theta))
    for _ in range(steps):
        z = away(product(v) - v * theta)
        alpha = (v * z).sum(axis=0)
        z = z - v * alpha - v_old * link
        link_new = np.linalg.norm(z, axis=0)
        # the two latest rotations, then a new one, on the tridiagonal column
        rho1 = c * alpha - c_old * s * link
        rho2 = s * alpha + c_old * c * link
        rho3 = s_old * link
        rho = np.maximum(np.hypot(rho1, link_new), 1e-300)
        c_old, s_old, c, s = c, s, rho1 / rho, link_new / rho
        w, w_old = (v - w * rho2 - w_old * rho3) / rho, w
        t = t + w * (c * eta)
        eta = -s * eta
        v_old, v, link = v, z / np.maximum(link_new, 1e-300), link_new
        if np.all(np.abs(eta) <= least * start):
            break
    return away(t)


def jacobi_davidson(product: Product, dim: int, wanted: int, seed: int = SEED, basis: int = BASIS) -> tuple[np.ndarray, np.ndarray, float]:
    """Largest ``wanted`` eigenvalues (falling), unit eigenvectors in columns,
    and the largest residual relative to the largest eigenvalue."""
    wanted = min(wanted, dim)
    most = min(dim, max(basis * wanted, wanted + 2))
    rng = np.random.default_rng(seed)
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    v = _orthonormal(rng.standard_normal((dim, min(dim, wanted + 4))))
    av = product(v)
    worst = 0.0
    for _ in range(OUTER):
        h = v.T @ av
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        v, av = v @ s, av @ s                       # Ritz vectors, best first
        left = min(wanted - locked.shape[1], v.shape[1])
        top = max(values[0] if len(values) else theta[0], 1e-300)
        r = av[:, :left] - v[:, :left] * theta[:left]
        r = r - locked @ (locked.T @ r)
        size = np.linalg.norm(r, axis=0) / top
        good = size <= 16 * np.finfo(float).eps * np.sqrt(dim)
        whole = locked.shape[1] + v.shape[1] == dim  # nothing lies outside the subspace
        n = left if whole else int(np.argmin(good)) if not good.all() else left
        if n:
            worst = max(worst, size[:n].max())
            locked, values = np.column_stack([locked, v[:, :n]]), np.concatenate([values, theta[:n]])
            v, av, theta, r, size, left = v[:, n:], av[:, n:], theta[n:], r[:, n:], size[n:], left - n
        if locked.shape[1] == wanted or top <= 1e-300:
            break
        active = np.flatnonzero(size[:left] > 16 * np.finfo(float).eps * np.sqrt(dim))
        t = minres(product, theta[active], -r[:, active], np.column_stack([locked, v[:, :left]]))
        if locked.shape[1] + v.shape[1] + len(active) > max(most, locked.shape[1] + left + len(active)) and v.shape[1] > left + 4:
            v, av = v[:, :left + 4], av[:, :left + 4]
        t = _orthonormal(np.column_stack([t, rng.standard_normal((dim, 1))]), locked, v)
        t = t[:, :max(1, dim - locked.shape[1] - v.shape[1])]
        v, av = np.column_stack([v, t]), np.column_stack([av, product(t)])
    # the vectors once more against each other, with their own images
    v = _orthonormal(locked)
    av = product(v)
    theta, s = np.linalg.eigh((v.T @ av + av.T @ v) / 2)
    theta, v, av = theta[::-1], (v @ s)[:, ::-1], (av @ s)[:, ::-1]
    worst = float(np.linalg.norm(av - v * theta, axis=0).max() / max(theta[0], 1e-300)) if len(theta) else 0.0
    return theta, v, worst


# -- passes over the rows -------------------------------------------------------
def _vectors(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _wide(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n*x - S``, exact: long integers where they suffice, else Python's."""
    if n * (int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) // max(n, 1) + 1) < 2 ** 62:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _cells(df: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``part(x)`` (of one fixed shape, any dtype float)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                p = part(_vectors(batch, "x", dim))
                total = p if total is None else total + p
        if total is not None:
            flat = np.asarray(total, dtype=float).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["cell", "v"])

    rows = df.select("x").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["cell"]] = r["v"]
    return out


def _sums(df: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of every dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, [0] * dim, [0] * dim
        for batch in batches:
            x = _vectors(batch, "x", dim)
            n += len(x)
            high = [a + int(b) for a, b in zip(high, (x >> 24).sum(axis=0))]
            low = [a + int(b) for a, b in zip(low, (x & 0xFFFFFF).sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_pydict({"i": list(range(-1, dim)), "s": [str(n), *[str((a << 24) + b) for a, b in zip(high, low)]]},
                                             pa.schema([("i", pa.int32()), ("s", pa.string())]))

    rows = (df.select("x").mapInArrow(run, "i int, s string").groupBy("i")
            .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    found = {r["i"]: int(r["s"]) for r in rows}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dim)]


def valid_vectors(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """Rows that take part, as integers ``x``, and their length (0: none)."""
    whole = embeddings.select("vec_id", "embedding").where(
        F.col("embedding").isNotNull()
        & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf"))))
    size = F.size("embedding")
    first = whole.groupBy(size.alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dim = first["d"] if first else 0
    whole = whole.where(size == dim)
    step = lambda e: (F.floor(F.greatest(F.least(e.cast("double") * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))) + OFFSET).cast("long")
    return whole.select("vec_id", F.transform("embedding", step).alias("x")), dim


SCHEMA = ("vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double, "
          "eigenvalue double, residual double")


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every row's whitened coordinates, one row a component (``SCHEMA``)."""
    spark = embeddings.sparkSession
    ident = embeddings.schema["vec_id"].dataType.simpleString()
    schema = SCHEMA.format(ident)
    rows, dim = valid_vectors(embeddings)
    if not dim:
        return spark.createDataFrame([], schema)
    path = shared_folder(spark, "whitening")
    rows.write.parquet(path)
    fit = spark.read.parquet(path)
    n, sums = _sums(fit, dim)

    def centred(x: np.ndarray) -> np.ndarray:
        return _wide(x, n, sums).astype(float) / n

    def product(block: np.ndarray) -> np.ndarray:
        def part(x):
            y = centred(x)
            return y.T @ (y @ block)
        return _cells(fit, dim, part).reshape(dim, block.shape[1]) / n

    trace = float(_cells(fit, dim, lambda x: np.array([(centred(x) ** 2).sum()]))[0]) / n
    if trace <= 0:
        return spark.createDataFrame([], schema)
    values, vectors, residual = jacobi_davidson(product, dim, components)
    real = values > LEAST_SHARE * values[0]
    values, turn = values[real], vectors[:, real] / np.sqrt(values[real])
    m = len(values)
    second = _cells(fit, dim, lambda x: (lambda w: w.T @ w)(centred(x) @ turn)).reshape(m, m) / n
    first = _cells(fit, dim, lambda x: (centred(x) @ turn).sum(axis=0)) / n
    error = float(np.abs(second - np.outer(first, first) - np.eye(m)).max())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                x = _vectors(batch, "x", dim)
                wide = _wide(x, n, sums)
                reach = int(np.abs(wide).max(initial=0))
                if dim * reach * reach <= LONG_MAX:
                    deviation = pa.array((wide.astype(np.int64) ** 2).sum(axis=1))
                else:
                    exact = [sum(int(v) ** 2 for v in r) for r in wide]
                    deviation = pa.array([e if e <= LONG_MAX else None for e in exact], pa.int64())
                white = (wide.astype(float) / n) @ turn
                each = np.repeat(np.arange(len(x)), m)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("vec_id")).take(pa.array(each)),
                     pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n, dtype=np.int64)),
                     deviation.take(pa.array(each)), pa.array(white.ravel()), pa.array(np.tile(values / trace, len(x))),
                     pa.array(np.full(len(each), error)), pa.array(np.tile(values, len(x))), pa.array(np.full(len(each), residual))],
                    names=[c.split()[0] for c in schema.split(", ")])

    return fit.select("vec_id", "x").mapInArrow(emit, schema)


def op12_whiten(embeddings: DataFrame) -> DataFrame:
    """Whitened coordinates of all vectors, 32 components."""
    return whiten(embeddings)
