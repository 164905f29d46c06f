"""Nearest neighbours by largest inner product with one-bit codes.

Every vector, taken relative to the mean of all vectors, is turned by a
random rotation and keeps one bit a dimension (packed) with two scalars: its
length and how well the bits follow it.  From these the inner product with a
query is estimated, with an error bound that holds with high probability;
only vectors whose upper bound reaches the exact 20th best found so far are
ranked by their original components.  Estimates and scores are in double
precision, and the bound holds their rounding, so neither large components
nor a distant centre lose a neighbour.

Distribution: distinct vectors are packed into blocks, queries into query
blocks; each pair of blocks is one cell of work (queries against all rows in
blocks), which returns its best ``k`` per query; the cells' lists are merged
by a window per query.  A vector shared by many rows is one entry with its
``k + 1`` smallest ids: no query can return more of them, so nothing is lost
and a hot vector weighs as much as any other.

Defined results: vectors that are NULL, zero, hold NULL or non-finite
components, or whose length is not the table's most frequent one take no
part, neither does a NULL id.  Repeated rows (same id and vector) count once.
Ties go to the smaller id.  Fewer candidates than ``k``: all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if, cut_lineage

K = 20
BLOCK = 8192
QUERY_BLOCK = 1024
EPSILON = 4.0       # width of the error bound, in deviations
SEED = 11


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(v: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, length of the residual, and its agreement with the bits."""
    rest = v - centre
    length = np.linalg.norm(rest, axis=1)
    unit = rest @ turn / np.maximum(length, 1e-300)[:, None]
    agree = np.abs(unit).sum(axis=1) / np.sqrt(v.shape[1])
    return np.packbits(unit > 0, axis=1), length, np.where(length > 0, agree, 1.0)


def search_block(ids: list[np.ndarray], v: np.ndarray, code: np.ndarray, length: np.ndarray, agree: np.ndarray,
                 q_ids: np.ndarray, q: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int = K):
    """Best ``k`` of a block for each query: (query number, id, score) arrays."""
    dim = v.shape[1]
    signs = np.unpackbits(code, axis=1, count=dim) * 2.0 - 1
    turned = q @ turn
    scale = length / (agree * np.sqrt(dim))
    est = (signs @ turned.T) * scale[:, None] + (q @ centre)[None, :]
    spread = length * np.sqrt(np.maximum(0.0, 1 - agree ** 2)) / agree / np.sqrt(max(dim - 1, 1)) * EPSILON
    # what rounding may add: of the rotated residual, and of the centre's share, however far off it lies
    spread = spread + 1e-6 * length + 1e-12 * np.linalg.norm(centre)
    norms = np.linalg.norm(q, axis=1)
    first = min(len(v), 2 * (k + 1))
    out_q, out_id, out_s = [], [], []
    for j in range(len(q)):
        e = est[:, j]
        top = np.argpartition(-e, first - 1)[:first]
        exact = (v[top] * q[j]).sum(axis=1)
        # own row may be among them: the (k+1)-th distinct vector is a safe threshold
        floor = np.sort(exact)[::-1][k] if len(exact) > k else -np.inf
        cand = np.flatnonzero(e + spread * norms[j] >= floor)
        score = (v[cand] * q[j]).sum(axis=1)
        if len(cand) > k + 1:
            cut = np.partition(-score, k)[k]
            keep = -score <= cut
            cand, score = cand[keep], score[keep]
        n = [len(ids[c]) for c in cand]
        flat = np.concatenate([ids[c] for c in cand]) if len(cand) else np.zeros(0, np.int64)
        s = np.repeat(score, n)
        other = flat != q_ids[j]
        flat, s = flat[other], s[other]
        order = np.lexsort((flat, -s))[:k]
        out_q.append(np.full(len(order), j))
        out_id.append(flat[order])
        out_s.append(s[order])
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s)


def _valid(vectors: DataFrame) -> DataFrame:
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _centre(v: DataFrame, dim: int) -> np.ndarray:
    """Mean of all vectors (one row a dimension reaches the driver)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for b in batches:
            m = _matrix(b.column(0), dim)
            total += m.sum(axis=0)
            n += len(m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(total), pa.array(np.full(dim, n))], names=["i", "s", "n"])

    rows = v.select("v").mapInArrow(run, "i long, s double, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    out = np.zeros(dim)
    for r in rows:
        out[r["i"]] = r["s"] / max(1, r["n"])
    return out


def nearest(vectors: DataFrame, is_query, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``is_query`` (a
    column over ``vec_id``) holds."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid = _valid(vectors)
    size = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return empty
    dim = size["d"]
    v = valid.filter(F.size("v") == dim)
    centre, turn = _centre(v, dim), rotation(dim)
    # the k + 1 smallest ids of each distinct vector (limited inside every task before the shuffle)
    ranked = v.dropDuplicates().withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    entries = cut_lineage(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    queries = cut_lineage(v.filter(is_query).dropDuplicates(["vec_id", "v"]))
    n, nq = entries.count(), queries.count()
    if n == 0 or nq == 0:
        return empty
    parts = -(-nq // query_block)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: pa.Table):
            m = _matrix(rows.column("v").combine_chunks(), dim)
            code, length, agree = encode(m, centre, turn)
            ids = rows.column("ids").combine_chunks()
            sizes = np.diff(ids.offsets.to_numpy())
            blobs = [sizes.astype(np.int32), ids.flatten().to_numpy(), m, code, length, agree]
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in blobs],
                                              names=["sizes", "ids", "v", "code", "length", "agree"])

        held, count = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, block):
                part = b.slice(lo, block)
                if count + part.num_rows > block and held:
                    yield packed(pa.Table.from_batches(held))
                    held, count = [], 0
                held.append(part)
                count += part.num_rows
        if held:
            yield packed(pa.Table.from_batches(held))

    def pack_queries(pdf):
        import pandas as pd
        m = np.array(pdf["v"].tolist(), dtype=np.float64)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "q_ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "q": [m.tobytes()]})

    blocks = entries.repartition(max(1, -(-n // block))).mapInArrow(
        pack, "sizes binary, ids binary, v binary, code binary, length binary, agree binary")
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    packed_q = cut_lineage(queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).groupBy("part").applyInPandas(
        pack_queries, "part int, q_ids binary, q binary"))
    cells = blocks.join(broadcast_if(packed_q, 32), "part").drop("part")  # 32 query blocks: 16 MB at 64 dimensions

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.int32)
                flat = np.frombuffer(row["ids"], np.int64)
                m = np.frombuffer(row["v"], np.float64).reshape(-1, dim)
                code = np.frombuffer(row["code"], np.uint8).reshape(len(m), -1)
                ids = np.split(flat, np.cumsum(sizes)[:-1])
                q_ids, q = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q"], np.float64).reshape(-1, dim)
                j, found, score = search_block(ids, m, code, np.frombuffer(row["length"]), np.frombuffer(row["agree"]), q_ids, q, centre, turn, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[j]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    hits = cells.mapInArrow(work, "query_id long, vec_id long, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann(vectors: DataFrame) -> DataFrame:
    """Every vec_id divisible by 20 against all rows."""
    return nearest(vectors, F.col("vec_id") % 20 == 0)
