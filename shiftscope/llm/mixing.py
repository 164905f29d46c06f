"""Mixing sources to target weights.

1. One aggregation gives every source's size in words; water-filling turns
   weights into targets of at most ``max_repeats`` times a source's size.
2. A source's documents fall into ``a * b`` equal hash blocks.  The source's
   draw sequence runs through all blocks once per full epoch, each epoch in
   its own keyed permutation, and ends inside a last, partial epoch exactly
   where the target's words are reached (one document per source is cut).
3. The exact number of block draws of each source is split among the output
   shards by a multivariate-hypergeometric tree: a node deals the draws it
   was given to its two halves, down to single shards.  Every task walks the
   same tree (each node has its own seed), so no quota table is shuffled.
4. Shards own disjoint runs of the permuted draw sequences and put their
   documents into a keyed random order locally.

Only one row per source reaches the driver (``max_sources`` bounds it).

Defined results: NULL or empty texts have size 0 and are never drawn; the
NULL source is a source of its own, last in order.  Repeated rows fall into
the same block and are drawn alike.  An empty table gives an empty mix.
Extra columns pass through; added columns have the prefix ``mix_``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, broadcast_if, cut_lineage, text_of, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 4096
SHARD_WORDS = 1 << 22
SEED = 20240601
MAX_SOURCES = 100_000
GROUP = 1024


def targets(sizes: list[int], weights: list[float], cap: float = MAX_REPEATS) -> list[float]:
    """Share ``sum(sizes)`` by weight; a target stops at ``cap`` times its
    size and what is over is shared again by weight among the others."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0], total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


@dataclass(frozen=True)
class Source:
    name: str | None
    ix: int
    size: int
    target: float
    a: int          # blocks = a * b
    b: int
    epochs: int     # full passes
    rest: int       # words of the partial pass

    @property
    def blocks(self) -> int:
        return self.a * self.b


def plan_sources(docs: DataFrame, weights=WEIGHTS, cap: float = MAX_REPEATS, block_words: int = BLOCK_WORDS,
                 max_sources: int = MAX_SOURCES) -> list[Source]:
    """``docs`` holds ``source`` and ``mix_size``; one row per source is collected."""
    rows = (docs.groupBy("source").agg(F.sum("mix_size").alias("size"))
            .limit(max_sources + 1).collect())
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources: raise max_sources if the driver may hold them")
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    sizes = [int(r["size"] or 0) for r in rows]
    goal = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(rows))], cap)
    out = []
    for i, (r, size, t) in enumerate(zip(rows, sizes, goal)):
        n = max(1, -(-size // block_words))
        a = int(np.ceil(np.sqrt(n)))
        words = int(round(t))
        out.append(Source(r["source"], i, size, t, a, -(-n // a), words // size if size else 0, words % size if size else 0))
    return out


def _source_table(spark, sources: list[Source]) -> DataFrame:
    rows = [(s.name, s.ix, s.size, s.target, s.a, s.b, s.epochs, s.rest) for s in sources]
    return F.broadcast(spark.createDataFrame(rows, """mix_name string, mix_ix int, mix_source_size long, mix_target double,
        mix_a int, mix_b int, mix_epochs int, mix_rest long"""))


def with_source(docs: DataFrame, sources: list[Source], seed: int) -> DataFrame:
    """Add the source's plan and the document's block; one row per source is broadcast."""
    t = _source_table(docs.sparkSession, sources)
    d = docs.join(t, F.col("source").eqNullSafe(F.col("mix_name")), "left").drop("mix_name")
    return d.withColumn("mix_block", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")),
                                            F.col("mix_a").cast("long") * F.col("mix_b").cast("long")))


def _permuted(epoch: Column, seed: int) -> Column:
    """Keyed permutation of 0 .. a*b-1: a Feistel network over Z_a x Z_b."""
    a, b = F.col("mix_a").cast("long"), F.col("mix_b").cast("long")
    left, right = F.floor(F.col("mix_block") / b), F.pmod(F.col("mix_block").cast("long"), b)
    for k in range(4):
        if k % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), F.col("mix_ix"), epoch, F.lit(k), right), a), a)
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), F.col("mix_ix"), epoch, F.lit(k), left), b), b)
    return (left * b + right).cast("long")


def split_tree(quota: np.ndarray, draws: list[np.ndarray], n_shards: int, seed: int) -> list[np.ndarray]:
    """Shard of each draw (``draws[s]``: sorted positions in source s's sequence).

    At a node for shards [lo, hi) the left half gets a multivariate
    hypergeometric share of the node's quotas; draws below a source's share
    go left.  Halves without a wanted draw are not visited."""
    out = [np.zeros(len(d), dtype=np.int64) for d in draws]
    stack = [(0, n_shards, quota.astype(np.int64), [(0, len(d)) for d in draws], [0] * len(draws))]
    while stack:
        lo, hi, have, runs, offset = stack.pop()
        if all(x == y for x, y in runs):
            continue
        if hi - lo == 1:
            for s, (x, y) in enumerate(runs):
                out[s][x:y] = lo
            continue
        mid = (lo + hi) // 2
        total = int(have.sum())
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        # half of the draws, in proportion to the halves' shards, rounded by the seed
        want = int(total * (mid - lo) / (hi - lo) + rng.random())
        left = _mvh(rng, have, min(want, total))
        lr, rr, ro = [], [], []
        for s, (x, y) in enumerate(runs):
            cut = x + int(np.searchsorted(draws[s][x:y], offset[s] + left[s]))
            lr.append((x, cut))
            rr.append((cut, y))
            ro.append(offset[s] + int(left[s]))
        stack.append((lo, mid, left, lr, offset))
        stack.append((mid, hi, have - left, rr, ro))
    return out


def _mvh(rng: np.random.Generator, have: np.ndarray, want: int) -> np.ndarray:
    if have.sum() < 1_000_000_000:
        return rng.multivariate_hypergeometric(have, want, method="marginals")
    # beyond the generator's range: the same marginals, source by source
    left, others = np.zeros_like(have), int(have.sum())
    for s, h in enumerate(have.tolist()):
        others -= h
        left[s] = hypergeometric(rng, h, others, want)
        want -= int(left[s])
    return left


def _log_factorial_step(x: int, d: int) -> float:
    """log (x+d)! - log x!, without the loss of subtracting two large logs."""
    if min(x, x + d) < 1_000_000:
        return math.lgamma(x + d + 1) - math.lgamma(x + 1)
    return (x + d + 0.5) * math.log1p(d / x) + d * math.log(x) - d + (1 / (x + d) - 1 / x) / 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good, at any size.

    Rejection under the envelope that every log-concave law obeys around its
    mode (flat up to ``w / p``, exponential beyond, ``p`` the mode's
    probability); the law itself enters only through ratios to its mode."""
    lo, hi = max(0, n - bad), min(good, n)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (good + bad + 2)))
    cells = (mode, good - mode, n - mode, bad - n + mode)
    lf = [math.lgamma(x + 1) for x in (good, bad, n, good + bad - n, good + bad, *cells)]
    # a tenth below the logarithms' value: a lower p only widens the envelope
    p = min(1.0, 0.9 * math.exp(sum(lf[:4]) - sum(lf[4:])))
    w = 1 + p / 2
    while True:
        y = rng.random() * w / p if rng.random() * (1 + w) <= w else (w + rng.standard_exponential()) / p
        d = round(y) if rng.random() < 0.5 else -round(y)
        if not lo <= mode + d <= hi:
            continue
        ratio = -sum(_log_factorial_step(x, e) for x, e in zip(cells, (d, -d, -d, d)))
        if math.log(1 - rng.random()) + min(0.0, w - p * y) <= ratio:
            return mode + d


def plan_draws(narrow: DataFrame, sources: list[Source], seed: int = SEED, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, int]:
    """One row per block: ``mix_draws array<struct<copy, shard>>`` and, for a
    source's last block, where its partial draw ends.

    Prefix sums over a source's blocks run in two levels, so no task sees
    more than ``GROUP`` blocks or one row per group of a source."""
    from pyspark.sql import Window as W

    d = with_source(narrow, sources, seed)
    blocks = cut_lineage(d.filter(F.col("mix_size") > 0).groupBy(
        "mix_ix", "mix_block", "mix_a", "mix_b", "mix_epochs", "mix_rest").agg(F.sum("mix_size").alias("words"))
        .withColumn("p", _permuted(F.col("mix_epochs"), seed)).withColumn("g", F.floor(F.col("p") / GROUP)))
    groups = blocks.groupBy("mix_ix", "g").agg(F.sum("words").alias("gw"))
    groups = groups.withColumn("before", F.sum("gw").over(
        W.partitionBy("mix_ix").orderBy("g").rowsBetween(W.unboundedPreceding, -1))).select(
        "mix_ix", "g", F.coalesce("before", F.lit(0)).alias("g0"))
    inner = F.coalesce(F.sum("words").over(
        W.partitionBy("mix_ix", "g").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = (blocks.withColumn("w0", inner).join(groups, ["mix_ix", "g"])
              .withColumn("start", F.col("g0") + F.col("w0"))
              .withColumn("in_rest", F.least(F.greatest(F.col("mix_rest") - F.col("start"), F.lit(0)), F.col("words"))))
    placed = cut_lineage(placed.drop("w0", "g0", "g"))

    # number of draws of each source: full epochs, and the partial one up to its last block
    last = {r["mix_ix"]: r["p"] for r in placed.filter("in_rest > 0").groupBy("mix_ix").agg(F.max("p").alias("p")).collect()}
    quota = np.array([s.epochs * s.blocks + (last[s.ix] + 1 if s.ix in last else 0) for s in sources], dtype=np.int64)
    n_shards = max(1, -(-int(sum(s.target for s in sources)) // shard_words))
    first = {s.ix: s.blocks for s in sources}

    def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf) == 0:
                continue
            pos = pdf["copy"].to_numpy() * pdf["mix_ix"].map(first).to_numpy() + pdf["p"].to_numpy()
            order = np.argsort(pos, kind="stable")
            ix = pdf["mix_ix"].to_numpy()[order]
            idx = [order[ix == s] for s in range(len(quota))]
            shards = split_tree(quota, [pos[i] for i in idx], n_shards, seed)
            shard = np.zeros(len(pdf), dtype=np.int64)
            for i, x in zip(idx, shards):
                shard[i] = x
            yield pdf.assign(shard=shard)[["mix_ix", "mix_block", "copy", "shard", "in_rest"]]

    draws = None
    for e in range(max([s.epochs for s in sources], default=0) + 1):
        full = placed.filter(F.col("mix_epochs") > e).select(
            "mix_ix", "mix_block", F.lit(e).alias("copy"), _permuted(F.lit(e), seed).alias("p"),
            F.lit(None).cast("long").alias("in_rest"))
        draws = full if draws is None else draws.unionByName(full)
    draws = draws.unionByName(placed.filter("in_rest > 0").select(
        "mix_ix", "mix_block", F.col("mix_epochs").alias("copy"), "p", F.when(
            F.col("in_rest") < F.col("words"), F.col("in_rest")).alias("in_rest")))
    dealt = draws.mapInPandas(assign, "mix_ix int, mix_block long, copy int, shard long, in_rest long")
    # a cut block: documents in keyed order; where the cut falls, and how many words it leaves there
    cut = placed.filter((F.col("in_rest") > 0) & (F.col("in_rest") < F.col("words"))).select("mix_ix", "mix_block", "in_rest")
    in_cut = d.filter(F.col("mix_size") > 0).join(F.broadcast(cut), ["mix_ix", "mix_block"])  # one row per source
    in_cut = in_cut.groupBy("mix_ix", "mix_block", "in_rest", _order(seed).alias("key"), "mix_size").agg(F.count("*").alias("n"))
    run = F.coalesce(F.sum(F.col("mix_size") * F.col("n")).over(
        W.partitionBy("mix_ix", "mix_block").orderBy("key", "mix_size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = (in_cut.withColumn("before", run)
            .filter((F.col("before") < F.col("in_rest")) & (F.col("before") + F.col("mix_size") * F.col("n") >= F.col("in_rest")))
            .select("mix_ix", "mix_block", F.col("key").alias("cut_key"), F.col("mix_size").alias("cut_size"),
                    F.round((F.col("in_rest") - F.col("before")) / F.col("n")).cast("long").alias("cut_words")))
    plan = (dealt.groupBy("mix_ix", "mix_block").agg(F.sort_array(F.collect_list(  # at most max_repeats draws of a block
        F.struct("copy", "shard", F.col("in_rest").isNotNull().alias("cut")))).alias("mix_draws"))
        .join(ends, ["mix_ix", "mix_block"], "left"))
    return cut_lineage(plan), n_shards


def _order(seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.col("doc_id"))


def with_draws(docs: DataFrame, plan: DataFrame, sources: list[Source], seed: int = SEED) -> DataFrame:
    """Add ``mix_draws array<struct<copy, shard, words>>`` to every document
    (needs ``mix_size``); documents that are not drawn have an empty array."""
    d = with_source(docs, sources, seed).join(broadcast_if(plan, 200_000), ["mix_ix", "mix_block"], "left")
    key = F.struct(_order(seed).alias("k"), F.col("mix_size").alias("s"))
    end = F.struct(F.col("cut_key").alias("k"), F.col("cut_size").alias("s"))
    part = F.when(key < end, F.col("mix_size")).when(key == end, F.least("cut_words", "mix_size")).otherwise(F.lit(0).cast("long"))
    draws = F.transform("mix_draws", lambda x: F.struct(
        x["copy"].alias("copy"), x["shard"].alias("shard"), F.when(x["cut"], part).otherwise(F.col("mix_size")).alias("words")))
    none = F.array().cast("array<struct<copy:int,shard:bigint,words:bigint>>")
    return (d.withColumn("mix_draws", F.when(F.col("mix_size") > 0, F.coalesce(
        F.filter(draws, lambda x: x["words"] > 0), none)).otherwise(none))
        .drop("mix_ix", "mix_block", "mix_a", "mix_b", "mix_epochs", "mix_rest", "cut_key", "cut_size", "cut_words"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("mix_size", word_count(F.col("text")))


def plan_mix(docs: DataFrame, weights=WEIGHTS, cap: float = MAX_REPEATS, block_words: int = BLOCK_WORDS,
             shard_words: int = SHARD_WORDS, seed: int = SEED):
    """(narrow sized documents, sources, block plan, number of shards)."""
    narrow = cut_lineage(_sized(docs.select("doc_id", "source", "text")).drop("text"))
    sources = plan_sources(narrow, weights, cap, block_words)
    plan, n_shards = plan_draws(narrow, sources, seed, shard_words)
    return narrow, sources, plan, n_shards


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word, white space as it was."""
    parts = F.split(text, rf"(?<=[^{SPACE_CLASS}])(?=[{SPACE_CLASS}])")
    return F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = MAX_REPEATS, block_words: int = BLOCK_WORDS,
        shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """The mixture itself: every draw as a row with the document's columns
    (text cut where its draw is partial) plus ``mix_shard`` and ``mix_copy``.
    Each shard is one partition's contiguous run, in keyed random order."""
    _, sources, plan, n_shards = plan_mix(docs, weights, cap, block_words, shard_words, seed)
    cols = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    d = with_draws(_sized(docs), plan, sources, seed).withColumn("mix_draw", F.explode("mix_draws"))
    words = F.col("mix_draw.words")
    d = d.select(*[F.when(words < F.col("mix_size"), first_words(text_of(F.col("text")), words)).otherwise(F.col("text")).alias("text")
                   if c == "text" else F.col(f"`{c}`") for c in docs.columns],
                 F.col("mix_draw.shard").alias("mix_shard"), F.col("mix_draw.copy").alias("mix_copy"))
    return (d.repartition(n_shards, "mix_shard")
            .sortWithinPartitions("mix_shard", F.xxhash64(F.lit(seed + 2), F.col("mix_shard"), F.col("mix_copy"), F.col("doc_id"))))


def op1_mixing(docs: DataFrame) -> DataFrame:
    """Per document: its size, its source's size and target, the words taken."""
    narrow, sources, plan, _ = plan_mix(docs)
    d = with_draws(narrow, plan, sources)
    return d.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.aggregate("mix_draws", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"),
        F.concat_ws(",", F.transform("mix_draws", lambda x: x["shard"].cast("string"))).alias("shards"))
