"""Near-duplicate documents by circulant MinHash.

1. *Sketch* (one pass, no shuffle).  A text's word shingles are hashed to 64
   bits and reduced to a universe of ``D`` positions.  The first permutation
   scatters the positions; the second gives their ranks, and shifting it
   circularly by 0 .. K-1 gives all K signature coordinates: a shingle's K
   ranks are one contiguous run of the second permutation's table.
2. Documents with equal shingle sets collapse to one node (content id of the
   set), so copies never multiply pairs.
3. *Banding*.  In every bucket the members are paired with the bucket's
   leader only; the distinct pairs are verified by the exact Jaccard
   similarity of the full sets.  Connected components follow from the links.
4. *The rest*.  A bucket of three or more members that still spans several
   components may hide links between members.  The nodes of such buckets
   meet in cells of two parts of bounded size, where the exact similarity of
   all pairs of different components comes from a product of incidence
   matrices.  So each pair that shares a bucket is connected already or
   compared exactly, and only links leave a cell.

A pair at the threshold shares no bucket with probability
``(1 - 0.8 ** ROWS) ** BANDS`` (3e-6).  Components are found by alternating
large-star and small-star steps over checkpointed edge tables; no links,
components or signatures reach the driver.

Defined results: NULL, empty and blank texts have no shingles, are linked
with nothing and kept; texts with fewer words than a shingle count as one
shingle.  Repeated rows are copies.  The smallest doc_id of a component
represents it (NULL ids come last).  Empty tables give empty results; extra
columns pass through :func:`deduplicate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, cut_lineage

D = 1 << 22        # universe of the permutations
BANDS, ROWS = 32, 5
K = BANDS * ROWS
PERCENT = 80
CELL = 512         # nodes of one part of a cell, and their shingles
CELL_SHINGLES = 1_000_000
SLICE = 1 << 21    # bytes hashed at once
SEED = 7
BROADCAST_ROWS = 2_000_000     # ids, 16 bytes each
BROADCAST_BUCKETS = 1_000_000  # buckets, 24 bytes each
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_POWERS: list[np.ndarray] = []
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
U = np.uint64


def tables(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The two permutations: scatter table, and rank table with its first K
    entries repeated at the end (the circular shift)."""
    if seed not in _TABLES:
        rng = np.random.default_rng(seed)
        scatter = rng.permutation(D).astype(np.int32)
        rank = rng.permutation(D).astype(np.uint32)
        _TABLES[seed] = scatter, np.concatenate((rank, rank[:K]))
    return _TABLES[seed]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        size = max(n, SLICE + 1)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate((np.ones(1, U), np.full(size - 1, b, dtype=U)))) for b in (base, inverse)]
    return _POWERS[0], _POWERS[1]


def _word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of concatenated UTF-8 texts (``starts``:
    where texts begin) and the text number of each; A-Z count as a-z."""
    n = len(data)
    hashes, docs = [], []
    lo = 0
    border = np.zeros(n + 1, dtype=bool)
    border[starts[starts < n]] = True
    border[n] = True
    while lo < n:
        hi = min(lo + SLICE, n)
        while hi < n and not _SPACE[data[hi - 1]] and not border[hi]:  # cut between words only
            step = np.flatnonzero(_SPACE[data[hi:hi + SLICE]] | border[hi:hi + len(data[hi:hi + SLICE])])
            hi = hi + int(step[0]) + (not border[hi + int(step[0])]) if len(step) else min(hi + SLICE, n)
        part = data[lo:hi]
        word = ~_SPACE[part]
        edge = border[lo:hi]
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(s):
            up, down = _powers(len(part))
            lower = part.astype(U)
            lower[(part >= 65) & (part <= 90)] += U(32)
            run = np.concatenate((np.zeros(1, U), np.cumsum((lower + U(1)) * up[:len(part)], dtype=U)))
            hashes.append(_mix((run[e] - run[s]) * down[s] + (e - s).astype(U) * U(0xD1342543DE82EF95)))
            docs.append(np.searchsorted(starts, s + lo, "right") - 1)
        lo = hi
    if not hashes:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(docs)


def shingle_sets(col: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's set of ``k``-word shingles, as a sorted array of hashes."""
    col = col.cast(pa.large_string()) if len(col) else col
    if not len(col):
        return
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    body = col.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    for lo, hi in _runs(offs):
        part = data[offs[lo]:offs[hi]]
        starts = offs[lo:hi + 1] - offs[lo]
        # empty texts share their start with the next one: words belong to the last of them
        words, doc = _word_hashes(part, starts[:-1])
        count = np.bincount(doc, minlength=hi - lo)
        at = np.concatenate(([0], np.cumsum(count)))
        mult = [U((2 * j + 1) * 0xA24BAED4963EE407 % (1 << 64)) for j in range(k)]
        if len(words) >= k:
            acc = np.zeros(len(words) - k + 1, dtype=U)
            for j in range(k):
                acc += _mix(words[j:len(words) - k + 1 + j] * mult[j] + U(j))
            acc = _mix(acc)
        else:
            acc = np.zeros(0, U)
        for d in range(hi - lo):
            n = int(count[d])
            if n == 0:
                yield np.zeros(0, U)
            elif n < k:
                w = words[at[d]:at[d + 1]]
                one = np.array([n], dtype=U)
                for j in range(n):
                    one = one + _mix(w[j:j + 1] * mult[j] + U(j))
                yield _mix(one * U(0x2545F4914F6CDD1D))
            else:
                yield np.unique(acc[at[d]:at[d + 1] - k + 1])


def _runs(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE bytes together (at least one text)."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLICE, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def signature(shingles: np.ndarray, seed: int = SEED) -> np.ndarray:
    """All K coordinates: the least rank in each circular shift."""
    scatter, rank = tables(seed)
    runs = np.lib.stride_tricks.sliding_window_view(rank, K)
    at = scatter[(shingles & U(D - 1)).astype(np.int64)]
    out = np.full(K, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(at), 512):
        np.minimum(out, runs[at[lo:lo + 512]].min(axis=0), out=out)
    return out


def _node(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(docs: DataFrame, shingle: int, text: str = "text") -> DataFrame:
    """``row`` columns of ``docs`` but the text, with ``n_shingles, node,
    bands array<long>``."""
    rest = [c for c in docs.columns if c != text]
    at, pick = docs.columns.index(text), [docs.columns.index(c) for c in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                sizes, nodes, sigs = [], [], np.zeros((part.num_rows, K), dtype=np.uint32)
                for i, s in enumerate(shingle_sets(part.column(at), shingle)):
                    sizes.append(len(s))
                    nodes.append(_node(s) if len(s) else None)
                    if len(s):
                        sigs[i] = signature(s)
                rows = sigs.reshape(-1, BANDS, ROWS).astype(U)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), rows.shape[:2]).copy()
                for j in range(ROWS):
                    key = _mix(key * U(0x9E3779B97F4A7C15) + rows[:, :, j])
                bands = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, (part.num_rows + 1) * BANDS, BANDS, dtype=np.int32)),
                    pa.array(key.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in pick], pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), bands],
                    names=[*rest, "n_shingles", "node", "bands"])

    from pyspark.sql import types as T
    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()),
                           T.StructField("bands", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(run, schema)


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``node, text`` -> ``node, shingles binary`` (sorted 64-bit hashes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, text = b.column(b.schema.get_field_index("node")), b.column(b.schema.get_field_index("text"))
            for lo in range(0, b.num_rows, 500):
                sets = [s.tobytes() for s in shingle_sets(text.slice(lo, 500), shingle)]
                yield pa.RecordBatch.from_arrays([node.slice(lo, 500), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles binary")


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs ``a, b`` with 100 * intersection >= percent * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_, b_, x_, y_ = (b.column(i) for i in range(4))
            ok = []
            for x, y in zip(x_, y_):
                u, v = np.frombuffer(x.as_buffer(), dtype=U), np.frombuffer(y.as_buffer(), dtype=U)
                if 100 * min(len(u), len(v)) < percent * max(len(u), len(v)):
                    ok.append(False)
                    continue
                both = np.concatenate((u, v))
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(100 * same >= percent * (len(u) + len(v) - same))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a_.filter(keep), b_.filter(keep)], names=["a", "b"])

    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(
        F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``a, b`` -> ``node, root``: the smallest node of each component, by
    alternating large-star and small-star steps; every step's edges are
    written to the shared checkpoint folder."""
    def state(e: DataFrame):
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    e = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = state(e)
    while before[0]:
        # large star: neighbours above u go to the least of u and its neighbours
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and its neighbours below go to the least of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        e = cut_lineage(small)
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def _open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """``bucket, node, root`` of the buckets that span several components."""
    rooted = members.join(comps, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    spans = rooted.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("bucket")
    return rooted.join(spans, "bucket")


def _joined(comps: DataFrame, found: DataFrame) -> DataFrame:
    """The components after more links: only the components that the links
    touch are worked on."""
    if found.isEmpty():
        return comps
    ra, rb = (comps.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    edges = found.join(ra, "a", "left").join(rb, "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    more = cut_lineage(components(edges))
    moved = more.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return comps.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")).unionByName(more)


def _rest_links(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components among the nodes of open buckets (``bucket,
    node, root``), from exact similarities.

    Nodes that open buckets join form a group.  Its largest component and its
    other nodes are dealt out to parts; every pair of parts but two of the
    largest component is a cell, whose similarities come from one product of
    incidence matrices.  A cell returns at most one link for every component
    it joins, so what leaves the cells never grows with the pairs."""
    lead = rest.groupBy("bucket").agg(F.min("node").alias("a"))
    of = components(rest.join(lead, "bucket").select("a", F.col("node").alias("b")).distinct())
    nodes = rest.select("node", "root").distinct().join(of.withColumnRenamed("root", "grp"), "node", "left").join(sets, "node").select(
        "node", "root", F.coalesce("grp", "node").alias("grp"), "shingles", (F.octet_length("shingles") / 8).cast("long").alias("n"))
    nodes = cut_lineage(nodes)
    by_root = nodes.groupBy("grp", "root").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    grp = by_root.groupBy("grp").agg(
        F.max_by("root", F.struct("c", "root")).alias("main"), F.max(F.struct("c", "root", "n"))["n"].alias("n_main"), F.max("c").alias("c_main"),
        (F.sum("c") - F.max("c")).alias("c_other"), F.sum("n").alias("n_all"))
    deal = lambda c, n: F.ceil(F.greatest(c / CELL, n / CELL_SHINGLES)).cast("int")
    grp = grp.select("grp", "main", deal(F.col("c_main"), F.col("n_main")).alias("p_main"),
                     deal(F.col("c_other"), F.col("n_all") - F.col("n_main")).alias("p_other"))
    m = nodes.join(broadcast_if(cut_lineage(grp), 200_000), "grp")
    is_main, h = F.col("root") == F.col("main"), F.xxhash64("node")
    part = F.when(is_main, F.pmod(h, F.col("p_main"))).otherwise(F.col("p_main") + F.pmod(h, F.col("p_other"))).cast("int")
    others = F.sequence(F.col("p_main"), F.col("p_main") + F.col("p_other") - 1)
    m = m.withColumn("part", part).withColumn("other", F.explode(
        F.when(is_main, others).otherwise(F.sequence(F.lit(0), F.col("p_main") + F.col("p_other") - 1))))
    m = m.select("grp", "node", "root", "shingles", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        x = pdf[pdf["part"] == i]
        y = x if i == j else pdf[pdf["part"] == j]
        if len(x) == 0 or len(y) == 0:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        same, na, nb = common_counts([np.frombuffer(z, U) for z in x["shingles"]], [np.frombuffer(z, U) for z in y["shingles"]])
        ok = 100 * same >= percent * (na[:, None] + nb[None, :] - same)
        ra, rb = x["root"].to_numpy(), y["root"].to_numpy()
        ok &= ra[:, None] != rb[None, :]
        u, v = np.nonzero(ok)
        parent: dict[int, int] = {}

        def top(r: int) -> int:
            while parent.get(r, r) != r:
                parent[r] = parent.get(parent[r], parent[r])
                r = parent[r]
            return r

        out, seen = [], set()
        for p, q in zip(u.tolist(), v.tolist()):
            key = (ra[p], rb[q])
            if key in seen:
                continue
            seen.add(key)
            f, g = top(int(ra[p])), top(int(rb[q]))
            if f != g:
                parent[f] = g
                out.append((p, q))
        a, b = x["node"].to_numpy()[[p for p, _ in out]], y["node"].to_numpy()[[q for _, q in out]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return m.groupBy("grp", "i", "j").applyInPandas(cell, "a long, b long")


def common_counts(x: list[np.ndarray], y: list[np.ndarray], width: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of all intersections of the sets ``x`` with the sets ``y``, and
    the sets' sizes: incidence matrices over the common elements, multiplied
    ``width`` elements at a time."""
    def flat(sets):
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), n), n

    fx, rx, nx = flat(x)
    fy, ry, ny = flat(y)
    both = np.intersect1d(fx, fy)
    same = np.zeros((len(x), len(y)), dtype=np.float64)

    def placed(f, r):
        at = np.searchsorted(both, f)
        ok = at < len(both)
        ok[ok] = both[at[ok]] == f[ok]
        at, r = at[ok], r[ok]
        order = np.argsort(at, kind="stable")
        return at[order], r[order]

    (ax, qx), (ay, qy) = placed(fx, rx), placed(fy, ry)
    for lo in range(0, len(both), width):
        w = min(width, len(both) - lo)
        mx, my = np.zeros((len(x), w), np.float32), np.zeros((len(y), w), np.float32)
        for m, at, q in ((mx, ax, qx), (my, ay, qy)):
            s, e = np.searchsorted(at, (lo, lo + w))
            m[q[s:e], at[s:e] - lo] = 1
        same += mx @ my.T
    return same.astype(np.int64), nx, ny


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """``doc_id, blob, n_shingles, node, grp, component_id, kept`` for every row
    of ``docs`` (``doc_id, text``); ``blob`` is a hash of the text, ``grp`` the
    component's smallest node (NULL where there are no shingles)."""
    base = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("blob"), "text")
    sk = cut_lineage(sketch(base, shingle))
    filled = sk.filter("n_shingles > 0")
    nodes = filled.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    # the id and text hash of one row that holds the set
    rep = filled.groupBy("node").agg(F.min(F.struct("doc_id", "blob")).alias("r")).select(
        "node", F.col("r.doc_id").alias("doc_id"), F.col("r.blob").alias("blob"))
    # copies repeat a node's entries; least and greatest node tell the buckets
    # of one node apart, and need no row but one for each bucket of a task
    entries = filled.select("node", F.explode("bands").alias("bucket"))
    buckets = cut_lineage(entries.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader <> last"))
    members = entries.join(broadcast_if(buckets, BROADCAST_BUCKETS), "bucket")
    stars = cut_lineage(members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Full sets of the nodes ``wanted`` (``node``), from one of their rows."""
        rows = cut_lineage(rep.join(broadcast_if(cut_lineage(wanted.distinct()), BROADCAST_ROWS), "node"))
        texts = base.join(broadcast_if(rows, BROADCAST_ROWS), [base["doc_id"].eqNullSafe(rows["doc_id"]), base["blob"] == rows["blob"]]) \
            .select("node", "text")
        # equal rows give the same set: any one of them serves
        return full_sets(texts, shingle).dropDuplicates(["node"])

    links = cut_lineage(verify(stars, sets_of(_ends(stars)), percent))
    comps = cut_lineage(components(links))
    # buckets of three or more that span several components may hide links
    # between members
    third = cut_lineage(members.filter("node <> leader AND node <> last").select("bucket").distinct())
    rest = cut_lineage(_open(entries.join(broadcast_if(third, BROADCAST_BUCKETS), "bucket", "left_semi").distinct(), comps))
    if not rest.isEmpty():
        found = cut_lineage(_rest_links(rest, sets_of(rest.select("node")), percent))
        comps = cut_lineage(_joined(comps, found))
    # smallest doc_id of each component
    of = nodes.select("node", "doc_id").join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = of.join(least, "root").select("node", F.col("root").alias("grp"), "component_id")
    out = sk.select("doc_id", "blob", "n_shingles", "node").join(of, "node", "left")
    cid = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "blob", "n_shingles", "node", "grp", cid.alias("component_id"), F.col("doc_id").eqNullSafe(cid).alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs`` (all columns) with one row of each group: the row of the
    smallest doc_id, of equal ids that with the least text hash."""
    d = near_duplicates(docs, shingle, percent)
    lone = d.filter("node IS NULL").select("doc_id", "blob").distinct()
    best = d.filter("node IS NOT NULL AND kept").groupBy("doc_id", "grp").agg(F.min("blob").alias("blob"))
    keep = cut_lineage(best.select("doc_id", "blob").unionByName(lone))
    blob = F.xxhash64(F.coalesce("text", F.lit("")))
    k = broadcast_if(keep.select(F.col("doc_id").alias("__id"), F.col("blob").alias("__blob")), BROADCAST_ROWS)
    kept = docs.withColumn("__own", blob).join(k, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__blob")), "left_semi")
    dup = d.filter("kept").groupBy("doc_id", "blob").count().filter("count > 1").limit(1)
    if not dup.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "__own"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_minhash(docs: DataFrame) -> DataFrame:
    """Per document: size of its set of two-word shingles, its component, kept."""
    return near_duplicates(docs.select("doc_id", "text"), 2).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
p AS (SELECT doc_id, n, i, x, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM u),
s AS (SELECT DISTINCT doc_id, CASE WHEN n = 1 THEN x ELSE x || ' ' || y END AS sh FROM p WHERE y IS NOT NULL OR n = 1),
sized AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM inter JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id WHERE r.m < e.b)
SELECT documents.doc_id, coalesce(sized.n, 0)::BIGINT AS n_shingles, min(r.m) AS component_id, documents.doc_id = min(r.m) AS kept
FROM documents JOIN r ON r.doc_id = documents.doc_id LEFT JOIN sized ON sized.doc_id = documents.doc_id GROUP BY documents.doc_id, sized.n"""
