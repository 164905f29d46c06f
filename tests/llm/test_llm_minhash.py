import numpy as np
import pyarrow as pa
import pytest

from llm_data import ODD_TEXTS, SF001, brute_components, docs, empty, prose, shingles
from shiftscope.llm import minhash as M
from shiftscope.session import read_table


def edited(words, seed, n):
    rng = np.random.default_rng(seed)
    w = list(words)
    for i in rng.choice(len(w), n, replace=False):
        w[i] = f"edit{seed}x{i}"
    return " ".join(w)


def group_texts():
    """Copies of one text with more and more edits: chains, links between
    members that are far from the leader, and texts just below the bound."""
    base = [f"w{i}" for i in range(120)]
    out = [edited(base, s, s % 14) for s in range(90)]
    out += [prose(60, s) for s in range(20)] + [out[5]] * 6 + [out[5].upper()]
    return out


def test_sets_match_brute_force():
    texts = [*ODD_TEXTS, "A b a B a b", " lead and trail ", None]
    for k in (1, 2, 5):
        got = list(M.shingle_sets(pa.array(texts), k))
        assert [len(g) for g in got] == [len(shingles(t, k)) for t in texts]
        same = {}
        for t, g in zip(texts, got):
            assert same.setdefault(shingles(t, k), g.tobytes()) == g.tobytes()


def test_slices_do_not_change_sets(monkeypatch):
    texts = [t for t in ODD_TEXTS]
    want = [g.tobytes() for g in M.shingle_sets(pa.array(texts), 2)]
    monkeypatch.setattr(M, "SLICE", 37)
    assert [g.tobytes() for g in M.shingle_sets(pa.array(texts), 2)] == want


def test_signature_is_circulant_and_estimates():
    scatter, rank = M.tables()
    s = np.unique(np.random.default_rng(2).integers(0, 1 << 62, 500).astype(np.uint64))
    sig = M.signature(s)
    at = scatter[(s & np.uint64(M.D - 1)).astype(int)]
    for k in (0, 1, 77, M.K - 1):
        assert sig[k] == rank[:M.D][(at + k) % M.D].min()
    agree = np.mean(M.signature(s[:400]) == M.signature(s[100:]))
    assert abs(agree - 300 / len(s)) < 0.2


def test_common_counts():
    rng = np.random.default_rng(3)
    x = [np.unique(rng.integers(0, 50, 20)).astype(np.uint64) for _ in range(7)]
    y = [np.unique(rng.integers(0, 50, 20)).astype(np.uint64) for _ in range(5)]
    same, _, _ = M.common_counts(x, y, width=8)
    assert same.tolist() == [[len(set(a) & set(b)) for b in y] for a in x]


@pytest.mark.parametrize("k", [2, 5])
def test_components_of_a_hard_group(spark, monkeypatch, k):
    monkeypatch.setattr(M, "CELL", 16)
    texts = group_texts()
    want, sets = brute_components(list(enumerate(texts)), k)
    got = {r.doc_id: r for r in M.near_duplicates(docs(spark, texts).select("doc_id", "text"), k).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == want[i]) for i, r in got.items())


def test_table_and_odd_rows(spark):
    d = read_table(spark, SF001, "documents")
    want, _ = brute_components([(r.doc_id, r.text) for r in d.collect()], 2)
    assert {r.doc_id: r.component_id for r in M.op10_minhash(d).collect()} == want
    odd = docs(spark)
    got = M.op10_minhash(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[0].kept and by[1].kept and by[2].kept and by[0].n_shingles == 0
    assert by[7].component_id == 6 and by[None].component_id == 6 and not by[None].kept
    assert M.op10_minhash(empty(spark)).count() == 0


def test_deduplicate_keeps_one_row_of_each_group(spark):
    odd = docs(spark)
    kept = M.deduplicate(odd, 2)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14]
    assert M.deduplicate(empty(spark)).count() == 0


def test_deduplicate_keeps_unlinked_rows_without_ids(spark):
    docs(spark)
    rows = [(None, prose(30, 1)), (None, prose(30, 2)), (None, prose(30, 2)), (4, prose(30, 3)), (4, prose(30, 4)), (4, prose(30, 3))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.text for r in M.deduplicate(d, 5).collect())
    assert got == sorted({t for _, t in rows})


def test_components_of_a_long_chain(spark):
    docs(spark)
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in M.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
