"""Small tables with every odd case, and brute-force helpers."""

import re

from shiftscope.session import ship_package

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PROSE = ("the river of words and the bridge to it was long and that is for you as on by this day in an old town "
         "with be at are from here some people walk home now").split()


def prose(n, seed=0):
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(PROSE[(x >> 8) % len(PROSE)] + ("a", "e", "", "on")[(x >> 16) % 4])
    return " ".join(out)


ODD_TEXTS = [
    None, "", "  \n\t ", "one", "Two words", "x" * 5000, prose(40, 1), prose(40, 1), prose(40, 2).upper(),
    prose(3000, 3), "line a\nline a\nline a\n\nline b " + prose(20, 4), " ".join(["same"] * 60), "é ü ß ñ 漢字 😀 " + prose(12, 5),
    "tab\tsep\x0bvt\x0cff\rcr  nbsp stays " + prose(10, 6), "### *** $$$ %%% " + prose(10, 7),
]
DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size int, target double, kept boolean, "
              "score string, node long, words string, ids string, component_id long, n_words long")


def docs(spark, texts=None, extra=True):
    """Odd documents: NULL ids and sources, repeated rows, clashing extra columns."""
    texts = ODD_TEXTS if texts is None else texts
    rows = [(i, t, ("en", "de", None)[i % 3], ("b", "a", None, "b")[i % 4], len(t or ""), 1, 2.0, True, "s", 5, "w", "i", 3, 4)
            for i, t in enumerate(texts)]
    if texts is ODD_TEXTS:
        rows += [rows[6], rows[9], (None, *rows[7][1:])]
    ship_package(spark)
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def empty(spark):
    ship_package(spark)
    return spark.createDataFrame([], DOC_SCHEMA)


def words(t):
    return WORD.findall(t or "")


def shingles(t, k):
    w = words((t or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute_components(rows, k, percent=80):
    """rows: (doc_id, text) with distinct ids -> {doc_id: smallest reachable}."""
    sets = {i: shingles(t, k) for i, t in rows}
    by = {}
    for i, s in sets.items():
        by.setdefault(s, []).append(i)
    distinct = [s for s in by if s]
    parent = {s: s for s in by}

    def top(s):
        while parent[s] != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    for a in range(len(distinct)):
        for b in range(a):
            x, y = distinct[a], distinct[b]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                c = len(x & y)
                if 100 * c >= percent * (len(x) + len(y) - c):
                    parent[top(x)] = top(y)
    least = {}
    for s, ids in by.items():
        if s:
            r = top(s)
            least[r] = min(min(ids), least.get(r, min(ids)))
    return {i: (least[top(s)] if s else i) for i, s in sets.items()}, sets
