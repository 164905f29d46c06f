from llm_data import docs, empty, words
from shiftscope.llm import quality


def brute(t):
    w = words(t)
    n = len(w)
    lines = [x for x in (t or "").split("\n") if words(x)]
    wins = [tuple(w[i:i + 5]) for i in range(n - 4)]
    cover = set()
    for i, x in enumerate(wins):
        if wins.count(x) > 1 if n < 200 else False:
            cover.update(range(i, i + 5))
    if n >= 200:
        from collections import Counter
        c = Counter(wins)
        for i, x in enumerate(wins):
            if c[x] > 1:
                cover.update(range(i, i + 5))
    r = len(cover)
    return (n, sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), r,
            n < 10 or 100 * r > 20 * n)


def test_counts_match_brute_force_on_odd_rows(spark):
    d = docs(spark)
    src = {}
    for r in d.collect():
        src.setdefault(r.doc_id, r.text)
    got = quality.op3_quality(d).collect()
    assert len(got) == d.count()
    for r in got:
        assert tuple(r[1:7]) == brute(src[r.doc_id]), r
        assert not (r.kept and r.base_failed)


def test_verdict_follows_the_threshold_table(spark):
    d = docs(spark, ["the river of words is long and it was here to be " * 3 + "x y z w v u t s r q p o n m",
                     "WORD!! AGAIN!! NOISE!! LOUD!! MORE!! SHOUT!! CRY!! YELL!! HEY!! OH!! AH!! UH!!",
                     "a### b*** c$$$ d%%% e&&& f||| g<<< h>>> i### j*** k$$$ l%%%"])
    got = {r.doc_id: r for r in quality.op3_quality(d).collect()}
    assert "capitals" in got[1].failed_rules and not got[1].kept
    assert "symbols" in got[2].failed_rules and not got[2].kept


def test_apply_rules_keeps_columns_and_handles_empty(spark):
    d = docs(spark)
    kept = quality.apply_rules(d)
    assert kept.columns == d.columns
    want = sum(r.kept for r in quality.op3_quality(d).collect())
    assert kept.count() == want > 0
    assert quality.op3_quality(empty(spark)).count() == 0
    assert quality.apply_rules(empty(spark)).count() == 0
