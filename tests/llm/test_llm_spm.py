import random

import pytest
import sentencepiece

from llm_data import ODD_TEXTS, SF001, docs, empty
from shiftscope.llm import spm
from shiftscope.session import read_table


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=spm.DEFAULT_MODEL)


def test_ids_equal_the_library(library):
    rnd = random.Random(4)
    alphabet = "abcdetheringon ,.  \n0123éàñß漢字😀=-_()​\x00"
    texts = [t or "" for t in ODD_TEXTS] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    texts += ["    x", " " * 40 + "q", "aaaaaaaaaaaaaaaaaaaaaaaa", "\n\n", "a▁b"]
    m = spm.Model(*spm.read_model())
    ids, n = m.encode(texts)
    at = 0
    for t, k, want in zip(texts, n, library.encode(texts)):
        got = ids[at:at + k].tolist()
        at += k
        assert got == want, t
        assert m.decode(got) == library.decode(want)
        if "▁" not in t:
            assert m.decode(got) == t
    again, _ = m.encode(texts)                                 # from the held segments
    assert (again == ids).all()


def test_query_round_trips(spark, library):
    from llm_data import empty as _
    d = read_table(spark, SF001, "documents")
    docs(spark)
    got = spm.op6_sentencepiece(d).collect()
    text = {r.doc_id: r.text for r in d.collect()}
    assert len(got) == len(text)
    for r in got:
        assert r.ids == library.encode(text[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip


def test_encode_and_decode_as_operators(spark):
    d = docs(spark).drop("ids")
    e = spm.encode(d)
    assert e.columns == [*d.columns, "ids"]
    for r in spm.decode(e).collect():
        assert r.decoded == (r.text or "")
    assert spm.op6_sentencepiece(docs(spark)).count() == docs(spark).count()
    assert spm.op6_sentencepiece(empty(spark)).count() == 0


def test_runs_and_a_full_cache_change_nothing(spark, monkeypatch):
    from shiftscope.llm import spm
    texts = [t or "" for t in ODD_TEXTS] + [f"neu{i} wört{i * 7} 漢{i}" for i in range(400)]
    want, sizes = spm.Model(*spm.read_model(spm.DEFAULT_MODEL)).encode(texts)
    monkeypatch.setattr(spm, "CACHE_SEGMENTS", 30)
    monkeypatch.setattr(spm, "PAIRS", 5)
    small = spm.Model(*spm.read_model(spm.DEFAULT_MODEL))
    for part in (texts, texts[5:60], texts):
        got, n = small.encode(part, 50)
        assert len(n) == len(part)
    assert got.tolist() == want.tolist() and n.tolist() == sizes.tolist()


def test_known_pairs_and_tokens_are_not_asked_again(library, monkeypatch):
    """Segments that are not kept are encoded by array look-ups alone once their tokens were seen."""
    from collections import Counter
    rnd = random.Random(9)
    texts = [" ".join("".join(rnd.choice(("an", "the", "tion", "é", "漢", "😀", "x")) for _ in range(rnd.randint(1, 9))) for _ in range(40)) for _ in range(20)]
    monkeypatch.setattr(spm, "CACHE_SEGMENTS", 0)
    m = spm.Model(*spm.read_model())
    m.encode(texts)
    asked = Counter()
    for name in ("split", "may_follow", "_lone"):
        def count(*a, _name=name, _f=getattr(m, name)):
            asked[_name] += 1
            return _f(*a)
        monkeypatch.setattr(m, name, count)
    ids, n = m.encode(texts)
    assert ids.tolist() == [i for x in library.encode(texts) for i in x] and n.sum() == len(ids)
    assert asked["split"] == 0 and asked["may_follow"] <= 2 and asked["_lone"] <= 2
    assert len(m._number) == len(m._size) == 0 and len(m._ids) == 0


def test_kept_segments_stay_in_step_after_an_error(library, monkeypatch):
    m = spm.Model(*spm.read_model())
    m.encode(["ein zwei"])
    with monkeypatch.context() as at:
        at.setattr(m, "encode_segments", lambda segs: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            m.encode(["drei vier"])
    ids, _ = m.encode(["vier    fünf zwei drei"])
    assert ids.tolist() == library.encode("vier    fünf zwei drei")
