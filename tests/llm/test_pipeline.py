import sentencepiece

import corpus_pipeline as cp
from llm_data import SF001, brute_components, docs, empty, words
from shiftscope.llm import pii, quality, spm
from shiftscope.session import read_table, shared_folder
from test_llm_mixing import brute_targets


def through(spark, d, stages):
    base, out = shared_folder(spark, "test-pipeline"), [d]
    for i, (_, f) in enumerate(stages):
        f(spark, out[-1], SF001).write.parquet(f"{base}/{i}")
        out.append(spark.read.parquet(f"{base}/{i}"))
    return out


def test_every_stage_against_brute_force(spark):
    docs(spark)
    raw = read_table(spark, SF001, "documents")
    raw, clean, lone, masked, mixed, coded = through(spark, raw, cp.STAGES)
    for d in (clean, lone, masked, mixed):
        assert d.columns == raw.columns
    text = {r.doc_id: r.text for r in raw.collect()}
    # quality: the query's own verdicts
    kept = {r.doc_id for r in quality.op3_quality(raw).collect() if r.kept}
    assert {r.doc_id for r in clean.collect()} == kept and 0 < len(kept) < len(text)
    # near copies: one row of each group, of five-word shingles
    comp, _ = brute_components([(i, text[i]) for i in kept], 5)
    assert sorted(r.doc_id for r in lone.collect()) == sorted(set(comp.values()))
    # pseudonyms: all else stays
    hits = {r.doc_id: r.pii_hits for r in pii.with_pseudonyms(lone, pii.PUBLIC_KEY).collect()}
    assert any(hits.values())
    for r in masked.collect():
        assert (r.text != text[r.doc_id]) == bool(hits[r.doc_id]) and r.n_chars == len(r.text)
    # mixing: words per source meet the targets over what is left
    size, source, whole = {}, {}, {}
    for r in masked.collect():
        source[r.doc_id], whole[r.doc_id] = r.source, r.text
        size[r.source] = size.get(r.source, 0) + len(words(r.text))
    names = sorted(size)
    goal = dict(zip(names, brute_targets([size[n] for n in names], [float((5, 2, 1)[i % 3]) for i in range(len(names))])))
    taken, rows = {}, mixed.collect()
    for r in rows:
        assert whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
    assert all(abs(taken.get(n, 0) - goal[n]) <= 1 for n in names)
    # encoding: the library's ids, and they read back
    lib = sentencepiece.SentencePieceProcessor(model_file=spm.DEFAULT_MODEL)
    got = sorted((r.doc_id, tuple(r.ids)) for r in coded.collect())
    assert got == sorted((r.doc_id, tuple(lib.encode(r.text))) for r in rows)
    assert coded.filter("NOT round_trip").count() == 0


def test_run_equals_the_stages_and_odd_rows_pass(spark):
    docs(spark)
    a = sorted((r.doc_id, r.n_tokens) for r in cp.run(spark, SF001).collect())
    b = sorted((r.doc_id, r.n_tokens) for r in through(spark, read_table(spark, SF001, "documents"), cp.STAGES)[-1].collect())
    assert a == b
    odd = through(spark, docs(spark), cp.STAGES)
    assert odd[4].columns == odd[0].columns and odd[5].count() > 0
    assert through(spark, empty(spark), cp.STAGES)[-1].count() == 0
