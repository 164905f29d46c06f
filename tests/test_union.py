from shiftscope.operators.relational import union_sources


def test_union_of_sources_keeps_rank_and_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, t string")
    b = spark.createDataFrame([(2, 5.0)], "id int, pay double")
    got = {r.id: (r.t, r.pay, r.source_rank) for r in union_sources(a, b).collect()}
    assert got == {1: ("x", None, 0), 2: (None, 5.0, 1)}


def test_the_query_runs_the_operator(spark, monkeypatch):
    from conftest import SF001
    from shiftscope.operators import relational as R
    from shiftscope.plans.catalog import load_all
    calls = []
    monkeypatch.setattr(R, "union_sources", lambda *frames: calls.append(len(frames)) or union_sources(*frames))
    assert load_all()["union_sources"].build(spark, SF001).count() > 0
    assert calls == [3]
