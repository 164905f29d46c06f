"""Plans that must hold at every size: what is joined and dealt once."""

from __future__ import annotations

import re

from conftest import SF001
from pyspark.sql import functions as F

from shiftscope.operators import extract as X
from shiftscope.operators import relational as R
from shiftscope.plans.catalog import load_all


def _plan(spark, name, sf_dir):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        return load_all()[name].build(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_listing_pages_are_not_dealt_again(spark):
    """Without broadcasts the cards of a listing page meet where the orders
    join left them: no exchange between that join and their grouping."""
    plan = _plan(spark, "board_links", SF001)
    above_join = plan[:plan.index("SortMergeJoin [l_orderkey")]
    # the only exchange above is that of the distinct links
    assert len(re.findall(r"Exchange hashpartitioning", above_join)) == 1 and "hashpartitioning(page_id" in above_join


def _carried(df) -> str:
    return "\n".join(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x)


def test_title_statistics_carry_no_texts(spark):
    # the merge per posting carried every column of the row, though titles and amounts are read
    plan = _carried(load_all()["board_job_stats"].build(spark, SF001))
    assert "max_by" in plan and "named_struct(title" in plan.replace("struct(title", "named_struct(title")
    carried = plan[plan.index("max_by("):].split(", struct(f")[0]
    assert "calc_notes" not in carried and "conditions" not in carried and "seq" not in carried


def test_best_record_weighs_columns_that_it_does_not_keep(spark):
    df = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, None), ("b", 1, "p", "q"), ("b", 2, "r", "s")], "k string, seq int, x string, y string")
    got = {tuple(r) for r in R.best_record(df, F.col("k"), ["x", "y"], columns=["k", "x"]).collect()}
    assert got == {("a", "x"), ("b", "r")}


def test_export_chain_carries_no_clauses(spark):
    # the rate clauses went through the shuffle, though only their URLs and types are read
    plan = _carried(load_all()["export_rows"].build(spark, SF001))
    assert "r_value" not in plan and "segment" not in plan


def test_rate_mentions_of_named_columns(spark):
    df = spark.createDataFrame([("u", "Оплата 1800/смена или 200/час"), ("v", "за смену"), ("w", "  \t"), (" ", "5 в час"), (None, "5 в час"), ("x", None)],
                               "url string, text string")
    assert {tuple(r) for r in X.rate_mentions(df, columns=()).collect()} == {("u", "hourly"), ("u", "shift")}
    assert {(r.url, r.type, r["min"]) for r in X.rate_mentions(df, columns=["min"]).collect()} == {("u", "hourly", 200.0), ("u", "shift", 1800.0)}
    assert {tuple(r[:2]) for r in X.rate_mentions(df).collect()} == {("u", "hourly"), ("u", "shift")}


def test_rate_markers_are_staged_before_they_are_exploded(spark):
    # a generator's input is interpreted
    df = spark.createDataFrame([("u", "200 в час")], "url string, text string")
    lines = X.rate_segments(df)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert [x for x in lines if "Generate explode" in x and "contains" in x.lower()] == []
