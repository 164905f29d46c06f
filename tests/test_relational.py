"""Relational jobs: original examples and invariants."""

from pyspark.sql import functions as F

from conftest import SF001
from shiftscope.operators import relational as R
from shiftscope.plans.catalog import load_all
from shiftscope.sources.postings import postings


def test_anti_join_keeps_hourly_and_null(spark):
    posts = spark.createDataFrame([("a",), ("b",), (None,), ("",)], "url string")
    rates = spark.createDataFrame([("shift", "a"), ("hourly", "b")], "type string, url string")
    got = sorted(r[0] or "-" for r in R.drop_shift_rated(posts, rates).collect())
    assert got == ["-", "-", "b"]


def test_last_sighting_wins_and_flags(spark):
    rows = [(111, 1, False, True, False, 4800.0), (111, 2, False, False, False, 5200.0),
            (222, 1, False, False, True, 350.0), (333, 1, True, False, False, None),
            (444, 1, False, True, False, 1.0), (444, 2, True, False, False, None), (444, 3, False, False, False, 2.0)]
    df = spark.createDataFrame(rows, "external_id long, seq int, failed boolean, is_promoted boolean, "
                                     "is_featured boolean, salary_from double")
    out = {r["external_id"]: r for r in R.posting_state(df, record_cols=["salary_from"]).collect()}
    assert out[111]["salary_from"] == 5200.0 and out[111]["is_promoted"] and out[111]["repeats"] == 1
    assert out[222]["is_featured"] and not out[222]["is_promoted"]
    assert out[333]["is_active"] is False and out[333]["salary_from"] is None
    # promoted only before a failure: lost after the stub
    assert out[444]["is_promoted"] is False and out[444]["salary_from"] == 2.0


def test_completeness_merge_tie_goes_to_later(spark):
    df = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", None), (1, 3, None, None)],
                               "k long, seq int, x string, y string")
    r = R.best_record(df, F.col("k"), ["x", "y"]).collect()[0]
    assert r["x"] == "b"


def test_dedup_idempotent_and_order_free(spark):
    p = postings(spark, SF001).select("posting_id", "seq", "title", "employer", R.url_canon(F.col("url")).alias("url"))
    once = R.dedup_first(p)
    twice = R.dedup_first(once)
    assert once.count() == twice.count()
    shuffled = R.dedup_first(p.repartition(7, "title"))
    assert sorted(r[0] for r in once.select("posting_id").collect()) == \
        sorted(r[0] for r in shuffled.select("posting_id").collect())


def test_anti_plus_semi_is_input(spark):
    p = postings(spark, SF001).select("posting_id", "url")
    rates = p.where(F.col("posting_id") % 3 == 0).select(F.lit("shift").alias("type"), "url")
    anti = R.drop_shift_rated(p, rates).count()
    keys = rates.select(F.trim("url").alias("_u")).where(F.col("_u") != "").distinct()
    semi = p.withColumn("_u", F.trim("url")).join(keys, "_u", "left_semi").count()
    assert anti + semi == p.count()


def test_url_canon_idempotent(spark):
    q = load_all()["url_canon"].build(spark, SF001)
    assert q.where(~F.col("url_canon").eqNullSafe(F.col("url_canon2"))).count() == 0


def test_shares_sum_to_100(spark):
    for name in ("exp_share", "format_share"):
        s = load_all()[name].build(spark, SF001).agg(F.sum("share_pct")).collect()[0][0]
        assert abs(s - 100.0) < 0.5
