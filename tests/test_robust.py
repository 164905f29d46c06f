"""Odd single rows must not fail a job, and nothing may be cut or dropped."""

from pyspark.sql import functions as F

from conftest import SF001
from shiftscope.operators import extract as X
from shiftscope.operators import pay
from shiftscope.plans.catalog import load_all
from shiftscope.session import shared_folder
from shiftscope.sources import files as FS
from shiftscope.sources import html_parse as H
from shiftscope.sources import pages as PG
from shiftscope.streaming import upsert as S

REG = load_all()

DETAIL = """<html lang="ru"><h1>Повар</h1><span data-marker="item-view/total">просмотров: 99999999999</span><ul>
<li data-marker="item-params/list-item"><span class="x-label">График:</span><span class="x-value">2/2</span></li>
<li data-marker="item-params/list-item"><span class="x-label">График:</span><span class="x-value">5/2</span></li>
<li data-marker="item-params/list-item"><span class="x-value">один</span></li>
<li data-marker="item-params/list-item"><span class="x-value">два</span></li></ul></html>"""


def test_repeated_labels_and_long_counts(spark):
    pages = spark.createDataFrame([(1, "u", DETAIL), (2, "u", None), (3, "u", "<p>unclosed <b")], "page_id long, url string, html string")
    got = {r.page_id: r for r in H.detail_fields(H.parse(pages)).collect()}
    assert got[1].params["график"] == "5/2" and got[1].params[""] == "два"
    assert got[1].views_count == 99999999999
    assert 3 in got


def test_nested_list_items_are_lines_of_their_own(spark):
    html = "<div><h2>Условия</h2><ul><li>один<ul><li>внутри</li></ul></li><li>два</li></ul></div>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    text = H.sections(H.parse(pages), "page_id").collect()[0].text
    assert text.split("\n") == ["один внутри", "внутри", "два"]


def test_numbers_beyond_their_type(spark):
    d = spark.createDataFrame([(t,) for t in ("99999999999 часов назад", "99999999999 дней назад", "2000000000 недель назад", "5 часов назад")], "t string")
    out = [r[0] for r in d.select(X.relative_datetime(F.col("t"), F.lit("2024-05-10 12:00:00").cast("timestamp_ntz"))).collect()]
    assert out[:3] == [None, None, None] and out[3] is not None
    ago = spark.createDataFrame([(t,) for t in ("2000000000 дней назад", "2000000000 часов назад", "999999999999 минут назад", "01.02.99999", "32 мая")], "t string")
    assert {r[0] for r in ago.select(X.relative_datetime(F.col("t"), F.lit("2024-05-10 12:00:00"))).collect()} == {None}
    s = spark.createDataFrame([("смена ١٢ часов",), ("смена 12 часов",)], "t string")
    hours = [r[0] for r in s.select(X.shift_length(F.col("t"))["hours"]).collect()]
    assert hours[1] == 12.0


def test_experience_reads_whole_numbers(spark):
    d = spark.createDataFrame([("от 15 лет",), ("от 1 года",), ("от 3 лет",)], "t string")
    assert [r[0] for r in d.select(X.experience_bucket(F.col("t"))).collect()] == ["6+", "1-3", "3-6"]


def test_duties_are_returned_whole(spark):
    body = "дело " * 2000
    d = spark.createDataFrame([(f"Обязанности: {body}",)], "t string")
    assert len(X.with_duties(d, "t", out="out").collect()[0]["out"]) > 9000


def test_jsonld_type_lists_and_text_amounts(spark):
    html = ('<script type="application/ld+json">{"@type":["JobPosting","X"],"title":"T","baseSalary":{"value":{"minValue":"50000","maxValue":70000}}}'
            '</script>')
    pages = spark.createDataFrame([(1, html), (2, html.replace('["JobPosting","X"]', '"JobPosting"'))], "page_id long, html string")
    rows = PG.jsonld_postings(pages).collect()
    assert len(rows) == 2 and all(50.0 in list(r) and 70.0 in list(r) for r in rows)


def test_negative_salaries_are_noted(spark):
    d = spark.createDataFrame([(-5.0, 10.0, "per_month", "RUB", None, None)],
                              "salary_from double, salary_to double, salary_period string, salary_currency string, salary_from_k double, salary_to_k double")
    assert any("< 0" in n for n in pay.salary_notes(d).collect()[0].salary_notes)


def test_landed_files_do_not_disturb_each_other(spark):
    a, b = REG["csv_roundtrip"].build(spark, SF001), REG["report_read"].build(spark, SF001)
    assert a.count() == b.count() > 0


def test_pages_past_the_reported_count_are_not_read(spark):
    item = {"id": "1", "name": "x"}
    path = shared_folder(spark, "search-fixture")
    spark.createDataFrame([(0, 2, [item]), (1, 2, [item]), (2, 2, [item])], "page int, pages int, items array<map<string,string>>").write.json(path)
    assert FS.explode_items(FS.read_search_pages(spark, path)).count() == 2
    hh = REG["hh_postings"].build(spark, SF001)
    from shiftscope.sources.postings import postings
    assert hh.count() == postings(spark, SF001).filter("source = 'hh.ru'").count()


def test_streams_read_folders_of_part_files(spark):
    path = shared_folder(spark, "events-parts")
    spark.read.parquet(f"{SF001}/events.parquet").repartition(5).write.parquet(path)
    log = S.run_state_stream(spark, path, S.new_run_dir(spark, "t"), max_files_per_trigger=2)
    want = {tuple(r) for r in REG["event_state_batch"].build(spark, SF001).collect()}
    assert {tuple(r) for r in S.current_state(spark, log).collect()} == want
    seen = S.first_seen(spark, S.run_first_seen(spark, path, S.new_run_dir(spark, "t")))
    assert {tuple(r) for r in seen.collect()} == {tuple(r) for r in REG["first_seen_events"].build(spark, SF001).collect()}


def test_anti_join_is_stable_without_urls(spark):
    from shiftscope.operators.relational import drop_shift_rated
    d = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "u"), (4, "v")], "posting_id int, url string")
    rates = spark.createDataFrame([("shift", "u")], "type string, url string")
    assert sorted(r.posting_id for r in drop_shift_rated(d, rates).collect()) == [1, 1, 2, 4]
