"""Working hours on the original pipeline's example contexts."""

from pyspark.sql import functions as F

from shiftscope.operators.hours import working_hours

SCHEMA = "id long, ctx int, text string, url string, selector string, weight int"


def _wh(spark, rows):
    c = spark.createDataFrame(rows, SCHEMA).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ctx", "text", "selector", "url", "weight"))).alias("contexts"))
    return {r["id"]: r for r in working_hours(c).collect()}


def test_week_hours(spark):
    r = _wh(spark, [(1, 0, "Пн–Пт 9:00–18:00, Сб 10–16, Вс выходной", "u", "desc", 10)])[1]
    days = {d["day"]: (d["start"], d["end"]) for d in r["normalized"]["by_days"]}
    assert days["Mon"] == ("09:00", "18:00") and days["Fri"] == ("09:00", "18:00")
    assert days["Sat"] == ("10:00", "16:00") and "Sun" not in days
    assert "Sun" in (r["notes"] or "") and r["lang"] == "ru" and r["confidence"] >= 0.9


def test_shift_schedule(spark):
    r = _wh(spark, [(1, 0, "График 2/2 по 12 часов", "u", "desc", 10)])[1]
    sb = r["normalized"]["shift_based"]
    assert sb["pattern"] == "2/2" and sb["shift_length_hours"] == 12.0 and r["confidence"] >= 0.5


def test_247_and_flexible(spark):
    got = _wh(spark, [(1, 0, "круглосуточно, без выходных", "u", "d", 1), (2, 0, "Гибкий график", "u", "d", 1)])
    assert got[1]["normalized"]["is_247"] and got[1]["confidence"] >= 0.9
    assert got[2]["normalized"]["by_days"] == [] and got[2]["confidence"] <= 0.5


def test_english_ampm(spark):
    r = _wh(spark, [(1, 0, "Mon–Fri 10am–7pm, Sat 10–4pm", "u", "d", 1)])[1]
    days = {d["day"]: (d["start"], d["end"]) for d in r["normalized"]["by_days"]}
    assert days["Mon"] == ("10:00", "19:00") and days["Sat"] == ("10:00", "16:00") and r["lang"] == "en"


def test_weight_conflict(spark):
    r = _wh(spark, [(1, 0, "Пн–Пт 9:00–18:00", "u", "footer", 2), (1, 1, "Пн–Пт 10:00–20:00", "u", "card", 12)])[1]
    days = {d["day"]: (d["start"], d["end"]) for d in r["normalized"]["by_days"]}
    assert days["Mon"] == ("10:00", "20:00")
    assert {s["selector"] for s in r["source"]} == {"footer", "card"}


def test_log_names_every_candidate_and_the_choice(spark):
    text = "О нас\nГрафик:\n2/2 по 12 часов\nПн–Пт 9:00–18:00\nПн–Пт 9:00–18:00"
    got = _wh(spark, [(1, 0, text, "u", "desc", 1), (1, 1, "Дружный коллектив", "u", "about", 9), (1, 2, None, "u", "none", 1), (2, 0, "тихо", "u", "x", 1)])
    log = got[1]["log"]
    assert [(e["selector"], e["raw"], e["reason"], e["chosen"]) for e in log] == [
        ("desc", "График: 2/2 по 12 часов", "schedule", False), ("desc", "2/2 по 12 часов", "schedule", False),
        ("desc", "Пн–Пт 9:00–18:00", "day-time", True), ("about", None, "no triggers", False), ("none", None, "no triggers", False)]
    assert got[1]["raw_matches"] == ["График: 2/2 по 12 часов", "2/2 по 12 часов", "Пн–Пт 9:00–18:00"] and got[1]["confidence"] == 1.0
    assert got[2]["raw_matches"] == [] and got[2]["confidence"] == 0.0 and not got[2]["log"][0]["chosen"]


def test_no_shuffle(spark):
    d = spark.createDataFrame([(1, [("Пн 9:00-18:00", "s", "u", 1)])], "id int, contexts array<struct<text:string,selector:string,url:string,weight:int>>")
    assert "Exchange" not in working_hours(d)._jdf.queryExecution().executedPlan().toString()


CONTEXTS = "id int, contexts array<struct<text:string,selector:string,url:string,weight:int>>"


def test_nothing_is_interpreted_row_by_row(spark):
    # the parse was some hundred nested lambdas, which have no generated code
    d = spark.createDataFrame([(1, [("Пн 9:00-18:00", "s", "u", 1)])], CONTEXTS)
    assert "lambda" not in working_hours(d)._jdf.queryExecution().optimizedPlan().toString()
    assert working_hours(d, facts=["log", "lang"]).columns == ["id", "lang", "log"]


def test_odd_texts(spark):
    rows = [(1, None), (2, []), (3, [None]), (4, [("График:\r1-го\n9-18 x10-19 й11-20 ½12-21", "s", None, None)]),
            (5, [("Пн. 10a.m.–7 p.m.; вс СУТКИ выходной", "s", "u", 1), ("Смена 8 часов, перерыв 1 час", "t", "u", 1)]),
            (6, [("п'ятниця с 9.30 до 25; Mon\u00a0—\u00a0Wed 22–6", "s", "u", 2), (None, "t", "u", 9)]), (7, [("смена 11,255 часов", "s", "u", 1)])]
    got = {r.id: r for r in working_hours(spark.createDataFrame(rows, CONTEXTS)).collect()}
    assert (got[1].raw_matches, got[1].log, got[1].confidence, got[2].log, got[2].raw_matches) == (None, None, 0.0, [], [])
    assert [(e.selector, e.reason) for e in got[3].log] == [(None, "no triggers")]
    assert [(e.raw, e.reason) for e in got[4].log] == [("График: 1-го 9-18 x10-19 й11-20 ½12-21", "section-range"), ("9-18 x10-19 й11-20 ½12-21", "schedule")]
    assert [(d.day, d.start, d.end) for d in got[5].normalized.by_days] == [("Mon", "10:00", "19:00")]
    assert (got[5].notes, got[5].normalized.shift_based) == ("Sun: closed", None)
    assert [(d.day, d.start, d.end) for d in got[6].normalized.by_days] == [(d, "22:00", "06:00") for d in ("Mon", "Tue", "Wed")]
    assert got[7].normalized.shift_based.shift_length_hours == 11.255
