"""Dates in words, configuration, schemaless payloads, navigation, windows:
small hand-written cases beside the oracle queries."""

import datetime as dt
import json

from pyspark.sql import functions as F

from shiftscope.operators import dates as D
from shiftscope.operators import navigate
from shiftscope.operators import relational as R
from shiftscope.session import shared_folder
from shiftscope.sources import files as FS
from shiftscope.streaming import upsert as S


def test_ranges_and_freshness(spark):
    rows = [("за 2 недели", 14.0), ("30", 30.0), ("последние 12 часов", 0.5), ("3 мес.", 90.0), ("0", None), ("все", None), (None, None), ("99999999999", None)]
    d = spark.createDataFrame([(r,) for r, _ in rows], "r string")
    assert [x[0] for x in d.select(D.range_days(F.col("r"))).collect()] == [v for _, v in rows]
    as_of = F.lit("2024-06-10 12:00:00").cast("timestamp_ntz")
    posts = spark.createDataFrame([(1, "5 минут назад"), (2, "12 мая"), (3, "1 июня"), (4, "когда-то"), (5, "12 декабря 2023 в 10:30")], "i int, raw string")
    fresh = D.fresh_range(posts.withColumn("at", D.relative_datetime(F.col("raw"), as_of)), F.col("at"), as_of, F.lit("за 2 недели"))
    got = {r["i"]: r["at"] for r in fresh.collect()}
    assert got == {1: dt.datetime(2024, 6, 10, 11, 55), 3: dt.datetime(2024, 6, 1), 4: None}


def test_iso_dates_keep_local_time(spark):
    d = spark.createDataFrame([("2024-06-01T10:00:00+03:00",), ("2024-06-01",), ("2024-13-01",), ("вчера 09:00",)], "r string")
    got = [r[0] for r in d.select(D.iso_or_relative(F.col("r"), F.lit("2024-06-10 12:00:00"))).collect()]
    assert got == [dt.datetime(2024, 6, 1, 10), dt.datetime(2024, 6, 1), None, dt.datetime(2024, 6, 9, 9)]


def test_configuration_from_json(spark):
    entries = {"2/2": {"hours_per_shift": 11}, "5/2": {"shifts_per_month": -3, "hours_per_shift": "x"}, "7/7": {"shifts_per_month": 15},
               "8/8": {}, "3/3": 5}
    for content in (entries, {"graph_schedule_defaults": entries, "city": "Москва"}):
        path = shared_folder(spark, "config-fixture")
        spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.text(path)
        cfg = {r["schedule"]: (r["shifts_per_month"], r["hours_per_shift"]) for r in R.schedule_config(spark, R.read_schedule_overrides(spark, path)).collect()}
        assert cfg["2/2"] == (15.0, 11.0) and cfg["5/2"] == (22.0, 8.0) and cfg["7/7"] == (15.0, 0.0) and cfg["3/3"] == (15.0, 12.0)
        assert "8/8" not in cfg and len(cfg) == 8


def test_payload_texts_without_a_schema(spark):
    rows = ['{"b":" x ","a":[1,"y",{"gross":true,"z":"q"},["k"," "]],"gross":false}', '"top"', '[{"gross":"text"},null,true]', "bad{", None, "{}",
            '{"s":"}{[\\"]"}', '[[[[["deep"]]]]]']
    d = spark.createDataFrame(list(enumerate(rows)), "i int, j string")
    got = [r["text"] for r in FS.flatten_variant(d, "j").orderBy("i").collect()]
    assert got == ["y gross q k x net", "top", "", "", "", "", '}{["]', "deep"]
    typed = spark.createDataFrame([({"t": "a", "s": {"gross": True, "n": "b"}, "l": ["c", " "]},)], "p struct<t:string,s:struct<gross:boolean,n:string>,l:array<string>>")
    flat = typed.select(FS.flatten_text(F.col("p"), typed.schema["p"].dataType, by_key=True).alias("a"), F.to_json("p").alias("j"))
    assert FS.flatten_variant(flat, "j").select(F.col("a") == F.col("text")).first()[0]


def test_paths_with_fallbacks(spark):
    rec = "struct<normalized:struct<hours:double,length:double>>"
    d = spark.createDataFrame([(1, ((None, 11.5),), "", "Тверь"), (2, ((0.0, None),), " Север ", None), (3, None, None, " ")], f"i int, w {rec}, area string, region string")
    table = [("i", ["i"], navigate.RAW), ("hours", ["w.normalized.hours", "w.normalized.length"], navigate.NUMBER), ("region", ["area", "region"], navigate.TEXT)]
    flat = navigate.flat(d, table)
    got = {r["i"]: (r["hours"], r["r"]) for r in flat.withColumn("r", navigate.pick_region(F.col("region"), None, "Москва")).collect()}
    assert got == {1: (11.5, "Тверь"), 2: (None, "Север"), 3: (None, "Москва")}


def test_rows_behind_the_watermark_change_nothing(spark):
    src, run = shared_folder(spark, "late-events"), S.new_run_dir(spark, "late")

    def land(rows):
        at = [(i, dt.datetime.fromisoformat(t), u, "view", 1.0, "p") for i, t, u in rows]
        spark.createDataFrame(at, S.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        return S.run_first_in_window(spark, src, run)

    land([(1, "2024-01-05T00:00:00", 7), (2, "2024-06-01T00:00:00", 7)])
    land([(3, "2024-06-02T00:00:00", 8)])          # the watermark moves on between runs
    log = land([(4, "2024-01-01T00:00:00", 7), (5, "2024-05-31T00:00:00", 7)])
    got = {(r["user_id"], r["event_id"]) for r in S.first_seen_window(spark, log).collect()}
    # event 4 is far behind: its window is closed; event 5 is late but inside the delay
    assert (7, 1) in got and (7, 4) not in got and (8, 3) in got and ((7, 5) in got) != ((7, 2) in got)
