"""Pay jobs on the original pipeline's example cases (FIXTURES.md §2)."""

from pyspark.sql import functions as F

from shiftscope.operators import extract as X
from shiftscope.operators import marts, pay


def _metrics(spark, rows):
    df = spark.createDataFrame(rows, "salary_from_k double, salary_to_k double, hourly double, "
                                     "shift_hours double, schedule string")
    return pay.pay_metrics(df).collect()


def test_monthly_formula(spark):
    r = _metrics(spark, [(90.0, None, None, 10.0, "5/2")])[0]
    assert r["hourly"] == 409.1 and r["income_12h"] == 4909.1


def test_unknown_schedule(spark):
    r = _metrics(spark, [(88.0, None, None, 8.0, "гибкий")])[0]
    assert r["hourly"] is None and r["income_12h"] is None


def test_missing_shift_length_filled_from_default(spark):
    r = _metrics(spark, [(60.0, None, None, None, "2/2")])[0]
    assert r["shift_hours"] == 12.0
    r = _metrics(spark, [(None, None, 350.0, None, None)])[0]
    assert r["shift_hours"] is None and r["income_12h"] == 4200.0


def _board(spark, rows):
    schema = ("external_id long, salary_from double, salary_to double, salary_period string, "
              "salary_currency string, schedule_hint string, shift_pattern string, "
              "shift_length_hours double, raw_matches array<string>")
    return spark.createDataFrame(rows, schema)


def test_shift_pay_to_month(spark):
    b = _board(spark, [(1, 4800.0, 4800.0, "per_shift", "RUB", "2/2", None, 12.0, ["2/2 по 12 часов"])])
    r = pay.monthly_pay(pay.shift_params(b), pay_from="salary_from", pay_to="salary_to").collect()[0]
    assert r["salary_from_k"] == 72.0 and r["salary_to_k"] == 72.0
    assert r["hourly_rate"] == 400.0 and r["shift_income"] == 4800.0


def test_non_rub_and_swap(spark):
    b = _board(spark, [(1, 2000.0, 1000.0, "per_month", "USD", "5/2", None, None, []),
                       (2, 2000.0, 1000.0, "per_month", None, "5/2", None, None, [])])
    out = {r["external_id"]: r for r in
           pay.monthly_pay(pay.shift_params(b), pay_from="salary_from", pay_to="salary_to").collect()}
    assert out[1]["salary_from_k"] is None and out[1]["hourly_rate"] is None
    assert out[2]["salary_from_k"] == 1.0 and out[2]["salary_to_k"] == 2.0


def test_hourly_share(spark):
    df = spark.createDataFrame([(400.0,)], "hourly double")
    r = marts.hourly_share(df).collect()[0]
    assert r["total"] == 1 and r["hourly_share_pct"] == 100.0


def _cascade(spark, text, pay_amount):
    df = spark.createDataFrame([(text, pay_amount)], "t string, shift_pay double")
    d = df.select(X.shift_length(F.col("t")).alias("s"), "shift_pay").select(
        F.lit(None).cast("double").alias("hourly"), "shift_pay", F.col("s.hours").alias("shift_len"),
        F.col("s.ambiguous").alias("shift_ambiguous"), F.col("s.confidence").alias("shift_confidence"),
        F.lit(None).cast("double").alias("salary_from_k"), F.lit(None).cast("double").alias("salary_to_k"),
        F.lit(None).cast("string").alias("schedule"))
    return pay.rate_cascade(d).collect()[0]


def test_time_range_rates(spark):
    assert _cascade(spark, "смена 08:00–20:00", 5500.0)["hourly_rate"] == 458.33
    assert _cascade(spark, "ночная смена 20:00–08:00", 6000.0)["hourly_rate"] == 500.0


def test_decimal_and_ambiguous(spark):
    r = _cascade(spark, "смены по 10,5 часов, оплата 4200", 4200.0)
    assert r["hourly_rate"] == 400.0 and r["hourly_method"] == "exact:shift_payment_div_shift_hours"
    r = _cascade(spark, "по 12 часов, ночные смены по 10 часов", 4200.0)
    assert r["hourly_rate"] is None and r["hourly_method"] == "unresolved:ambiguous_shift_duration"


def test_board_pipeline_example(spark):
    from pyspark.sql import functions as F

    from shiftscope.operators import marts
    from shiftscope.plans.q_board import normalize_board
    schema = ("external_id long, seq int, url_detail string, title string, employer_name string, location_city string, "
              "salary_from double, salary_to double, salary_currency string, salary_period string, schedule_hint string, "
              "shift_pattern string, shift_length_hours double, raw_matches array<string>, experience_raw string, "
              "employment_type string, duties_raw string, conditions_raw string, posted_date date")
    b = spark.createDataFrame([(111, 1, "https://www.avito.ru/x-111", "Бариста", None, "Москва", 4800.0, 4800.0, "RUB",
                                "per_shift", "2/2", None, 12.0, ["2/2 по 12 часов"], "Без опыта", "Полная занятость",
                                "Готовить кофе", "Питание; Форма", None)], schema)
    r = normalize_board(b).collect()[0]
    assert (r["salary_from_k"], r["salary_to_k"], r["hourly_rate"], r["shift_income"]) == (72.0, 72.0, 400.0, 4800.0)
    assert r["experience"] == "без опыта" and r["company"] == "Не указано" and r["conditions"] == "Питание; Форма"
    assert "часы/смену=12" in r["calc_notes"] and "График=2/2" in r["calc_notes"]
    share = marts.hourly_share(normalize_board(b), hourly="hourly_rate").collect()[0]
    assert share["total"] == 1 and share["hourly_share_pct"] == 100.0


def test_text_rate_reads_texts_outside_lambdas(spark):
    rows = [(1, "300 руб/час", "смена с 9:00 до 21:30", "график 2/2, вахта 15/15 или два через два", None), (2, "2500 за смену", "8 часов, потом 10 часов", "", "5/2"),
            (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, pay string, hours string, sched string, schedule string").selectExpr("*", "60D AS salary_from_k", "90D AS salary_to_k")
    d = pay.text_rate(df, "pay", "hours", "sched")
    # shift length and schedules were interpreted lambda by lambda
    assert "lambda" not in d.select("shift_len_out", "schedule_out")._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: (r.hourly_rate, r.hourly_method, r.shift_len_out, r.schedule_out) for r in d.collect()}
    assert got[1] == (300.0, "exact:explicit_hourly", 12.5, "2/2, 15/15") and got[3][2:] == (None, None)
    assert got[2] == (272.7, "derived:salary_based", 10.0, "5/2")
