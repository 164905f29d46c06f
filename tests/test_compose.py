"""The rate cascade fed from texts, and the slug rules, on given rows."""

from pyspark.sql import functions as F

from shiftscope.functions import text as T
from shiftscope.operators import pay

ROWS = [
    ("explicit", "Ставка 350 руб/час, график 2/2", None, None, None),
    ("per shift", "За смену 4200 руб, смена 12 часов, график 2/2", None, None, None),
    ("no length", "За смену 4200 руб", None, None, None),
    ("two lengths", "За смену 4200 руб, смена 12 часов или смена 8 часов", None, None, None),
    ("salary", "Дружный коллектив, график 2/2", None, 60.0, None),
    ("salary, own schedule", "Дружный коллектив", "5/2", 60.0, None),
    ("nothing", "Дружный коллектив", None, None, None),
    ("null", None, None, None, None),
]


def test_rates_come_from_the_text(spark):
    d = spark.createDataFrame(ROWS, "id string, t string, schedule string, salary_from_k double, salary_to_k double")
    got = {r.id: r for r in pay.text_rate(d, "t", "t", "t").collect()}
    assert set(got) == {r[0] for r in ROWS}
    assert (got["explicit"].hourly_rate, got["explicit"].hourly_method) == (350.0, "exact:explicit_hourly")
    assert got["explicit"].income_12h == 350.0 * 12 and got["explicit"].schedule_out == "2/2"
    per = got["per shift"]
    assert (per.hourly_rate, per.shift_len_out, per.income_12h) == (350.0, 12.0, 4200.0)
    assert per.hourly_method == "exact:shift_payment_div_shift_hours"
    assert got["no length"].hourly_method == "unresolved:shift_duration" and got["no length"].hourly_rate is None
    assert got["two lengths"].hourly_method == "unresolved:ambiguous_shift_duration"
    for k, sched in (("salary", "2/2"), ("salary, own schedule", "5/2")):
        assert got[k].hourly_method == "derived:salary_based" and got[k].hourly_rate > 0 and got[k].schedule_out == sched
    assert got["nothing"].hourly_method == got["null"].hourly_method == "unresolved:no_shift_payment"


def test_text_rate_does_not_shuffle(spark):
    d = spark.createDataFrame(ROWS, "id string, t string, schedule string, salary_from_k double, salary_to_k double")
    assert "Exchange" not in pay.text_rate(d, "t", "t", "t")._jdf.queryExecution().executedPlan().toString()


def test_each_board_has_its_slug_rule(spark):
    c = F.col("x")
    d = spark.createDataFrame([("Нижний Новгород",), ("Тверь",), ("",), (None,), ("Sales & IT",)], "x string").select(
        "x", T.region_slug(c).alias("r"), T.category_slug(c).alias("c"), T.city_subdomain(c).alias("s"), T.listing_city(c).alias("l"))
    got = {r.x: tuple(r)[1:] for r in d.collect()}
    assert got["Нижний Новгород"] == ("nizhniy_novgorod", None, "nizhnijnovgorod", "rossiya")
    assert got["Тверь"] == got[""] == got[None] == ("all", None, "", "rossiya")
    assert got["Sales & IT"] == ("sales_it", "sales_it", "", "rossiya")
