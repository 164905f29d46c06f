from pyspark.sql import functions as F

from conftest import one_col
from shiftscope.operators import extract as X


def test_schedule_list(spark):
    got = one_col(spark, [
        "График 2-2 или пять через два, возможен сутки через трое",
        "два через два", "шесть через один", "четыре через три", "день через день",
        "Полная занятость", "Полный день", None], X.schedule_list)
    assert got == ["2/2, 5/2, 1/3", "2/2", "6/1", "4/3", "1/1", None, None, None]


def test_sane_schedule(spark):
    assert one_col(spark, ["2/2, 5/2", " 5/2 ", "гибкий", None], X.sane_schedule) == ["2/2, 5/2", "5/2", None, None]


def test_gross(spark):
    got = one_col(spark, ["Зарплата (до вычета НДФЛ)", "gross 180 000", "Брутто 200 000",
                          "на руки", "Net 140 000", ""], X.gross_flag)
    assert got == [True, True, True, False, False, False]


def test_rate_flags(spark):
    assert one_col(spark, ["Оплата 1200 руб/час", "Оклад 60 000 ₽ в месяц"], X.is_hourly_rate) == [True, False]
    assert one_col(spark, ["Смена 12ч — 3000 ₽", "$150 per shift guaranteed"], X.is_shift_rate) == [True, True]


def test_shift_length(spark):
    got = one_col(spark, ["Смены по 11 часов, график 2/2", "с 9:00 до 21:00", "12-часовая смена",
                          "Перерыв 1 час, смена 8 часов", "Опыт работы от 1 до 3 лет",
                          "ночная смена с 20:00 до 08:00", "смены по 10,5 часов, оплата 4200",
                          "по 12 часов, ночные смены по 10 часов"], X.shift_length)
    hours = [r["hours"] for r in got]
    assert hours[:4] == [11.0, 12.0, 12.0, 8.0]
    assert hours[4] is None and got[4]["source"] == "unresolved"
    assert hours[5] == 12.0
    assert hours[6] == 10.5
    assert got[7]["ambiguous"] is True


def test_experience(spark):
    got = one_col(spark, ["Без опыта", "Опыт работы от 1 до 3 лет", "опыт от 3 лет", "Опыт работы более 6 лет",
                          "не требуется", None], X.experience_bucket)
    assert got == ["без опыта", "1-3", "3-6", "6+", "без опыта", ""]
    got = one_col(spark, ["Без опыта", "Опыт работы от 3 лет", "опыт 1 год", "от 2 лет опыта",
                          "опыт полгода", "нужен опыт", "", "6 месяцев опыт"], X.experience_phrase)
    assert got == ["Без опыта", "от 3 года", "1 год", "от 2 года", "от 0.5 года", "Опыт требуется", None, "6 месяцев"]


def test_categorical(spark):
    assert one_col(spark, ["Выплаты еженедельно", "аванс", "ежемесячно", "x"], X.pay_frequency) == [
        "Еженедельно", "2 раза в месяц", "Ежемесячно", None]
    assert one_col(spark, ["ГПХ", "официальное трудоустройство", "x"], X.employment_type) == ["ГПХ", "ТК", None]
    assert one_col(spark, ["Удаленно", "гибрид", "Вахта", "офис", ""], lambda c: X.work_format([c])) == [
        "удаленно", "гибрид", "вахта", "офис", ""]
    assert one_col(spark, ["Привет", "hello", "Привіт", "123"], X.script_lang) == ["ru", "en", "uk", None]


def test_benefits(spark):
    assert one_col(spark, ["ДМС, бесплатное питание и форма", "ничего"], X.benefit_tags) == [
        "ДМС, питание, бесплатное питание, форма", None]


def test_explicit_pay(spark):
    got = one_col(spark, ["Оплата 1200 руб/час", "за смену 3500 руб", "Оклад 60 000 в месяц, 350 в час"],
                  X.explicit_pay)
    assert got[0]["hourly"] == 1200.0 and got[0]["shift_pay"] is None
    assert got[1]["shift_pay"] == 3500.0
    assert got[2]["hourly"] is None


def test_duties(spark):
    rows = ["Обязанности: готовить; мыть. Требования: опыт", "- выкладка - касса", "просто текст"]
    d = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = [r.out for r in X.with_duties(d, "t", out="out").orderBy("i").collect()]
    assert got == ["готовить; мыть.", "выкладка - касса", "просто текст"]


def test_relative_dates(spark):
    df = spark.createDataFrame([(0, "сегодня в 10:15"), (1, "вчера"), (2, "3 часа назад"), (3, "2 дня назад"),
                                (4, "1 неделю назад"), (5, "12.05.24"), (6, "31.02.2024"), (7, "")],
                               "i int, t string")
    as_of = F.to_timestamp(F.lit("2024-06-10 15:00:00"))
    got = [r[0] for r in df.orderBy("i").select(X.relative_datetime(F.col("t"), as_of).cast("string")).collect()]
    assert got == ["2024-06-10 10:15:00", "2024-06-09 00:00:00", "2024-06-10 12:00:00", "2024-06-08 00:00:00",
                   "2024-06-03 00:00:00", "2024-05-12 00:00:00", None, None]


def _rate(spark, text):
    df = spark.createDataFrame([("u", text)], "url string, text string")
    return {r["type"]: r for r in X.rate_mentions(df).collect()}


def test_rate_values(spark):
    cases = ["1200 руб/час + %", "1500-2000 руб/ч", "$15-18 per hour", "от 1 200 до 1 600 за смену", "€12/hour"]
    df = X.with_rate_parse(spark.createDataFrame(list(enumerate(cases)), "i int, t string"), "t").withColumnRenamed("_x", "x")
    got = [(r["v"], r["mn"], r["mx"], r["c"]) for r in df.orderBy("i").select(
        X.rate_value(F.col("x")).alias("v"), F.col("x.min").alias("mn"), F.col("x.max").alias("mx"),
        X.currency(F.regexp_extract(F.col("x.seg"), X.U + "(?:" + X.lx.CURRENCY_TOKEN_RE + ")", 0)).alias("c")).collect()]
    assert got[0] == ("1200 ₽ + %", 1200.0, 1200.0, "RUB")
    assert got[1] == ("1500–2000 ₽", 1500.0, 2000.0, "RUB")
    assert got[2] == ("$15–18", 15.0, 18.0, "USD")
    assert got[3][1:] == (1200.0, 1600.0, None)
    assert got[4] == ("€12", 12.0, 12.0, "EUR")


def test_both_rate_kinds(spark):
    got = _rate(spark, "Оплата 1800/смена или 200/час")
    assert got["hourly"]["min"] == 200.0 and got["shift"]["min"] == 1800.0


def test_benefit_lines_and_join_unique(spark):
    got = one_col(spark, ["- Бесплатные обеды\n• Форма\nДружный коллектив\n  - оплата проезда"], X.benefit_lines)
    assert got == [["Бесплатные обеды", "Форма", "оплата проезда"]]
    df = spark.createDataFrame([(["ДМС", " дмс ", "<b>Питание</b>", "", "питание", "Форма"],)], "a array<string>")
    assert df.select(X.join_unique(F.col("a"))).collect()[0][0] == "ДМС; Питание; Форма"
