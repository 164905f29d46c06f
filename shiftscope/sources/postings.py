"""Postings view derived from the driver tables.

The driver data hold no vacancies, so a postings table is derived
deterministically from ``lineitem ⋈ supplier ⋈ nation ⋈ part ⋈ orders``.
Every column is a pure function of the joined row, so the same view can
be stated in SQL for the DuckDB oracle (``plans.oracle.POSTINGS_SQL``).

Scale notes: only the 7 lineitem columns the view needs are read
(column pruning reaches the parquet scan).  ``supplier`` meets ``nation``
before the lines, so no join of lines runs on 25 keys; AQE turns joins
into broadcasts when a side is small at runtime (it checks the real size;
no hint is forced on a table that grows with the scale factor).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import compile_wide_rows, read_table

SEQ_FIELDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
              "l_quantity", "l_extendedprice", "l_shipdate"]


def _s(c: Column) -> Column:
    return c.cast("string")


def _case(key: Column, values: list, default=None) -> Column:
    """CASE key WHEN 0 THEN values[0] ... ELSE default."""
    expr = None
    for i, v in enumerate(values):
        lit = v if isinstance(v, Column) else F.lit(v)
        expr = F.when(key == i, lit) if expr is None else expr.when(key == i, lit)
    d = default if isinstance(default, Column) else F.lit(default)
    return expr.otherwise(d)


def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines meet parts and suppliers as narrow rows; then they are partitioned
    by order, once: the orders join, jobs that group by order and the row-wise
    text work that follows all run on that partitioning.  Its count is given
    (the session's), since the text work is far heavier than the bytes that
    adaptive coalescing would go by."""
    li = read_table(spark, sf_dir, "lineitem").select(*SEQ_FIELDS)
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    home = supp.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = (li.join(part, F.col("l_partkey") == F.col("p_partkey"))
               .join(home, F.col("l_suppkey") == F.col("s_suppkey"))
               .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("l_orderkey")))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem; see module doc and FIXTURES.md §4."""
    compile_wide_rows(spark)
    j = joined_lines(spark, sf_dir)
    ok, ln, pk, sk = (F.col("l_orderkey"), F.col("l_linenumber"),
                      F.col("l_partkey"), F.col("l_suppkey"))
    q = F.col("l_quantity").cast("int")
    pid = ok * 100 + ln
    source = _case(ln % 3, ["hh.ru", "avito.ru"], "gorodrabot.ru")
    salary_from = F.when(pk % 5 == 0, None).otherwise((q * 2000 + 20000).cast("double"))
    salary_to = F.when(pk % 7 == 0, None).otherwise((q * 2500 + 30000).cast("double"))
    description = F.concat(
        F.lit("Оплата "), _s(q * 10 + 150),
        F.when(ln % 2 == 0, F.lit(" руб/час")).otherwise(F.lit(" ₽ за смену")),
        F.lit(", график "), _s(sk % 5 + 1), F.lit("/"), _s(sk % 3 + 1),
        F.lit(" по "), _s(pk % 5 + 8), F.lit(" часов"))
    experience_raw = _case(ok % 7, ["Без опыта", "Опыт работы от 1 до 3 лет", "опыт от 3 лет",
                                    "Опыт работы более 6 лет", "не требуется", "Опыт от 2 лет"])
    employment_raw = _case(sk % 4, ["Полная занятость, оформление по ТК", "Частичная занятость",
                                    "ГПХ, самозанятость"])
    pay_text = _case(pk % 6, ["Выплаты еженедельно", "Аванс и зарплата 2 раза в месяц",
                              "Зарплата ежемесячно", "Зарплата до вычета НДФЛ", "Сумма на руки"])
    format_text = _case(ok % 5, ["Работа в офисе", "Удаленно", "Гибридный формат", "Вахта"])
    benefits = _case((pk + sk) % 5, ["ДМС; питание, форма", "питание; Развозка",
                                     "ДМС, обучение, скидки", "• ДМС ; - питание"])
    hours_text = _case(pk % 7, ["Смена с 9:00 до 21:00", "ночная смена с 20:00 до 08:00",
                                "Пн–Пт 9:00–18:00, Сб 10–16, Вс выходной",
                                "Перерыв 1 час, смена 8 часов", "круглосуточно, без выходных",
                                "Гибкий график"])
    duties_raw = _case(pk % 3, ["Обязанности: приготовление блюд; уборка рабочего места. Требования: аккуратность",
                                "- выкладка товара - работа с кассой"])
    posted_raw = _case(ok % 6, [F.concat(F.lit("сегодня в "), _s(ln + 8), F.lit(":30")), F.lit("вчера"),
                                F.concat(_s(ln), F.lit(" часов назад")), F.concat(_s(ln), F.lit(" дней назад")),
                                F.concat(_s(ln), F.lit(" недели назад"))],
                       F.concat(_s(ln + 10), F.lit(".0"), _s(sk % 9 + 1), F.lit(".24")))
    host = _case(ln % 4, ["www.", "m.", ""], "www.www.")
    path = (F.when(source == "hh.ru", F.concat(F.lit("/vacancy/"), _s(pid)))
             .when(source == "avito.ru",
                   F.concat(F.lit("/"), F.replace(F.lower(F.col("n_name")), F.lit(" "), F.lit("-")),
                            F.lit("/vakansii/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")),
                            F.lit("-"), _s(pid)))
             .otherwise(F.concat(F.when(pk % 9 == 0, F.lit("/company/")).otherwise(F.lit("/vacancy/")),
                                 F.replace(F.col("p_name"), F.lit(" "), F.lit("-")),
                                 F.lit("-"), _s(pid))))
    suffix = _case(pk % 3, ["", F.concat(F.lit("?utm_source=feed&page="), _s(ln))], "#details")
    url = F.when(ok % 50 == 0, None).otherwise(
        F.concat(F.when(pk % 2 == 0, F.lit("https://")).otherwise(F.lit("http://")),
                 host, source, path, suffix))
    period_key = (ok + ln) % 5
    period = _case(period_key, ["per_shift", "per_hour", "per_day", "per_week"], "per_month")
    pay_from = F.when(pk % 5 == 0, None).otherwise(
        _case(period_key, [q * 100 + 2000, q * 10 + 150, q * 100 + 2500, q * 500 + 10000],
              q * 2000 + 20000).cast("double"))
    pay_to = F.when(pk % 7 == 0, None).otherwise(
        _case(period_key, [q * 120 + 2500, q * 12 + 200, q * 120 + 3000, q * 600 + 12000],
              q * 2500 + 30000).cast("double"))
    currency = F.when(pk % 11 == 0, "USD").when(pk % 11 == 1, None).otherwise("RUB")
    return j.select(
        pid.alias("posting_id"),
        F.struct(*SEQ_FIELDS).alias("seq"),
        source.alias("source"),
        F.col("p_name").alias("title"),
        F.when(pk % 17 == 0, None).otherwise(F.col("s_name")).alias("employer"),
        F.col("n_name").alias("city"),
        F.col("o_orderdate").cast("date").alias("posted_date"),
        salary_from.alias("salary_from"),
        salary_to.alias("salary_to"),
        (salary_from / 1000.0).alias("salary_from_k"),
        (salary_to / 1000.0).alias("salary_to_k"),
        F.when(ln % 2 == 0, (q * 10 + 150).cast("double")).alias("hourly"),
        _case(sk % 6, ["2/2", "5/2", "3/3", "6/1", "2/2, 5/2"]).alias("schedule"),
        _case(pk % 4, [8.0, 10.0, 12.0]).cast("double").alias("shift_hours"),
        description.alias("description"),
        experience_raw.alias("experience_raw"),
        employment_raw.alias("employment_raw"),
        pay_text.alias("pay_text"),
        format_text.alias("format_text"),
        benefits.alias("benefits"),
        hours_text.alias("hours_text"),
        F.concat_ws(". ", description, experience_raw, employment_raw, pay_text,
                    format_text, hours_text).alias("full_text"),
        duties_raw.alias("duties_raw"),
        posted_raw.alias("posted_raw"),
        url.alias("url"),
        period.alias("salary_period"),
        currency.alias("salary_currency"),
        pay_from.alias("pay_from"),
        pay_to.alias("pay_to"),
    )
