"""Operators put together, and rules on values that take each of their
branches: the rate cascade fed from texts (T3, T4, T5 -> M3), slugs (P8),
benefit lines (T10), role filters (F1) and currencies (T2).

The given tables hold no Russian names; where a rule needs some, a key
picks one of a short list, stated alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import text as T
from ..functions.lookups import currency_code
from ..operators import extract as X
from ..operators import pay
from ..operators.filters import role_condition
from ..session import read_table
from ..sources.postings import postings
from .catalog import register
from .oracle import case_map, sql_str, with_postings
from .q_board import CASCADE_CTE, CASCADE_SQL
from .q_relational import role_cond_sql
from .q_text import EXPLICIT_PAY_CTE, SCHED_CTE, SHIFT_LEN_CTE


def pick(values: list[str | None], key: Column) -> Column:
    """The value that ``key`` deals (NULL and its value never mix up)."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values)).cast("int"))


def pick_sql(values: list[str | None], key: str) -> str:
    return f"[{', '.join(sql_str(v) for v in values)}][{key} % {len(values)} + 1]"


# ------------------------------------------------------------------ T3/T4/T5 -> M3 --
@register("text_rate", with_postings(CASCADE_SQL, EXPLICIT_PAY_CTE, SHIFT_LEN_CTE, SCHED_CTE, """m3a AS (
  SELECT p.posting_id, CASE WHEN h0 <> 0 THEN round_even(h0, 2) END AS exp_h, p.salary_from_k, p.salary_to_k,
    coalesce(sched.schedules, p.schedule) AS schedule, CASE WHEN s0 <> 0 THEN round_even(s0, 2) END AS pay,
    CASE WHEN b.w > -1.0 THEN b.h END AS slen, coalesce(b.w > -1.0 AND l.amb, false) AS amb,
    CASE WHEN b.w > -1.0 THEN (CASE WHEN l.amb THEN 'medium' ELSE b.conf END) ELSE 'low' END AS conf
  FROM postings p JOIN ep2 ON p.seq = ep2.seq JOIN sched ON p.seq = sched.seq LEFT JOIN sl_best l ON p.seq = l.seq)""", CASCADE_CTE))
def q_text_rate(spark, sf_dir):
    """Hourly rate, its method and the 12-hour income, all from the texts."""
    p = postings(spark, sf_dir).select("posting_id", "full_text", "schedule", "salary_from_k", "salary_to_k",
                                       F.concat_ws(". ", "hours_text", "description").alias("hours_source"))
    d = pay.text_rate(p, "full_text", "hours_source", "full_text")
    return d.select("posting_id", "hourly_rate", "hourly_method", F.col("shift_len_out").alias("shift_len"), "income_12h")


# ------------------------------------------------------------------ P8 ----
PLACES = ["Москва", " Moscow ", "Санкт-Петербург", "СПб", "spb", "Казань", "Ростов на Дону", "Нижний Новгород", "New  York--City 2",
          "", "Тверь", "ekaterinburg", None, "__", "Красноярск", "Омск"]


def _collapsed_sql(t: str) -> str:
    return f"nullif(trim(regexp_replace({t}, '[^0-9a-z]+', '_', 'g'), '_'), '')"


def _known_sql(pairs) -> str:
    return case_map("lower(trim(place))", [(k, sql_str(v)) for k, v in pairs])


@register("slug_rules",
          "SELECT c_custkey, place, coalesce(" + _known_sql(lx.REGION_SLUGS) + f", {_collapsed_sql('lower(trim(place))')}, 'all') AS region,"
          f" {_collapsed_sql('lower(trim(place))')} AS category, coalesce(" + _known_sql(lx.CITY_SLUGS) + ", '') AS subdomain,"
          " coalesce(" + _known_sql(lx.LISTING_CITIES) + ", 'rossiya') AS listing"
          f" FROM (SELECT c_custkey, {pick_sql(PLACES, 'c_custkey')} AS place FROM customer)")
def q_slug_rules(spark, sf_dir):
    """One place name, four boards' ways to put it into a path."""
    c = F.col("place")
    d = read_table(spark, sf_dir, "customer").select("c_custkey", pick(PLACES, F.col("c_custkey")).alias("place"))
    return d.select("c_custkey", "place", T.region_slug(c).alias("region"), T.category_slug(c).alias("category"),
                    T.city_subdomain(c).alias("subdomain"), T.listing_city(c).alias("listing"))


# ------------------------------------------------------------------ T10 ---
_LINES_SQL = "concat_ws(chr(10), duties_raw, ' - ' || replace(benefits, ';', chr(10) || '• '), 'Сменный график' || chr(13) || hours_text)"


@register("benefit_lines", with_postings(
    "SELECT posting_id, array_to_string(list_filter(list_transform(string_split_regex("
    f"{_LINES_SQL}, '\\r?\\n|\\r'), lambda s: trim(s, ' -•' || chr(9))), lambda s: s <> '' AND regexp_matches(lower(s),"
    " '(питани|обеды|форма|медкниж|страхов|проезд|сменн[0-9a-zа-яё_]* график)')), '|') AS lines FROM postings"))
def q_benefit_lines(spark, sf_dir):
    """The lines of the conditions that speak of a benefit."""
    text = F.concat_ws("\n", "duties_raw", F.concat(F.lit(" - "), F.replace(F.col("benefits"), F.lit(";"), F.lit("\n• "))),
                       F.concat(F.lit("Сменный график\r"), F.col("hours_text")))
    return postings(spark, sf_dir).select("posting_id", F.array_join(X.benefit_lines(text), "|").alias("lines"))


# ------------------------------------------------------------------ F1 ----
TITLES = ["Повар", "Повар холодного цеха", "Повар горячего цеха", "Повар горячего цеха, бармен", "Шеф-повар на АЗС", "Оператор доставки", "Сборщик заказов",
          "Продавец-кассир", "Продавец-консультант", "Старший кассир, бариста", "Менеджер по разработке продукта", "Менеджер, разработка продукта",
          "Менеджер разработки меню IT", "Бариста", "Официант", "Водитель", "Администратор ресторана", "Кладовщик", None]


@register("role_titles", with_postings(
    "SELECT role, title, count(*) AS n FROM (SELECT title, unnest(list_filter(["
    + ", ".join(f"CASE WHEN {role_cond_sql('lower(coalesce(title, chr(32)))', r)} THEN {sql_str(name)} END" for name, r in lx.ROLE_FILTERS.items())
    + ", 'any'], lambda x: x IS NOT NULL)) AS role"
    f" FROM (SELECT {pick_sql(TITLES, 'seq.l_partkey')} AS title FROM postings)) GROUP BY role, title"))
def q_role_titles(spark, sf_dir):
    """Titles kept by each role's filter, with include and exclude patterns
    both at work."""
    p = postings(spark, sf_dir).select(pick(TITLES, F.col("seq.l_partkey")).alias("title"))
    roles = F.array_compact(F.array(*[F.when(role_condition(F.col("title"), r), F.lit(r)) for r in lx.ROLE_FILTERS], F.lit("any")))
    return p.select("title", F.explode(roles).alias("role")).groupBy("role", "title").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ T2 ----
TOKENS = ["₽", "руб.", "RUR", "$", "usd", "€", "EUR", "грн", "₴", "₸", "kzt", "BYN", "£", "gbp", "chf", "", None]


@register("currency_codes", with_postings(
    "SELECT posting_id, token, CASE WHEN trim(coalesce(token, '')) = '' THEN NULL ELSE coalesce("
    + case_map("lower(trim(token))", [(k, sql_str(v)) for k, v in lx.CURRENCY_CODES]) + ", upper(trim(token))) END AS code,"
    " CASE WHEN amount IS NOT NULL THEN v END AS min, CASE WHEN amount IS NOT NULL AND token IS NOT NULL AND token NOT IN ('', 'chf') THEN"
    + case_map("lower(trim(token))", [(k, sql_str(v)) for k, v in lx.CURRENCY_CODES]) + " END AS currency"
    f" FROM (SELECT posting_id, {pick_sql(TOKENS, 'seq.l_partkey')} AS token, CAST(seq.l_suppkey + 1000 AS VARCHAR) AS amount,"
    " CAST(seq.l_suppkey + 1000 AS DOUBLE) AS v FROM postings)"))
def q_currency_codes(spark, sf_dir):
    """Every currency token as a code, alone and inside a salary line."""
    token = pick(TOKENS, F.col("seq.l_partkey"))
    amount = (F.col("seq.l_suppkey") + 1000).cast("string")
    d = postings(spark, sf_dir).select("posting_id", token.alias("token"), F.concat_ws(" ", amount, token).alias("line"))
    d = d.withColumn("_s", X.salary_span(F.col("line")))
    return d.select("posting_id", "token", currency_code(F.col("token")).alias("code"), F.col("_s.min").alias("min"),
                    F.col("_s.currency").alias("currency"))
