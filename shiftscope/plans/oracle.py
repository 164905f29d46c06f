"""DuckDB oracle SQL building blocks.

The postings view here is the SQL statement of ``sources.postings`` and
must stay column-for-column equal to it.  Lookup tables are rendered from
``lexicon`` so both engines use one source of truth for fixed values.
"""

from __future__ import annotations

from .. import lexicon as lx

POSTINGS_SQL = r"""
postings AS (
  SELECT
    l_orderkey * 100 + l_linenumber AS posting_id,
    struct_pack(l_orderkey := l_orderkey, l_linenumber := l_linenumber,
                l_partkey := l_partkey, l_suppkey := l_suppkey,
                l_quantity := l_quantity, l_extendedprice := l_extendedprice,
                l_shipdate := l_shipdate) AS seq,
    CASE l_linenumber % 3 WHEN 0 THEN 'hh.ru' WHEN 1 THEN 'avito.ru' ELSE 'gorodrabot.ru' END AS source,
    p_name AS title,
    CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE s_name END AS employer,
    n_name AS city,
    CAST(o_orderdate AS DATE) AS posted_date,
    CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS INTEGER) * 2000 + 20000 AS DOUBLE) END AS salary_from,
    CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS INTEGER) * 2500 + 30000 AS DOUBLE) END AS salary_to,
    CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS INTEGER) * 2000 + 20000 AS DOUBLE) END / 1000.0 AS salary_from_k,
    CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS INTEGER) * 2500 + 30000 AS DOUBLE) END / 1000.0 AS salary_to_k,
    CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_quantity AS INTEGER) * 10 + 150 AS DOUBLE) END AS hourly,
    CASE l_suppkey % 6 WHEN 0 THEN '2/2' WHEN 1 THEN '5/2' WHEN 2 THEN '3/3' WHEN 3 THEN '6/1'
         WHEN 4 THEN '2/2, 5/2' ELSE NULL END AS schedule,
    CAST(CASE l_partkey % 4 WHEN 0 THEN 8.0 WHEN 1 THEN 10.0 WHEN 2 THEN 12.0 ELSE NULL END AS DOUBLE) AS shift_hours,
    description,
    experience_raw, employment_raw, pay_text, format_text, benefits, hours_text,
    concat_ws('. ', description, experience_raw, employment_raw, pay_text, format_text, hours_text) AS full_text,
    CASE l_partkey % 3 WHEN 0 THEN 'Обязанности: приготовление блюд; уборка рабочего места. Требования: аккуратность'
         WHEN 1 THEN '- выкладка товара - работа с кассой' ELSE NULL END AS duties_raw,
    CASE l_orderkey % 6 WHEN 0 THEN 'сегодня в ' || CAST(l_linenumber + 8 AS VARCHAR) || ':30' WHEN 1 THEN 'вчера'
         WHEN 2 THEN CAST(l_linenumber AS VARCHAR) || ' часов назад' WHEN 3 THEN CAST(l_linenumber AS VARCHAR) || ' дней назад'
         WHEN 4 THEN CAST(l_linenumber AS VARCHAR) || ' недели назад'
         ELSE CAST(l_linenumber + 10 AS VARCHAR) || '.0' || CAST(l_suppkey % 9 + 1 AS VARCHAR) || '.24' END AS posted_raw,
    CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE
      (CASE WHEN l_partkey % 2 = 0 THEN 'https://' ELSE 'http://' END)
      || (CASE l_linenumber % 4 WHEN 0 THEN 'www.' WHEN 1 THEN 'm.' WHEN 2 THEN '' ELSE 'www.www.' END)
      || (CASE l_linenumber % 3 WHEN 0 THEN 'hh.ru' WHEN 1 THEN 'avito.ru' ELSE 'gorodrabot.ru' END)
      || (CASE l_linenumber % 3
            WHEN 0 THEN '/vacancy/' || CAST(l_orderkey * 100 + l_linenumber AS VARCHAR)
            WHEN 1 THEN '/' || replace(lower(n_name), ' ', '-') || '/vakansii/' || replace(p_name, ' ', '_')
                        || '-' || CAST(l_orderkey * 100 + l_linenumber AS VARCHAR)
            ELSE (CASE WHEN l_partkey % 9 = 0 THEN '/company/' ELSE '/vacancy/' END)
                 || replace(p_name, ' ', '-') || '-' || CAST(l_orderkey * 100 + l_linenumber AS VARCHAR) END)
      || (CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '?utm_source=feed&page=' || CAST(l_linenumber AS VARCHAR)
               ELSE '#details' END)
    END AS url,
    CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 'per_shift' WHEN 1 THEN 'per_hour' WHEN 2 THEN 'per_day'
         WHEN 3 THEN 'per_week' ELSE 'per_month' END AS salary_period,
    CASE WHEN l_partkey % 11 = 0 THEN 'USD' WHEN l_partkey % 11 = 1 THEN NULL ELSE 'RUB' END AS salary_currency,
    CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(CASE (l_orderkey + l_linenumber) % 5
         WHEN 0 THEN CAST(l_quantity AS INTEGER) * 100 + 2000 WHEN 1 THEN CAST(l_quantity AS INTEGER) * 10 + 150
         WHEN 2 THEN CAST(l_quantity AS INTEGER) * 100 + 2500 WHEN 3 THEN CAST(l_quantity AS INTEGER) * 500 + 10000
         ELSE CAST(l_quantity AS INTEGER) * 2000 + 20000 END AS DOUBLE) END AS pay_from,
    CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(CASE (l_orderkey + l_linenumber) % 5
         WHEN 0 THEN CAST(l_quantity AS INTEGER) * 120 + 2500 WHEN 1 THEN CAST(l_quantity AS INTEGER) * 12 + 200
         WHEN 2 THEN CAST(l_quantity AS INTEGER) * 120 + 3000 WHEN 3 THEN CAST(l_quantity AS INTEGER) * 600 + 12000
         ELSE CAST(l_quantity AS INTEGER) * 2500 + 30000 END AS DOUBLE) END AS pay_to
  FROM (
    SELECT *,
      'Оплата ' || CAST(CAST(l_quantity AS INTEGER) * 10 + 150 AS VARCHAR)
        || (CASE WHEN l_linenumber % 2 = 0 THEN ' руб/час' ELSE ' ₽ за смену' END)
        || ', график ' || CAST(l_suppkey % 5 + 1 AS VARCHAR) || '/' || CAST(l_suppkey % 3 + 1 AS VARCHAR)
        || ' по ' || CAST(l_partkey % 5 + 8 AS VARCHAR) || ' часов' AS description,
      CASE l_orderkey % 7 WHEN 0 THEN 'Без опыта' WHEN 1 THEN 'Опыт работы от 1 до 3 лет' WHEN 2 THEN 'опыт от 3 лет'
           WHEN 3 THEN 'Опыт работы более 6 лет' WHEN 4 THEN 'не требуется' WHEN 5 THEN 'Опыт от 2 лет'
           ELSE NULL END AS experience_raw,
      CASE l_suppkey % 4 WHEN 0 THEN 'Полная занятость, оформление по ТК' WHEN 1 THEN 'Частичная занятость'
           WHEN 2 THEN 'ГПХ, самозанятость' ELSE NULL END AS employment_raw,
      CASE l_partkey % 6 WHEN 0 THEN 'Выплаты еженедельно' WHEN 1 THEN 'Аванс и зарплата 2 раза в месяц'
           WHEN 2 THEN 'Зарплата ежемесячно' WHEN 3 THEN 'Зарплата до вычета НДФЛ' WHEN 4 THEN 'Сумма на руки'
           ELSE NULL END AS pay_text,
      CASE l_orderkey % 5 WHEN 0 THEN 'Работа в офисе' WHEN 1 THEN 'Удаленно' WHEN 2 THEN 'Гибридный формат'
           WHEN 3 THEN 'Вахта' ELSE NULL END AS format_text,
      CASE (l_partkey + l_suppkey) % 5 WHEN 0 THEN 'ДМС; питание, форма' WHEN 1 THEN 'питание; Развозка'
           WHEN 2 THEN 'ДМС, обучение, скидки' WHEN 3 THEN '• ДМС ; - питание' ELSE NULL END AS benefits,
      CASE l_partkey % 7 WHEN 0 THEN 'Смена с 9:00 до 21:00' WHEN 1 THEN 'ночная смена с 20:00 до 08:00'
           WHEN 2 THEN 'Пн–Пт 9:00–18:00, Сб 10–16, Вс выходной' WHEN 3 THEN 'Перерыв 1 час, смена 8 часов'
           WHEN 4 THEN 'круглосуточно, без выходных' WHEN 5 THEN 'Гибкий график' ELSE NULL END AS hours_text
    FROM lineitem
    JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey
    JOIN part ON l_partkey = p_partkey
    JOIN orders ON l_orderkey = o_orderkey
  ) j
)
"""


def with_postings(body: str, *ctes: str) -> str:
    extra = "".join(",\n" + c for c in ctes)
    return "WITH " + POSTINGS_SQL + extra + "\n" + body


def sql_str(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def sql_num(x: float | None) -> str:
    return "NULL" if x is None else f"CAST({x!r} AS DOUBLE)"


def case_map(expr: str, pairs, default: str = "NULL") -> str:
    """CASE expr WHEN k THEN v ... END from (key, sql-literal) pairs."""
    whens = " ".join(f"WHEN {sql_str(k)} THEN {v}" for k, v in pairs)
    return f"(CASE {expr} {whens} ELSE {default} END)"


def schedule_shifts_sql(expr: str, profile: str) -> str:
    return case_map(expr, [(s, sql_num(n)) for s, n, _ in lx.SCHEDULE_PROFILES[profile]])


def schedule_hours_sql(expr: str, profile: str) -> str:
    return case_map(expr, [(s, sql_num(h)) for s, _, h in lx.SCHEDULE_PROFILES[profile] if h is not None])


# Configured overrides of the schedule table (a job parameter).
SCHEDULE_OVERRIDES = [("2/2", 16.0, 11.0), ("5/2", -1.0, 9.0), ("1/1", 30.0, 12.0), ("9/9", 0.0, 0.0)]


def sched_cfg_sql(overrides=SCHEDULE_OVERRIDES) -> str:
    base = ", ".join(f"({sql_str(s)}, {n!r}::DOUBLE, {('NULL' if h is None else repr(h))}::DOUBLE)"
                     for s, n, h in lx.SCHEDULE_PROFILES["board"])
    ov = ", ".join(f"({sql_str(s)}, {n!r}::DOUBLE, {('NULL' if h is None else repr(h))}::DOUBLE)" for s, n, h in overrides)

    def pick(c):
        return f"CASE WHEN o.{c} IS NOT NULL AND o.{c} > 0 THEN o.{c} ELSE coalesce(b.{c}, 0.0) END"
    return f"""
b AS (SELECT * FROM (VALUES {base}) t(schedule, shifts_per_month, hours_per_shift)),
o AS (SELECT * FROM (VALUES {ov}) t(schedule, shifts_per_month, hours_per_shift)),
cfg AS (
  SELECT * FROM (SELECT coalesce(b.schedule, o.schedule) AS schedule, {pick('shifts_per_month')} AS shifts_per_month,
                        {pick('hours_per_shift')} AS hours_per_shift
                 FROM b FULL OUTER JOIN o ON b.schedule = o.schedule)
  WHERE shifts_per_month > 0 OR hours_per_shift > 0
)"""
