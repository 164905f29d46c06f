"""Board-record normalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.lookups import currency_code
from ..functions.text import clean_text
from ..operators import extract as X
from ..operators import navigate, pay
from ..operators import relational as R
from ..session import shared_folder
from ..sources.board import BOARD_SQL, NESTED_SQL, board_records, nested_records
from ..sources.postings import postings
from .catalog import register
from .oracle import SCHEDULE_OVERRIDES, case_map, sched_cfg_sql, sql_num, sql_str, with_postings
from .q_text import _clean_sql, _gross_sql

_BOARD = {s: (n, h) for s, n, h in lx.SCHEDULE_PROFILES["board"]}


def _fmt_sql(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


def _norm_sched_sql(c: str) -> str:
    return f"replace(regexp_extract(lower(coalesce({c}, '')), '(\\d+\\s*/\\s*\\d+)', 1), ' ', '')"


_M5_CTE = f"""
m5a AS (
  SELECT *, {_norm_sched_sql('schedule_hint')} AS hint_s, {_norm_sched_sql('shift_pattern')} AS pat_s,
         CASE WHEN shift_length_hours IS NOT NULL AND shift_length_hours > 0 THEN shift_length_hours END AS structured,
         list_filter(list_transform(raw_matches, lambda m: regexp_extract(lower({_clean_sql('m')}), '(\\d{{1,2}})\\s*(?:час|ч)', 1)),
                     lambda x: x <> '')[1] AS th
  FROM board
),
m5b AS (
  SELECT *, CASE WHEN hint_s <> '' THEN hint_s ELSE pat_s END AS sched, CAST(nullif(th, '') AS DOUBLE) AS text_hours FROM m5a
),
m5c AS (
  SELECT *, CASE WHEN sched <> '' THEN {case_map('sched', [(s, sql_num(v[1])) for s, v in _BOARD.items() if v[1]])} END AS dflt_h,
            CASE WHEN sched <> '' THEN {case_map('sched', [(s, sql_num(v[0])) for s, v in _BOARD.items() if v[0]])} END AS spm
  FROM m5b
),
m5 AS (
  SELECT *, coalesce(structured, text_hours, dflt_h) AS hours,
    list_filter([
      CASE WHEN structured IS NOT NULL THEN 'часы/смену=' || {_fmt_sql('structured')} || ' (из normalized)' END,
      CASE WHEN structured IS NULL AND text_hours IS NOT NULL THEN 'часы/смену=' || {_fmt_sql('text_hours')} || ' (из текста)' END,
      CASE WHEN structured IS NULL AND text_hours IS NULL AND dflt_h IS NOT NULL
           THEN 'часы/смену=' || {_fmt_sql('dflt_h')} || ' (по умолчанию)' END,
      CASE WHEN spm IS NOT NULL THEN 'смен/мес=' || {_fmt_sql('spm')} || ' (по умолчанию)' END], lambda x: x IS NOT NULL) AS pnotes
  FROM m5c
)"""


def _m5(spark, sf_dir):
    return pay.shift_params(board_records(spark, sf_dir))


@register("shift_params", with_postings(
    "SELECT external_id, sched AS schedule, hours AS hours_per_shift, spm AS shifts_per_month,"
    " array_to_string(pnotes, '; ') AS notes FROM m5", BOARD_SQL, _M5_CTE))
def q_shift_params(spark, sf_dir):
    return _m5(spark, sf_dir).select("external_id", "schedule", "hours_per_shift", "shifts_per_month",
                                     F.array_join("param_notes", "; ").alias("notes"))


def _config_path(spark):
    """The schedule overrides as a landed configuration file."""
    import json
    entries = {s: {"shifts_per_month": n, "hours_per_shift": h} for s, n, h in SCHEDULE_OVERRIDES}
    entries |= {"4/4": {"shifts_per_month": "14", "hours_per_shift": "many"}, "3/3": "not an object", "6/1": {}}
    path = shared_folder(spark, "schedule_config")
    spark.createDataFrame([(json.dumps({"queries": ["повар"], "graph_schedule_defaults": entries}),)], "value string").coalesce(1).write.text(path)
    return path


_CONFIG_M5 = (_M5_CTE.replace(case_map("sched", [(s, sql_num(v[1])) for s, v in _BOARD.items() if v[1]]), "nullif(c.hours_per_shift, 0.0)")
              .replace(case_map("sched", [(s, sql_num(v[0])) for s, v in _BOARD.items() if v[0]]), "nullif(c.shifts_per_month, 0.0)")
              .replace("SELECT *, CASE WHEN sched <> ''", "SELECT m5b.*, CASE WHEN sched <> ''")
              .replace("  FROM m5b\n),\nm5 AS", "  FROM m5b LEFT JOIN cfg c ON c.schedule = sched\n),\nm5 AS"))


@register("shift_params_config", with_postings(
    "SELECT external_id, sched AS schedule, hours AS hours_per_shift, spm AS shifts_per_month,"
    " array_to_string(pnotes, '; ') AS notes FROM m5", BOARD_SQL, sched_cfg_sql([*SCHEDULE_OVERRIDES, ("4/4", 14.0, None)]), _CONFIG_M5))
def q_shift_params_config(spark, sf_dir):
    """Shift parameters under a configuration read from JSON: overrides that
    raise a value, are not positive, name an unknown schedule or are malformed."""
    config = R.schedule_config(spark, R.read_schedule_overrides(spark, _config_path(spark)))
    out = pay.shift_params(board_records(spark, sf_dir), config=config)
    return out.select("external_id", "schedule", "hours_per_shift", "shifts_per_month", F.array_join("param_notes", "; ").alias("notes"))


# ------------------------------------------------------------------ M4 ----
def _conv_sql(x: str) -> str:
    return (f"(CASE WHEN per IN ('per_month', 'month', 'monthly') THEN {x} / 1000.0"
            f" WHEN per IN ('per_shift', 'shift', 'per_day', 'day') AND spm IS NOT NULL AND spm <> 0 THEN {x} * spm / 1000.0"
            f" WHEN per IN ('per_hour', 'hour') AND spm IS NOT NULL AND spm <> 0 AND hours IS NOT NULL AND hours <> 0"
            f" THEN {x} * hours * spm / 1000.0"
            f" WHEN per IN ('per_week', 'week') THEN {x} * {lx.WEEKS_PER_MONTH} / 1000.0 END)")


_M4_CTE = f"""
m4a AS (
  SELECT *, CASE WHEN salary_from IS NOT NULL AND salary_to IS NOT NULL AND salary_from > salary_to THEN salary_to ELSE salary_from END AS lo,
            CASE WHEN salary_from IS NOT NULL AND salary_to IS NOT NULL AND salary_from > salary_to THEN salary_from ELSE salary_to END AS hi,
            salary_from IS NOT NULL AND salary_to IS NOT NULL AND salary_from > salary_to AS swapped,
            lower(coalesce(salary_period, 'per_month')) AS per,
            upper(coalesce(nullif(salary_currency, ''), 'RUB')) AS cur
  FROM m5
),
m4b AS (
  SELECT *, CASE WHEN {_conv_sql('lo')} >= 0 THEN {_conv_sql('lo')} END AS fk,
            CASE WHEN {_conv_sql('hi')} >= 0 THEN {_conv_sql('hi')} END AS tk
  FROM m4a
),
m4c AS (
  SELECT *, CASE WHEN fk IS NOT NULL AND hours IS NOT NULL AND hours <> 0 AND spm IS NOT NULL AND spm <> 0
                 THEN round_even(fk / hours / spm * 1000.0, 1)
                 WHEN per IN ('per_hour', 'hour') AND lo IS NOT NULL THEN lo END AS hour
  FROM m4b
),
m4 AS (
  SELECT *,
    CASE WHEN cur = 'RUB' THEN fk END AS salary_from_k, CASE WHEN cur = 'RUB' THEN tk END AS salary_to_k,
    CASE WHEN cur = 'RUB' THEN hour END AS hourly_rate,
    CASE WHEN cur = 'RUB' THEN (CASE WHEN hour IS NOT NULL THEN round_even(hour * 12.0, 1)
         WHEN per IN ('per_shift', 'shift') AND lo IS NOT NULL AND lo <> 0 THEN lo
         WHEN per IN ('per_day', 'day') AND spm IS NOT NULL AND spm <> 0 AND lo IS NOT NULL THEN lo
         WHEN lo IS NOT NULL AND lo <> 0 AND per IN ('per_shift', 'per_day') THEN lo END) END AS shift_income,
    list_filter([
      CASE WHEN swapped THEN 'ЗП от > ЗП до — значения поменяны местами' END,
      CASE WHEN cur <> 'RUB' THEN 'Валюта ' || cur || ' не поддерживается' END,
      CASE WHEN cur = 'RUB' AND per IN ('per_hour', 'hour') AND lo IS NULL AND hi IS NOT NULL
           THEN 'Ставка в час дана только максимумом — расчёт пропущен' END], lambda x: x IS NOT NULL) AS snotes
  FROM m4c
)"""


def _m4(spark, sf_dir):
    return pay.monthly_pay(_m5(spark, sf_dir), pay_from="salary_from", pay_to="salary_to")


@register("monthly_pay", with_postings(
    "SELECT external_id, round_even(salary_from_k, 0) AS salary_from_k, round_even(salary_to_k, 0) AS salary_to_k,"
    " round_even(hourly_rate, 0) AS hourly_rate, round_even(shift_income, 0) AS shift_income FROM m4",
    BOARD_SQL, _M5_CTE, _M4_CTE))
def q_monthly_pay(spark, sf_dir):
    m = _m4(spark, sf_dir)
    return m.select("external_id", *[F.bround(c, 0).alias(c) for c in
                                     ("salary_from_k", "salary_to_k", "hourly_rate", "shift_income")])


# ------------------------------------------------------------------ P12 ---
_P12_SQL = (
    "SELECT external_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '; ') AS calc_notes FROM ("
    " SELECT external_id, pnotes || snotes || list_filter(["
    " CASE WHEN sched <> '' THEN 'График=' || sched END,"
    f" CASE WHEN hours IS NOT NULL AND hours <> 0 THEN 'часы/смену=' || {_fmt_sql('hours')} END,"
    f" CASE WHEN spm IS NOT NULL AND spm <> 0 THEN 'смен/мес=' || {_fmt_sql('spm')} END], lambda x: x IS NOT NULL) AS l"
    " FROM m4)")


def _p12(spark, sf_dir):
    m = pay.salary_notes(_m4(spark, sf_dir))
    return m.withColumn("calc_notes", pay.calc_trail(F.col("param_notes"), F.col("salary_notes"), F.col("schedule"),
                                                      F.col("hours_per_shift"), F.col("shifts_per_month")))


@register("calc_notes", with_postings(_P12_SQL, BOARD_SQL, _M5_CTE, _M4_CTE))
def q_calc_notes(spark, sf_dir):
    return _p12(spark, sf_dir).select("external_id", "calc_notes")


# ------------------------------------------------------------------ T14 ---
@register("audit_log", with_postings(
    "SELECT external_id, stage, message, url FROM ("
    " SELECT external_id, url_detail AS url, 'card' AS stage, 'Объявление недоступно' AS message FROM m4 WHERE NOT is_active"
    " UNION ALL SELECT external_id, url_detail, 'calc', array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '; ')"
    "  FROM (SELECT *, pnotes || snotes || list_filter(["
    "   CASE WHEN sched <> '' THEN 'График=' || sched END,"
    f"  CASE WHEN hours IS NOT NULL AND hours <> 0 THEN 'часы/смену=' || {_fmt_sql('hours')} END,"
    f"  CASE WHEN spm IS NOT NULL AND spm <> 0 THEN 'смен/мес=' || {_fmt_sql('spm')} END], lambda x: x IS NOT NULL) AS l"
    "  FROM m4) WHERE len(pnotes || snotes) > 0"
    " UNION ALL SELECT external_id, url_detail, 'card', 'HTTP статус ' || CAST(detail_status AS VARCHAR) FROM m4"
    "  WHERE detail_status IS NOT NULL AND detail_status <> 0 AND detail_status <> 200)",
    BOARD_SQL, _M5_CTE, _M4_CTE))
def q_audit_log(spark, sf_dir):
    m = _p12(spark, sf_dir)
    has_notes = F.size(F.concat("param_notes", "salary_notes")) > 0
    return X.audit_rows(m, "external_id", F.col("url_detail"), ~F.col("is_active"),
                        F.when(has_notes, F.col("calc_notes")), F.col("detail_status")).drop("pos")


# ------------------------------------------------------------------ P10 ---
_CITY_EXPR = "coalesce(location_city, 'Москва')"


@register("defaults", with_postings(
    f"SELECT external_id, coalesce(nullif({_clean_sql('employer_name')}, ''), {sql_str(lx.NO_COMPANY)}) AS company,"
    f" {_clean_sql('title')} AS title, {_clean_sql(_CITY_EXPR)} AS city, coalesce(region, 'Москва') AS region FROM nested", BOARD_SQL, NESTED_SQL))
def q_defaults(spark, sf_dir):
    b = nested_records(spark, sf_dir)
    region = navigate.first_of(["location_area", "region"], navigate.TEXT)
    return b.select("external_id",
                    F.coalesce(F.nullif(clean_text(F.col("employer_name")), F.lit("")), F.lit(lx.NO_COMPANY)).alias("company"),
                    clean_text(F.col("title")).alias("title"),
                    clean_text(F.coalesce(F.col("location_city"), F.lit("Москва"))).alias("city"),
                    navigate.pick_region(region, None, "Москва").alias("region"))


# ------------------------------------------------------------------ P11 ---
@register("notes", with_postings(
    "SELECT posting_id, concat_ws('; ', CASE WHEN g THEN 'До вычета налога' END,"
    " CASE WHEN coalesce(schedule, '') = '' THEN 'График не распознан' END,"
    " CASE WHEN shift_hours IS NULL THEN 'Длительность смены не указана' END) AS note FROM ("
    f" SELECT posting_id, schedule, shift_hours, {_gross_sql('pay_text')} AS g FROM postings)"))
def q_notes(spark, sf_dir):
    p = postings(spark, sf_dir)
    note = F.concat_ws("; ", F.when(X.gross_flag(F.col("pay_text")), F.lit(lx.GROSS_NOTE)),
                       F.when(F.coalesce(F.col("schedule"), F.lit("")) == "", F.lit("График не распознан")),
                       F.when(F.col("shift_hours").isNull(), F.lit("Длительность смены не указана")))
    return p.select("posting_id", note.alias("note"))


# ------------------------------------------------------------------ P13 ---
def _first_sched(c):
    return f"trim(split_part(coalesce({c}, ''), ',', 1))"


_P13_CTE = f"""
l0 AS (
  SELECT *, upper(coalesce(salary_currency, '')) AS cur,
    (CASE WHEN salary_from IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN salary_to IS NOT NULL THEN 1 ELSE 0 END) AS nv,
    coalesce(nullif(schedule_hint, ''), shift_pattern) AS sch,
    coalesce(structured, CASE WHEN contains(schedule_hint, ' по 11 часов') THEN 11.0 END) AS shift_length_hours
  FROM nested
),
l1 AS (
  SELECT *, CASE WHEN cur IN ('', 'RUB') AND salary_from IS NOT NULL THEN round_even(salary_from / 1000.0, 3) END AS from_tr,
    CASE WHEN cur IN ('', 'RUB') AND salary_to IS NOT NULL THEN round_even(salary_to / 1000.0, 3) END AS to_tr,
    CASE WHEN nv > 0 THEN (coalesce(salary_from, 0.0) + coalesce(salary_to, 0.0)) / nv END AS mean_v,
    coalesce(shift_length_hours, CASE WHEN coalesce(sch, '') <> '' THEN
      {case_map(_first_sched('sch'), [(s, sql_num(h)) for s, _, h in lx.SCHEDULE_PROFILES['fetch'] if h])} END) AS len_out
  FROM l0
),
l2 AS (
  SELECT *, CASE WHEN salary_period = 'per_hour' THEN mean_v END AS explicit,
    CASE WHEN salary_period IN ('per_shift', 'per_day') THEN mean_v END AS shift_sum,
    {_first_sched('sch')} AS sk FROM l1
),
l3 AS (
  SELECT *,
    CASE WHEN explicit IS NOT NULL AND explicit <> 0 THEN round_even(explicit, 2)
         WHEN shift_sum IS NULL OR shift_length_hours IS NULL OR shift_length_hours <= 0 THEN NULL
         ELSE round_even(shift_sum / shift_length_hours, 2) END AS r1,
    CASE WHEN explicit IS NOT NULL AND explicit <> 0 THEN 'exact:explicit_hourly'
         WHEN shift_sum IS NULL THEN 'unresolved:no_shift_payment'
         WHEN shift_length_hours IS NULL THEN 'unresolved:shift_duration'
         WHEN shift_length_hours <= 0 THEN 'unresolved:invalid_shift_duration'
         ELSE 'exact:shift_payment_div_shift_hours' END AS m1,
    CASE WHEN len_out IS NOT NULL AND len_out > 0 THEN len_out
         ELSE {case_map('sk', [(s, sql_num(h)) for s, _, h in lx.SCHEDULE_PROFILES['fetch'] if h])} END AS eff,
    {case_map('sk', [(s, sql_num(n)) for s, n, _ in lx.SCHEDULE_PROFILES['fetch']])} AS spm2
  FROM l2
),
l4 AS (
  SELECT *, CASE WHEN eff IS NOT NULL AND from_tr > 0 AND spm2 IS NOT NULL AND eff * spm2 > 0
                  AND from_tr / eff / spm2 * 1000.0 > 0 THEN round_even(from_tr / eff / spm2 * 1000.0, 1) END AS dh
  FROM l3
),
l5 AS (
  SELECT *, r1 IS NULL AND ((from_tr IS NOT NULL AND from_tr <> 0) OR (to_tr IS NOT NULL AND to_tr <> 0))
            AND dh IS NOT NULL AND dh <> 0 AS use_d FROM l4
),
legacy AS (
  SELECT external_id, coalesce(title, {sql_str(lx.NO_TITLE)}) AS title, employer_name AS employer, published,
    from_tr AS salary_from_k, to_tr AS salary_to_k,
    CASE WHEN h IS NOT NULL AND h <> 0 THEN h * 12.0
         WHEN shift_sum IS NOT NULL AND shift_sum <> 0 AND len_out IS NOT NULL AND len_out <> 0 THEN shift_sum * (12.0 / len_out) END AS income_12h,
    h AS hourly, CASE WHEN use_d THEN 'derived:salary_based' ELSE m1 END AS hourly_method, len_out AS shift_hours,
    CASE WHEN shift_length_hours IS NOT NULL THEN 'structured_field' ELSE 'unresolved' END AS shift_source,
    CASE WHEN shift_length_hours IS NOT NULL THEN 'high' ELSE 'low' END AS shift_confidence,
    concat_ws(' | ', CASE m1 WHEN 'exact:explicit_hourly' THEN 'hourly rate explicitly found in text'
        WHEN 'unresolved:no_shift_payment' THEN 'no shift payment found' WHEN 'unresolved:shift_duration' THEN 'shift duration unresolved'
        ELSE 'computed from shift payment ' || CAST(shift_sum AS VARCHAR) || ' / ' || CAST(CAST(shift_length_hours AS DOUBLE) AS VARCHAR) || 'h' END,
      CASE WHEN use_d THEN 'derived from monthly salary (schedule=' || coalesce(sch, 'None') || ', shift='
        || coalesce(CAST(CAST(len_out AS DOUBLE) AS VARCHAR), 'None') || 'h)' END) AS parsing_notes,
    experience, employment_type AS employment,
    CASE WHEN regexp_full_match(trim(sch), '\\d+/\\d+(?:\\s*,\\s*\\d+/\\d+)*') THEN trim(sch) END AS schedule,
    NULL AS pay_frequency, benefits, duties_raw AS duties, url_detail AS url,
    concat_ws('; ', CASE WHEN coalesce(sch, '') = '' THEN 'График не распознан' END,
              CASE WHEN len_out IS NULL THEN 'Длительность смены не указана' END) AS note, 'avito.ru' AS source
  FROM (SELECT *, CASE WHEN use_d THEN dh ELSE r1 END AS h FROM l5)
)"""


@register("legacy_row", with_postings("SELECT * FROM legacy", BOARD_SQL, NESTED_SQL, _P13_CTE))
def q_legacy_row(spark, sf_dir):
    """Export rows of nested board records, with all their columns."""
    return pay.legacy_row(navigate.flat(nested_records(spark, sf_dir)))


# ------------------------------------------------------------------ M3 ----
# over m3a(posting_id, exp_h, salary_from_k, salary_to_k, schedule, slen, pay, amb, conf)
CASCADE_CTE = f"""
m3b AS (
  SELECT *,
    CASE WHEN exp_h IS NOT NULL AND exp_h <> 0 THEN round_even(exp_h, 2)
         WHEN pay IS NULL OR slen IS NULL OR amb OR slen <= 0 THEN NULL ELSE round_even(pay / slen, 2) END AS r1,
    CASE WHEN exp_h IS NOT NULL AND exp_h <> 0 THEN 'exact:explicit_hourly' WHEN pay IS NULL THEN 'unresolved:no_shift_payment'
         WHEN slen IS NULL THEN 'unresolved:shift_duration' WHEN amb THEN 'unresolved:ambiguous_shift_duration'
         WHEN slen <= 0 THEN 'unresolved:invalid_shift_duration'
         WHEN conf = 'high' THEN 'exact:shift_payment_div_shift_hours' ELSE 'heuristic:shift_payment_div_shift_hours' END AS m1,
    coalesce(slen, CASE WHEN coalesce(schedule, '') <> '' THEN
      {case_map(_first_sched('schedule'), [(s, sql_num(h)) for s, _, h in lx.SCHEDULE_PROFILES['fetch'] if h])} END) AS len_out,
    {_first_sched('schedule')} AS sk
  FROM m3a
),
m3c AS (
  SELECT *, CASE WHEN len_out IS NOT NULL AND len_out > 0 THEN len_out
                 ELSE {case_map('sk', [(s, sql_num(h)) for s, _, h in lx.SCHEDULE_PROFILES['fetch'] if h])} END AS eff,
            {case_map('sk', [(s, sql_num(n)) for s, n, _ in lx.SCHEDULE_PROFILES['fetch']])} AS spm2
  FROM m3b
),
m3d AS (
  SELECT *, CASE WHEN eff IS NOT NULL AND salary_from_k > 0 AND spm2 IS NOT NULL AND eff * spm2 > 0
                  AND salary_from_k / eff / spm2 * 1000.0 > 0 THEN round_even(salary_from_k / eff / spm2 * 1000.0, 1) END AS dh
  FROM m3c
),
m3 AS (
  SELECT *, r1 IS NULL AND ((salary_from_k IS NOT NULL AND salary_from_k <> 0) OR (salary_to_k IS NOT NULL AND salary_to_k <> 0))
            AND dh IS NOT NULL AND dh <> 0 AS use_d FROM m3d
)"""
CASCADE_SQL = (
    "SELECT posting_id, h AS hourly_rate, CASE WHEN use_d THEN 'derived:salary_based' ELSE m1 END AS hourly_method,"
    " len_out AS shift_len, CASE WHEN pay IS NOT NULL AND pay <> 0 AND len_out = 12.0 THEN pay"
    " WHEN h IS NOT NULL AND h <> 0 THEN h * 12.0 END AS income_12h"
    " FROM (SELECT *, CASE WHEN use_d THEN dh ELSE r1 END AS h FROM m3)")


@register("rate_cascade", with_postings(CASCADE_SQL, """m3a AS (
  SELECT posting_id, hourly AS exp_h, salary_from_k, salary_to_k, schedule, shift_hours AS slen, false AS amb, 'high' AS conf,
    CASE WHEN contains(description, 'за смену') THEN CAST(regexp_extract(description, 'Оплата (\\d+)', 1) AS DOUBLE) END AS pay
  FROM postings)""", CASCADE_CTE))
def q_rate_cascade(spark, sf_dir):
    p = postings(spark, sf_dir)
    shift_pay = F.when(F.col("description").contains("за смену"),
                       F.regexp_extract("description", r"Оплата (\d+)", 1).cast("double"))
    d = p.select("posting_id", "hourly", "salary_from_k", "salary_to_k", "schedule",
                 F.col("shift_hours").alias("shift_len"), shift_pay.alias("shift_pay"),
                 F.lit(False).alias("shift_ambiguous"), F.lit("high").alias("shift_confidence"))
    out = pay.rate_cascade(d)
    return out.select("posting_id", "hourly_rate", "hourly_method", F.col("shift_len_out").alias("shift_len"),
                      "income_12h")


# ------------------------------------------------------------------ T2 ----
@register("currency", with_postings(
    "SELECT posting_id, CASE WHEN tok = '' THEN NULL ELSE coalesce("
    + case_map("lower(trim(tok))", [(k, sql_str(v)) for k, v in lx.CURRENCY_CODES]) + ", upper(trim(tok))) END AS currency"
    f" FROM (SELECT posting_id, regexp_extract(lower(description), {sql_str(lx.CURRENCY_TOKEN_RE)}, 0) AS tok FROM postings)"))
def q_currency(spark, sf_dir):
    p = postings(spark, sf_dir)
    tok = F.regexp_extract(F.lower("description"), lx.CURRENCY_TOKEN_RE, 0)
    return p.select("posting_id", currency_code(tok).alias("currency"))


# ------------------------------------------------------------------ T3 ----
@register("salary_span", with_postings(
    "SELECT posting_id, CASE WHEN len(v) > 0 THEN least(v[1], v[len(v)]) END AS min,"
    " CASE WHEN len(v) > 0 THEN greatest(v[1], v[len(v)]) END AS max,"
    " CASE WHEN len(v) > 0 AND cur <> '' THEN coalesce("
    + case_map("lower(trim(cur))", [(k, sql_str(v)) for k, v in lx.CURRENCY_CODES]) + ", upper(trim(cur))) END AS currency"
    " FROM (SELECT posting_id, list_filter(list_transform(regexp_extract_all(seg, '\\d[\\d\\s  ]*(?:[\\.,]\\d+)?', 0)[1:2],"
    " lambda s: TRY_CAST(replace(replace(replace(s, ' ', ''), ' ', ''), ',', '.') AS DOUBLE)), lambda x: x IS NOT NULL) AS v,"
    f" regexp_extract(seg, '(?i)' || {sql_str(lx.CURRENCY_TOKEN_RE)}, 0) AS cur"
    f" FROM (SELECT posting_id, {_clean_sql('description')} AS seg FROM postings))"))
def q_salary_span(spark, sf_dir):
    s = postings(spark, sf_dir).select("posting_id", X.salary_span(F.col("description")).alias("_s"))
    return s.select("posting_id", F.col("_s.min").alias("min"), F.col("_s.max").alias("max"),
                    F.col("_s.currency").alias("currency"))


# ------------------------------------------------------------------ P8 ----
@register("slug", "SELECT n_nationkey, n_name, coalesce("
          + case_map("lower(trim(n_name))", [(k, sql_str(v)) for k, v in lx.CITY_SLUGS])
          + ", nullif(trim(regexp_replace(translate(" + "".join("replace(" for _ in lx.TRANSLIT_MULTI)
          + "lower(trim(n_name))" + "".join(f", {sql_str(a)}, {sql_str(b)})" for a, b in lx.TRANSLIT_MULTI)
          + f", {sql_str(lx.TRANSLIT_SINGLE_FROM + lx.TRANSLIT_DROP)}, {sql_str(lx.TRANSLIT_SINGLE_TO)}),"
          " '[^a-z0-9]+', '_', 'g'), '_'), ''), 'vakansii') AS slug FROM nation")
def q_slug(spark, sf_dir):
    from ..functions.text import slugify
    from ..session import read_table
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return n.select("n_nationkey", "n_name", slugify(F.col("n_name")).alias("slug"))


# ------------------------------------------------------------------ P2 ----
@register("coerce_num", with_postings(
    "SELECT posting_id, TRY_CAST(regexp_replace(replace(raw, ',', '.'), '[^\\d\\.\\-]', '', 'g') AS DOUBLE) AS value FROM ("
    " SELECT posting_id, CAST(pay_from AS VARCHAR) || ' руб' AS raw FROM postings"
    " UNION ALL SELECT posting_id, coalesce(schedule, '') FROM postings"
    " UNION ALL SELECT posting_id, replace(CAST(shift_hours AS VARCHAR), '.', ',') FROM postings)"))
def q_coerce_num(spark, sf_dir):
    from ..functions.text import coerce_number
    p = postings(spark, sf_dir)
    raw = p.select("posting_id", F.explode(F.array(
        F.concat(F.col("pay_from").cast("string"), F.lit(" руб")), F.coalesce("schedule", F.lit("")),
        F.replace(F.col("shift_hours").cast("string"), F.lit("."), F.lit(",")))).alias("raw"))
    return raw.select("posting_id", coerce_number(F.col("raw")).alias("value"))


# ------------------------------------------------------------------ E2: board pipeline --
NORMALIZED_COLS = ["external_id", "url", "city", "region", "title", "company", "salary_from_k", "salary_to_k",
                   "hourly_rate", "shift_income", "schedule", "work_format", "experience", "duties", "requirements",
                   "conditions", "working_hours", "published", "contacts", "calc_notes"]


MONEY_COLS = ["salary_from_k", "salary_to_k", "hourly_rate", "shift_income"]


def normalized_records(spark, sf_dir, min_salary=None, max_salary=None, city="Москва", columns=tuple(NORMALIZED_COLS)):
    return normalize_board(board_records(spark, sf_dir), min_salary, max_salary, city, columns)


def normalize_board(board, min_salary=None, max_salary=None, city="Москва", columns=tuple(NORMALIZED_COLS)):
    """Board records -> one normalised row per posting: shift params (M5),
    period conversion (M4), defaults (P10), work format (T8), experience
    bucket (T9), merged conditions (T10), calc trail (P12); then the
    completeness merge per id (A13), the salary band (F4) and rounding.  The
    merge weighs all columns; of the row it keeps ``columns`` and the amounts."""
    from ..operators.filters import salary_band
    m = pay.salary_notes(pay.monthly_pay(pay.shift_params(board), pay_from="salary_from", pay_to="salary_to"))
    m = m.withColumn("calc_notes", pay.calc_trail(F.col("param_notes"), F.col("salary_notes"), F.col("schedule"),
                                                  F.col("hours_per_shift"), F.col("shifts_per_month")))
    hours_txt = X.join_unique(F.col("raw_matches"))
    row = m.select(
        "external_id", "seq", F.col("url_detail").alias("url"),
        clean_text(F.coalesce(F.col("location_city"), F.lit(city))).alias("city"),
        F.lit(city).alias("region"),
        clean_text(F.col("title")).alias("title"),
        F.coalesce(F.nullif(clean_text(F.col("employer_name")), F.lit("")), F.lit(lx.NO_COMPANY)).alias("company"),
        "salary_from_k", "salary_to_k", "hourly_rate", "shift_income", "schedule",
        X.work_format([F.col("employment_type"), F.col("duties_raw"), F.lit(None).cast("string"),
                       F.col("conditions_raw"), hours_txt], F.col("schedule")).alias("work_format"),
        X.experience_bucket(F.col("experience_raw")).alias("experience"),
        clean_text(F.col("duties_raw")).alias("duties"), F.lit("").alias("requirements"),
        X.join_unique(F.split(F.coalesce(clean_text(F.col("conditions_raw")), F.lit("")), r"[\n;]")).alias("conditions"),
        hours_txt.alias("working_hours"),
        F.coalesce(F.col("posted_date").cast("string"), F.lit("")).alias("published"),
        F.lit("").alias("contacts"), "calc_notes")
    key = F.coalesce(F.col("external_id").cast("string"), F.col("url"))
    kept = [c for c in NORMALIZED_COLS if c in columns or c in MONEY_COLS]
    best = R.best_record(row, key, [c for c in NORMALIZED_COLS if c != "external_id"] + ["external_id"], columns=kept)
    best = salary_band(best, min_salary, max_salary)
    return best.withColumns({c: F.bround(c, 0) for c in MONEY_COLS})


@register("board_normalized")
def q_board_normalized(spark, sf_dir):
    """The board pipeline's normalised table (rows-only; every step is
    oracle-checked on its own: shift_params, monthly_pay, defaults,
    work_format, experience_bucket, conditions_merge, calc_notes, best_record)."""
    return normalized_records(spark, sf_dir).select(*NORMALIZED_COLS)


@register("board_job_stats")
def q_board_job_stats(spark, sf_dir):
    """Per-title statistics over the normalised board table (A1 on E2)."""
    from ..operators import marts
    n = normalized_records(spark, sf_dir, columns=["title"])
    return marts.job_stats(n, measures=[("salary_from_k", "from"), ("salary_to_k", "to"), ("hourly_rate", "hourly")])
