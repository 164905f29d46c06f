"""Core queries: pay metrics and marts over the postings view."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..operators import marts, pay
from ..sources.postings import postings
from .catalog import register
from .oracle import schedule_hours_sql, schedule_shifts_sql, sql_str, with_postings

# ---------------------------------------------------------------- M1 ------
_M1_SQL_CTE = f"""
m1_in AS (
  SELECT *, trim(coalesce(schedule, '')) AS sk FROM postings
),
m1_a AS (
  SELECT *, {schedule_shifts_sql('sk', 'metrics')} AS spm, {schedule_hours_sql('sk', 'metrics')} AS dh
  FROM m1_in
),
m1_b AS (
  SELECT *, CASE WHEN shift_hours IS NOT NULL AND shift_hours > 0 THEN shift_hours ELSE dh END AS eff
  FROM m1_a
),
m1_c AS (
  SELECT *, (hourly IS NULL AND salary_from_k IS NOT NULL AND eff IS NOT NULL AND eff > 0
             AND spm IS NOT NULL AND spm > 0) AS fill
  FROM m1_b
),
metrics AS (
  SELECT posting_id, seq, title, employer, city, source, url, schedule,
         round_even(salary_from_k, 1) AS salary_from_k, round_even(salary_to_k, 1) AS salary_to_k,
         round_even(CASE WHEN fill THEN salary_from_k / eff / spm * 1000.0 ELSE hourly END, 1) AS hourly,
         round_even(CASE WHEN fill THEN salary_from_k / eff / spm * 1000.0 ELSE hourly END * 12.0, 1) AS income_12h,
         CASE WHEN fill AND shift_hours IS NULL THEN dh ELSE shift_hours END AS shift_hours
  FROM m1_c
)"""

_M1_COLS = ["posting_id", "title", "employer", "schedule", "salary_from_k", "salary_to_k",
            "hourly", "income_12h", "shift_hours"]


def metrics_df(spark, sf_dir):
    return pay.pay_metrics(postings(spark, sf_dir))


@register("pay_metrics", with_postings(f"SELECT {', '.join(_M1_COLS)} FROM metrics", _M1_SQL_CTE))
def q_pay_metrics(spark, sf_dir):
    return metrics_df(spark, sf_dir).select(*_M1_COLS)


# ---------------------------------------------------------------- A1 ------
def _job_stats_sql(src: str) -> str:
    parts = []
    for col, p in marts.MEASURES:
        parts += [f"round_even(min({col}), 1) AS {p}_min", f"round_even(median({col}), 1) AS {p}_median",
                  f"round_even(CASE WHEN count({col}) > 0 THEN CAST(sum(CAST({col} AS DECIMAL(38,6))) AS DOUBLE) / count({col}) END, 1) AS {p}_mean", f"round_even(max({col}), 1) AS {p}_max"]
    return (f"SELECT CASE WHEN title = '' THEN {sql_str(lx.UNKNOWN_LABEL)} ELSE title END AS title, "
            f"count(*) AS n, {', '.join(parts)} FROM {src} WHERE title IS NOT NULL GROUP BY title")


@register("job_stats", with_postings(_job_stats_sql("metrics"), _M1_SQL_CTE))
def q_job_stats(spark, sf_dir):
    return marts.job_stats(metrics_df(spark, sf_dir))


# ---------------------------------------------------------------- A2 ------
@register("top_cities", with_postings(
    f"SELECT coalesce(city, {sql_str(lx.UNKNOWN_LABEL)}) AS city, count(*) AS n FROM postings "
    "GROUP BY 1 ORDER BY n DESC, city LIMIT 10"))
def q_top_cities(spark, sf_dir):
    return marts.top_cities(postings(spark, sf_dir))


# ---------------------------------------------------------------- A3 ------
_BENEFIT_ITEMS_SQL = """
b_parts AS (
  SELECT trim(p, ' ;,•-') AS part
  FROM (SELECT unnest(string_split(benefits, ';')) AS p FROM postings WHERE benefits IS NOT NULL)
),
b_items AS (
  SELECT unnest(CASE WHEN len(list_filter(list_transform(string_split(part, ','), lambda s: trim(s)), lambda s: s <> '')) > 1
                     THEN list_filter(list_transform(string_split(part, ','), lambda s: trim(s)), lambda s: s <> '')
                     ELSE [part] END) AS benefit
  FROM b_parts WHERE part <> ''
)"""


@register("top_benefits", with_postings(
    "SELECT benefit, count(*) AS n FROM b_items GROUP BY benefit ORDER BY n DESC, benefit LIMIT 15",
    _BENEFIT_ITEMS_SQL))
def q_top_benefits(spark, sf_dir):
    return marts.top_benefits(postings(spark, sf_dir))


# ---------------------------------------------------------------- A5 ------
@register("pub_hist", with_postings(
    "SELECT posted_date AS day, count(*) AS n FROM postings WHERE posted_date IS NOT NULL GROUP BY 1 ORDER BY 1"))
def q_pub_hist(spark, sf_dir):
    return marts.pub_hist(postings(spark, sf_dir))


# ---------------------------------------------------------------- A6 ------
@register("hourly_share", with_postings(
    "SELECT count(*) AS total, avg(CASE WHEN hourly IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
    " * 100.0 AS hourly_share_pct FROM metrics", _M1_SQL_CTE))
def q_hourly_share(spark, sf_dir):
    return marts.hourly_share(metrics_df(spark, sf_dir))


# ---------------------------------------------------------------- A7 / F5 -
_PLAUSIBLE_CTE = f"""
plaus AS (
  SELECT posting_id,
    CASE WHEN hourly > {lx.HOURLY_BOUNDS[0]} AND hourly < {lx.HOURLY_BOUNDS[1]} THEN hourly END AS hourly_ok,
    CASE WHEN m > {lx.MONTHLY_K_BOUNDS[0]} AND m < {lx.MONTHLY_K_BOUNDS[1]} THEN m END AS monthly_ok
  FROM (SELECT posting_id, CASE WHEN hourly > 0 THEN hourly END AS hourly,
          coalesce(CASE WHEN f IS NOT NULL AND t IS NOT NULL THEN (f + t) / 2.0 END, f, t) AS m
        FROM (SELECT posting_id, hourly, CASE WHEN salary_from_k > 0 THEN salary_from_k END AS f,
                     CASE WHEN salary_to_k > 0 THEN salary_to_k END AS t FROM postings))
)"""


@register("pay_summary", with_postings(
    "SELECT count(*) AS n, median(hourly_ok) AS hourly_median, min(hourly_ok) AS hourly_min, "
    "max(hourly_ok) AS hourly_max, median(monthly_ok) AS monthly_median, min(monthly_ok) AS monthly_min, "
    "max(monthly_ok) AS monthly_max FROM plaus", _PLAUSIBLE_CTE))
def q_pay_summary(spark, sf_dir):
    return marts.pay_summary(postings(spark, sf_dir))


@register("plausible_pay", with_postings("SELECT posting_id, hourly_ok, monthly_ok FROM plaus", _PLAUSIBLE_CTE))
def q_plausible_pay(spark, sf_dir):
    from ..operators.filters import plausible_pay
    return plausible_pay(postings(spark, sf_dir)).select("posting_id", "hourly_ok", "monthly_ok")


# ---------------------------------------------------------------- A8 ------
def _token_sql(col: str, k: int) -> str:
    return (
        f"SELECT token, n, n * 100.0 / (SELECT count(*) FROM postings) AS pct FROM ("
        f" SELECT token, count(*) AS n FROM ("
        f"  SELECT trim(unnest(regexp_split_to_array(regexp_replace(lower({col}), '\\s+', ' ', 'g'), '[;,]'))) AS token"
        f"  FROM postings WHERE {col} IS NOT NULL) WHERE token <> '' GROUP BY token ORDER BY n DESC, token LIMIT {k})")


@register("token_freq", with_postings(_token_sql("benefits", 8)))
def q_token_freq(spark, sf_dir):
    return marts.token_freq(postings(spark, sf_dir), "benefits")


@register("schedule_freq", with_postings(_token_sql("schedule", 8)))
def q_schedule_freq(spark, sf_dir):
    return marts.token_freq(postings(spark, sf_dir), "schedule")


# ---------------------------------------------------------------- A9 ------
@register("value_freq", with_postings(
    "SELECT value, n, n * 100.0 / (SELECT count(*) FROM postings) AS pct FROM ("
    " SELECT employment_raw AS value, count(*) AS n FROM postings WHERE employment_raw IS NOT NULL"
    " GROUP BY 1 ORDER BY n DESC, value LIMIT 6)"))
def q_value_freq(spark, sf_dir):
    return marts.value_freq(postings(spark, sf_dir), "employment_raw")


# ---------------------------------------------------------------- A10 -----
@register("coverage", with_postings(
    "SELECT count(*) AS records,"
    " count(*) FILTER (WHERE (salary_from IS NOT NULL AND salary_from <> 0) OR (salary_to IS NOT NULL AND salary_to <> 0))"
    " * 100.0 / greatest(count(*), 1) AS salary_pct,"
    " count(*) FILTER (WHERE hours_text IS NOT NULL AND hours_text <> '') * 100.0 / greatest(count(*), 1) AS hours_pct"
    " FROM postings"))
def q_coverage(spark, sf_dir):
    return marts.coverage(postings(spark, sf_dir))


# ---------------------------------------------------------------- A11 -----
@register("host_top", with_postings(
    "SELECT host, count(*) AS n FROM (SELECT regexp_extract(coalesce(url, ''), 'https?://([^/]+)/', 1) AS host"
    " FROM postings) WHERE host <> '' GROUP BY host ORDER BY n DESC, host LIMIT 5"))
def q_host_top(spark, sf_dir):
    return marts.host_top(postings(spark, sf_dir))


# ---------------------------------------------------------------- A12 -----
@register("source_counts", with_postings(
    "SELECT source, count(*) AS n FROM postings GROUP BY ROLLUP (source)"))
def q_source_counts(spark, sf_dir):
    return marts.source_counts(postings(spark, sf_dir))


# ---------------------------------------------------------------- O1 ------
@register("top_hourly", with_postings(
    "SELECT posting_id, title, employer, hourly,"
    " coalesce(CASE WHEN salary_from_k IS NOT NULL AND salary_to_k IS NOT NULL THEN (salary_from_k + salary_to_k) / 2.0 END,"
    " salary_from_k, salary_to_k) AS mid_salary_k, url"
    " FROM metrics WHERE hourly IS NOT NULL ORDER BY hourly DESC, seq LIMIT 10", _M1_SQL_CTE))
def q_top_hourly(spark, sf_dir):
    return marts.top_hourly(metrics_df(spark, sf_dir))


# ---------------------------------------------------------------- M2 ------
def _first_sched_sql(col: str) -> str:
    return f"trim(split_part(coalesce({col}, ''), ',', 1))"


_M2_CTE = f"""
m2_a AS (
  SELECT posting_id, salary_from_k, shift_hours, schedule, {_first_sched_sql('schedule')} AS sk FROM postings
),
m2_b AS (
  SELECT *, CASE WHEN shift_hours IS NOT NULL AND shift_hours > 0 THEN shift_hours
                 ELSE {schedule_hours_sql('sk', 'fetch')} END AS eff,
         {schedule_shifts_sql('sk', 'fetch')} AS spm FROM m2_a
),
m2 AS (
  SELECT posting_id, eff, CASE WHEN eff IS NOT NULL AND salary_from_k > 0 AND spm IS NOT NULL AND eff * spm > 0
                       AND salary_from_k / eff / spm * 1000.0 > 0
                      THEN round_even(salary_from_k / eff / spm * 1000.0, 1) END AS hourly
  FROM m2_b
)"""


@register("derive_rate", with_postings(
    "SELECT posting_id, hourly AS derived_hourly, round_even(hourly * eff, 1) AS derived_shift_pay,"
    f" coalesce(eff, {lx.FALLBACK_SHIFT_HOURS}) AS eff_hours FROM m2", _M2_CTE))
def q_derive_rate(spark, sf_dir):
    p = postings(spark, sf_dir)
    d = pay.derive_rate(F.col("salary_from_k"), F.col("shift_hours"), F.col("schedule"))
    return p.select("posting_id", d["hourly"].alias("derived_hourly"), d["shift_pay"].alias("derived_shift_pay"),
                    d["eff_hours"].alias("eff_hours"))
