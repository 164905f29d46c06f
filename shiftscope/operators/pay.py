"""Pay metric jobs: columns over a postings table (M1–M5).

All are narrow projections (no shuffle); schedule lookups are literal
maps evaluated in codegen.  Rounding is half-even (``bround``), the rule
of the original float rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import lexicon as lx
from ..functions.lookups import schedule_hours, schedule_shifts
from ..functions.text import clean_text, fmt_g


def _truthy(c: Column) -> Column:
    """Python truthiness of a number: not NULL and not 0."""
    return c.isNotNull() & (c != 0)


def first_schedule(schedule: Column) -> Column:
    """First entry of a comma list, trimmed ('' when NULL)."""
    return F.trim(F.split(F.coalesce(schedule, F.lit("")), ",", 2).getItem(0))


# -- M1 -------------------------------------------------------------------
def pay_metrics(df: DataFrame, salary_from_k="salary_from_k", salary_to_k="salary_to_k",
                hourly="hourly", shift_hours="shift_hours", schedule="schedule",
                profile: str = "metrics") -> DataFrame:
    """Metric fill of the analytics step.

    hour := from_k / effective shift / shifts per month * 1000 when the
    hour is missing (effective shift: own if > 0 else the schedule default);
    a missing shift length takes the default used; the 12 h income is
    always hour * 12 from the unrounded hour; everything rounds to 0.1.
    The schedule must match exactly (trimmed)."""
    sched = F.trim(F.coalesce(F.col(schedule), F.lit("")))
    spm = schedule_shifts(sched, profile)
    dflt = schedule_hours(sched, profile)
    own = F.col(shift_hours)
    eff = F.when(own.isNotNull() & (own > 0), own).otherwise(dflt)
    fill = (F.col(hourly).isNull() & F.col(salary_from_k).isNotNull()
            & eff.isNotNull() & (eff > 0) & spm.isNotNull() & (spm > 0))
    hour = F.when(fill, F.col(salary_from_k) / eff / spm * 1000.0).otherwise(F.col(hourly))
    shift_out = F.when(fill & own.isNull(), dflt).otherwise(own)
    return df.withColumns({
        "hourly": F.bround(hour, 1),
        "income_12h": F.bround(hour * 12.0, 1),
        "shift_hours": shift_out,
        salary_from_k: F.bround(F.col(salary_from_k), 1),
        salary_to_k: F.bround(F.col(salary_to_k), 1),
    })


# -- M2 -------------------------------------------------------------------
def derive_rate(salary_from_k: Column, shift_hours: Column, schedule: Column,
                profile: str = "fetch") -> Column:
    """Struct(hourly, shift_pay, eff_hours) priced from the monthly salary.

    Only the first schedule of a list counts; only ``from`` is used."""
    key = first_schedule(schedule)
    dflt = schedule_hours(key, profile)
    spm = schedule_shifts(key, profile)
    eff = F.when(shift_hours.isNotNull() & (shift_hours > 0), shift_hours).otherwise(dflt)
    ok = eff.isNotNull() & salary_from_k.isNotNull() & (salary_from_k > 0) & spm.isNotNull() & (eff * spm > 0)
    raw = salary_from_k / eff / spm * 1000.0
    hour = F.when(ok & (raw > 0), F.bround(raw, 1))
    return F.struct(
        hour.alias("hourly"),
        F.bround(hour * eff, 1).alias("shift_pay"),
        F.coalesce(eff, F.lit(lx.FALLBACK_SHIFT_HOURS)).alias("eff_hours"),
    )


# -- M3 -------------------------------------------------------------------
def rate_cascade(df: DataFrame, explicit_hourly="hourly", shift_payment="shift_pay",
                 shift_len="shift_len", shift_ambiguous="shift_ambiguous",
                 shift_confidence="shift_confidence", salary_from_k="salary_from_k",
                 salary_to_k="salary_to_k", schedule="schedule") -> DataFrame:
    """Hourly rate with its method label and the 12-hour income.

    explicit hourly -> shift pay / shift hours (not when ambiguous) ->
    derived from the monthly salary; a missing shift length takes the
    schedule default; 12 h income = shift pay for a 12 h shift, else
    hour * 12."""
    exp_h, pay = F.col(explicit_hourly), F.col(shift_payment)
    slen, amb = F.col(shift_len), F.coalesce(F.col(shift_ambiguous), F.lit(False))
    first = (F.when(_truthy(exp_h), F.struct(F.bround(exp_h, 2).alias("r"), F.lit("exact:explicit_hourly").alias("m")))
              .when(pay.isNull(), F.struct(F.lit(None).cast("double").alias("r"), F.lit("unresolved:no_shift_payment").alias("m")))
              .when(slen.isNull(), F.struct(F.lit(None).cast("double").alias("r"), F.lit("unresolved:shift_duration").alias("m")))
              .when(amb, F.struct(F.lit(None).cast("double").alias("r"), F.lit("unresolved:ambiguous_shift_duration").alias("m")))
              .when(slen <= 0, F.struct(F.lit(None).cast("double").alias("r"), F.lit("unresolved:invalid_shift_duration").alias("m")))
              .otherwise(F.struct(F.bround(pay / slen, 2).alias("r"),
                                  F.when(F.col(shift_confidence) == "high", F.lit("exact:shift_payment_div_shift_hours"))
                                   .otherwise(F.lit("heuristic:shift_payment_div_shift_hours")).alias("m"))))
    sched = F.col(schedule)
    len_out = F.coalesce(slen, F.when(F.coalesce(sched, F.lit("")) != "",
                                      schedule_hours(first_schedule(sched), "fetch")))
    # each step is a column of its own, so the next ones read it instead of
    # stating it again
    d = df.withColumns({"_rc_first": first, "_rc_len": len_out})
    d = d.withColumn("_rc_derived", derive_rate(F.col(salary_from_k), F.col("_rc_len"), sched)["hourly"])
    rate, len_out, derived = F.col("_rc_first.r"), F.col("_rc_len"), F.col("_rc_derived")
    d = d.withColumn("_rc_use", rate.isNull() & (_truthy(F.col(salary_from_k)) | _truthy(F.col(salary_to_k))) & _truthy(derived))
    d = d.withColumn("_rc_hour", F.when(F.col("_rc_use"), derived).otherwise(rate))
    hour = F.col("_rc_hour")
    method = F.when(F.col("_rc_use"), F.lit("derived:salary_based")).otherwise(F.col("_rc_first.m"))
    income = F.when(_truthy(pay) & (len_out == 12.0), pay).when(_truthy(hour), hour * 12.0)
    return d.withColumns({"hourly_rate": hour, "hourly_method": method, "shift_len_out": len_out, "income_12h": income}).drop(
        "_rc_first", "_rc_len", "_rc_derived", "_rc_use", "_rc_hour")


def text_rate(df: DataFrame, pay_text: str, hours_text: str, schedule_text: str, schedule: str = "schedule",
              salary_from_k: str = "salary_from_k", salary_to_k: str = "salary_to_k") -> DataFrame:
    """``rate_cascade`` fed from a posting's own texts: explicit amounts (T3),
    shift length (T4) and schedules (T5; ``schedule`` where the text names
    none).  Row-local: no shuffle, whatever the size."""
    from ..functions import scan
    from . import extract as X
    at_hours, at_schedule = df.columns.index(hours_text), df.columns.index(schedule_text)

    def parse(rows):
        shifts = [scan.shift_length(scan.shift_norm(t)) for t in scan.strings(rows.column(at_hours))]
        return [*map(list, zip(*shifts)), [scan.schedule_list(scan.schedule_text(t)) for t in scan.strings(rows.column(at_schedule))]]

    found = StructType.fromDDL("_len double, _confidence string, _ambiguous boolean, _found string")
    d = scan.parse_rows(df, [], found, parse)
    d = d.withColumn("_pay", X.explicit_pay(F.col(pay_text))).withColumns({
        "_hourly": F.col("_pay.hourly"), "_shift_pay": F.col("_pay.shift_pay"), "_sched": F.coalesce("_found", schedule)})
    out = rate_cascade(d, "_hourly", "_shift_pay", "_len", "_ambiguous", "_confidence", salary_from_k, salary_to_k, "_sched")
    return out.withColumn("schedule_out", F.col("_sched")).drop(
        "_found", "_pay", "_hourly", "_shift_pay", "_len", "_ambiguous", "_confidence", "_sched")


# -- M5 -------------------------------------------------------------------
def normalize_schedule(raw: Column) -> Column:
    """First 'N/M' (spaces removed) of a free-text schedule, else ''."""
    m = F.regexp_extract(F.lower(F.coalesce(raw, F.lit(""))), r"(\d+\s*/\s*\d+)", 1)
    return F.regexp_replace(m, " ", "")


def shift_params(df: DataFrame, schedule_hint="schedule_hint", pattern="shift_pattern",
                 hours_structured="shift_length_hours", raw_matches="raw_matches",
                 config: DataFrame | None = None) -> DataFrame:
    """Schedule, hours per shift, shifts per month and the calc trail.

    schedule: from the hint, else the structured pattern; hours:
    structured (> 0) -> first 'N час/ч' of the raw matches -> schedule
    default; shifts per month: schedule default.  ``config`` is the merged
    configuration (``relational.schedule_config``), joined by schedule; without
    one the built-in board table is compiled into the plan."""
    hint = normalize_schedule(F.col(schedule_hint))
    sched = F.when(hint != "", hint).otherwise(normalize_schedule(F.col(pattern)))
    hs = F.col(hours_structured)
    structured = F.when(hs.isNotNull() & (hs > 0), hs)
    text_h = F.aggregate(
        F.transform(F.coalesce(F.col(raw_matches), F.array().cast("array<string>")),
                    lambda m: F.regexp_extract(F.lower(clean_text(m)), r"(\d{1,2})\s*(?:час|ч)", 1)),
        F.lit(""), lambda acc, x: F.when(acc != "", acc).otherwise(x))
    text_hours = F.when(text_h != "", text_h.cast("double"))
    if config is None:
        spm_of, hours_of = schedule_shifts(sched, "board"), schedule_hours(sched, "board")
    else:
        from .relational import schedule_lookup
        named = config.select("schedule", F.nullif("shifts_per_month", F.lit(0.0)).alias("_cfg_shifts"),
                              F.nullif("hours_per_shift", F.lit(0.0)).alias("_cfg_hours"))
        df = schedule_lookup(df.withColumn("_cfg_schedule", sched), named, "_cfg_schedule")
        sched, spm_of, hours_of = F.col("_cfg_schedule"), F.col("_cfg_shifts"), F.col("_cfg_hours")
    dflt_h = F.when(sched != "", hours_of)
    hours = F.coalesce(structured, text_hours, dflt_h)
    spm = F.when(sched != "", spm_of)
    fmt = fmt_g
    notes = F.array_compact(F.array(
        F.when(structured.isNotNull(), F.concat(F.lit("часы/смену="), fmt(structured), F.lit(" (из normalized)"))),
        F.when(structured.isNull() & text_hours.isNotNull(),
               F.concat(F.lit("часы/смену="), fmt(text_hours), F.lit(" (из текста)"))),
        F.when(structured.isNull() & text_hours.isNull() & dflt_h.isNotNull(),
               F.concat(F.lit("часы/смену="), fmt(dflt_h), F.lit(" (по умолчанию)"))),
        F.when(spm.isNotNull(), F.concat(F.lit("смен/мес="), fmt(spm), F.lit(" (по умолчанию)"))),
    ))
    return df.withColumns({"schedule": sched, "hours_per_shift": hours, "shifts_per_month": spm,
                           "param_notes": notes}).drop("_cfg_schedule", "_cfg_shifts", "_cfg_hours")


# -- M4 -------------------------------------------------------------------
def monthly_pay(df: DataFrame, pay_from="pay_from", pay_to="pay_to", period="salary_period",
                currency="salary_currency", hours="hours_per_shift", shifts="shifts_per_month") -> DataFrame:
    """Period conversion to monthly thousands, hourly rate, 12 h income.

    month: /1000; shift/day: x shifts; hour: x hours x shifts; week: x 4.33;
    from > to swaps; a currency other than RUB nulls everything.  The
    hourly rate is from_k / hours / shifts * 1000 (0.1), the 12 h income
    hour * 12 (0.1); a per-shift/per-day amount is the income otherwise."""
    lo, hi = F.col(pay_from), F.col(pay_to)
    swap = lo.isNotNull() & hi.isNotNull() & (lo > hi)
    f = F.when(swap, hi).otherwise(lo)
    t = F.when(swap, lo).otherwise(hi)
    per = F.lower(F.coalesce(F.col(period), F.lit("per_month")))
    cur = F.upper(F.coalesce(F.col(currency), F.lit("RUB")))
    h, s = F.col(hours), F.col(shifts)
    is_month = per.isin("per_month", "month", "monthly")
    is_shift = per.isin("per_shift", "shift")
    is_hour = per.isin("per_hour", "hour")
    is_day = per.isin("per_day", "day")
    is_week = per.isin("per_week", "week")

    def conv(x):
        return (F.when(is_month, x / 1000.0)
                 .when((is_shift | is_day) & _truthy(s), x * s / 1000.0)
                 .when(is_hour & _truthy(s) & _truthy(h), x * h * s / 1000.0)
                 .when(is_week, x * lx.WEEKS_PER_MONTH / 1000.0))
    fk = conv(f)
    tk = conv(t)
    fk = F.when(fk >= 0, fk)
    tk = F.when(tk >= 0, tk)
    base_hour = F.when(is_hour & f.isNotNull(), f)
    hour = F.when(fk.isNotNull() & _truthy(h) & _truthy(s), F.bround(fk / h / s * 1000.0, 1)).otherwise(base_hour)
    base_income = (F.when(is_shift & _truthy(f), f)
                    .when(is_day & _truthy(s) & f.isNotNull(), f))
    income = (F.when(hour.isNotNull(), F.bround(hour * 12.0, 1))
               .when(base_income.isNotNull(), base_income)
               .when(_truthy(f) & per.isin("per_shift", "per_day"), f))
    ok = (cur == "") | (cur == "RUB")
    null = F.lit(None).cast("double")
    return df.withColumns({
        "salary_from_k": F.when(ok, fk).otherwise(null),
        "salary_to_k": F.when(ok, tk).otherwise(null),
        "hourly_rate": F.when(ok, hour).otherwise(null),
        "shift_income": F.when(ok, income).otherwise(null),
    })


def salary_notes(df: DataFrame, pay_from="salary_from", pay_to="salary_to", period="salary_period",
                 currency="salary_currency") -> DataFrame:
    """Notes of the period conversion (swap, unsupported currency, max-only
    hourly rate, negative values cleared), in the order they arise."""
    lo, hi = F.col(pay_from), F.col(pay_to)
    swap = lo.isNotNull() & hi.isNotNull() & (lo > hi)
    f = F.when(swap, hi).otherwise(lo)
    t = F.when(swap, lo).otherwise(hi)
    cur = F.upper(F.coalesce(F.nullif(F.col(currency), F.lit("")), F.lit("RUB")))
    ok = cur == "RUB"
    per = F.lower(F.coalesce(F.col(period), F.lit("per_month")))
    notes = F.array_compact(F.array(
        F.when(swap, F.lit("ЗП от > ЗП до — значения поменяны местами")),
        F.when(~ok, F.concat(F.lit("Валюта "), cur, F.lit(" не поддерживается"))),
        F.when(ok & per.isin("per_hour", "hour") & f.isNull() & t.isNotNull(),
               F.lit("Ставка в час дана только максимумом — расчёт пропущен")),
        F.when(ok & (f < 0), F.lit("ЗП от < 0 — очищено")),
        F.when(ok & (t < 0), F.lit("ЗП до < 0 — очищено")),
    ))
    return df.withColumn("salary_notes", notes)


def calc_trail(param_notes: Column, salary_notes: Column, schedule: Column, hours: Column, shifts: Column) -> Column:
    """Ordered, de-duplicated calculation trail joined with '; '."""
    markers = F.array_compact(F.array(
        F.when(schedule != "", F.concat(F.lit("График="), schedule)),
        F.when(_truthy(hours), F.concat(F.lit("часы/смену="), fmt_g(hours))),
        F.when(_truthy(shifts), F.concat(F.lit("смен/мес="), fmt_g(shifts))),
    ))
    return F.array_join(F.array_distinct(F.concat(param_notes, salary_notes, markers)), "; ")


# -- P13 ------------------------------------------------------------------
BOARD_SOURCE = "avito.ru"


def legacy_row(df: DataFrame) -> DataFrame:
    """Flat board record (``navigate.flat``) -> export row: RUB-only salary in
    thousands (0.001), explicit hourly/shift pay from the period, the rate
    cascade (M3) with the structured shift length or the one that the schedule
    hint states, the 12 h income, the sanitised schedule, the notes of the
    calculation and the human note."""
    from . import extract as X
    cur = F.upper(F.coalesce(F.col("salary_currency"), F.lit("")))
    rub = cur.isin("", "RUB")
    lo, hi, per = F.col("salary_from"), F.col("salary_to"), F.col("salary_period")
    n_vals = F.when(lo.isNotNull(), 1).otherwise(0) + F.when(hi.isNotNull(), 1).otherwise(0)
    hint = F.coalesce("schedule_hint", F.lit(""))
    d = df.withColumns({
        "salary_from_k": F.when(rub, F.bround(lo / 1000.0, 3)), "salary_to_k": F.when(rub, F.bround(hi / 1000.0, 3)),
        "_mean": F.when(n_vals > 0, (F.coalesce(lo, F.lit(0.0)) + F.coalesce(hi, F.lit(0.0))) / n_vals),
        "_len": F.coalesce("shift_length_hours", F.when(hint.rlike(r"\d\s*(?:ч|[-–—:])"), X.shift_length(hint)["hours"])),
        "schedule": F.coalesce(F.nullif(hint, F.lit("")), F.col("shift_pattern"))})
    d = d.withColumns({"hourly": F.when(per == "per_hour", F.col("_mean")), "shift_pay": F.when(per.isin("per_shift", "per_day"), F.col("_mean")),
                       "_sure": F.lit("high"), "_unsure": F.lit(False)})
    d = rate_cascade(d, shift_len="_len", shift_confidence="_sure", shift_ambiguous="_unsure")
    hour, pay, out, method = (F.col(c) for c in ("hourly_rate", "shift_pay", "shift_len_out", "hourly_method"))
    derived = method == "derived:salary_based"
    shown = lambda c, none: F.coalesce(c.cast("string"), F.lit(none))
    notes = F.concat_ws(" | ", (
        F.when(_truthy(F.col("hourly")), F.lit("hourly rate explicitly found in text")).when(pay.isNull(), F.lit("no shift payment found"))
         .when(F.col("_len").isNull(), F.lit("shift duration unresolved")).when(F.col("_len") <= 0, F.lit("invalid shift duration"))
         .otherwise(F.concat(F.lit("computed from shift payment "), pay.cast("string"), F.lit(" / "), F.col("_len").cast("string"), F.lit("h")))),
        F.when(derived, F.concat(F.lit("derived from monthly salary (schedule="), shown(F.col("schedule"), "None"), F.lit(", shift="),
                                 shown(out, "None"), F.lit("h)"))))
    sched = F.trim("schedule")
    return d.select(
        "external_id", F.coalesce("title", F.lit(lx.NO_TITLE)).alias("title"), F.col("employer_name").alias("employer"), "published",
        "salary_from_k", "salary_to_k",
        F.when(_truthy(hour), hour * 12.0).when(_truthy(pay) & _truthy(out), pay * (12.0 / out)).alias("income_12h"),
        hour.alias("hourly"), method.alias("hourly_method"), out.alias("shift_hours"),
        F.when(F.col("_len").isNotNull(), "structured_field").otherwise("unresolved").alias("shift_source"),
        F.when(F.col("_len").isNotNull(), "high").otherwise("low").alias("shift_confidence"), notes.alias("parsing_notes"),
        "experience", F.col("employment_type").alias("employment"),
        F.when(sched.rlike(r"^\d+/\d+(?:\s*,\s*\d+/\d+)*$"), sched).alias("schedule"), F.lit(None).cast("string").alias("pay_frequency"),
        F.array_join(F.coalesce("benefits", F.array().cast("array<string>")), ", ").alias("benefits"), F.col("duties_raw").alias("duties"),
        F.col("url_detail").alias("url"),
        F.concat_ws("; ", F.when(F.coalesce("schedule", F.lit("")) == "", F.lit("График не распознан")),
                    F.when(out.isNull(), F.lit("Длительность смены не указана"))).alias("note"),
        F.lit(BOARD_SOURCE).alias("source"))
