"""Text-extraction queries over the postings view and the documents corpus.

Oracle regexes are RE2: ``\\b`` there is ASCII-only, so word edges next
to Cyrillic letters are written as explicit classes (``W0``/``W1``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..operators import extract as X
from ..operators import marts
from ..session import read_table
from ..sources.postings import postings
from .catalog import register
from .oracle import sql_str, with_postings

W = "[^0-9a-zа-яёієїґ_]"
W0 = f"(?:^|{W})"
W1 = f"(?:$|{W})"


def re2(p: str) -> str:
    """Java-style marker -> RE2: \\b next to letters becomes an explicit
    class, \\w the letter class (text is lower-cased first)."""
    p = p.replace(r"\w", "[0-9a-zа-яёієїґ_]")
    out, i = [], 0
    while i < len(p):
        if p.startswith(r"\b", i):
            nxt = p[i + 2:i + 3]
            out.append(W0 if (i == 0 or p[i - 1] in "(|") and nxt not in ("", ")", "|") else W1)
            i += 2
        else:
            out.append(p[i])
            i += 1
    return "".join(out)


def rx_any(patterns) -> str:
    return sql_str("(?:" + ")|(?:".join(re2(p) for p in patterns) + ")")


# ------------------------------------------------------------------ T5 ----
_SCHED_SEP = r"\s*[/\-–xх×]\s*"
_P_NUM = r"\b([1-9]\d?)" + _SCHED_SEP + r"([1-9]\d?)\b"
_P_WORD = W0 + "(" + X.NUM_WORDS + r")\s+через\s+(" + X.NUM_WORDS + ")" + W1
_P_DIG = r"\b([1-9]\d?)\s+через\s+([1-9]\d?)\b"
_P_VAHTA = W0 + r"вахт[0-9a-zа-яёієїґ_]*\s*([1-9]\d?)" + _SCHED_SEP + r"([1-9]\d?)\b"
_WORD_NUM = "CASE x " + " ".join(f"WHEN '{w}' THEN '{n}'" for w, n in lx.SCHEDULE_NUMBER_WORDS) + " END"
_WORD_NUM_B = _WORD_NUM.replace("CASE x", "CASE b[i]")


def _pairs_sql(p: str, conv_a="x", conv_b="b[i]") -> str:
    return (f"list_transform(regexp_extract_all(t, {sql_str(p)}, 1), lambda x, i: {conv_a} || '/' || "
            f"{conv_b.replace('b[i]', f'regexp_extract_all(t, {sql_str(p)}, 2)[i]')})")


def _phrase_sql() -> str:
    return " ".join(
        f"|| (CASE WHEN regexp_matches(t, {sql_str(re2(pat))}) THEN ['{val}'] ELSE []::VARCHAR[] END)"
        for pat, val in lx.SCHEDULE_PHRASES)


SCHED_CTE = f"""
sched_t AS (
  SELECT posting_id, seq, schedule, translate(lower(coalesce(full_text, '') || ' '), '–х', '-x') AS t FROM postings
),
sched_l AS (
  SELECT posting_id, seq, schedule,
    {_pairs_sql(_P_NUM)} || {_pairs_sql(_P_WORD, _WORD_NUM, _WORD_NUM_B)}
    || {_pairs_sql(_P_DIG)} || {_pairs_sql(_P_VAHTA)} {_phrase_sql()} AS l
  FROM sched_t
),
sched AS (
  SELECT posting_id, seq, schedule,
    CASE WHEN len(l) > 0 THEN array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ', ') END AS schedules
  FROM sched_l
)"""


@register("schedule_mentions", with_postings("SELECT posting_id, schedules FROM sched", SCHED_CTE))
def q_schedule_mentions(spark, sf_dir):
    p = postings(spark, sf_dir).select("posting_id", "full_text")
    return X.with_schedule_list(p, "full_text").select("posting_id", "schedules")


@register("sched_sane", with_postings(
    "SELECT posting_id, CASE WHEN regexp_full_match(trim(s), '\\d+/\\d+(?:\\s*,\\s*\\d+/\\d+)*') THEN trim(s) END AS schedule"
    " FROM (SELECT posting_id, coalesce(schedules, schedule) AS s FROM sched)", SCHED_CTE))
def q_sched_sane(spark, sf_dir):
    p = X.with_schedule_list(postings(spark, sf_dir).select("posting_id", "full_text", "schedule"), "full_text")
    return p.select("posting_id", X.sane_schedule(F.coalesce(F.col("schedules"), F.col("schedule"))).alias("schedule"))


# ------------------------------------------------------------------ T7 ----
_LANG_SQL = ("CASE WHEN regexp_matches(lower(coalesce({c}, '')), '[ієїґ]') THEN 'uk' "
             "WHEN regexp_matches(lower(coalesce({c}, '')), '[а-яё]') THEN 'ru' "
             "WHEN regexp_matches(lower(coalesce({c}, '')), '[a-z]') THEN 'en' END")


@register("script_lang",
          "SELECT doc_id, lang, " + _LANG_SQL.format(c="text") + " AS script_lang FROM documents")
def q_script_lang(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return d.select("doc_id", "lang", X.script_lang(F.col("text")).alias("script_lang"))


@register("posting_lang", with_postings(
    "SELECT " + _LANG_SQL.format(c="full_text") + " AS script_lang, count(*) AS n FROM postings GROUP BY 1"))
def q_posting_lang(spark, sf_dir):
    p = postings(spark, sf_dir)
    return p.groupBy(X.script_lang(F.col("full_text")).alias("script_lang")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ T8 ----
def _first_label_sql(expr: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({expr}, {sql_str(p)}) THEN {sql_str(l)}" for p, l in rules) + " END"


@register("pay_freq", with_postings(
    f"SELECT posting_id, {_first_label_sql('lower(full_text)', lx.PAY_FREQUENCY_RULES)} AS pay_frequency FROM postings"))
def q_pay_freq(spark, sf_dir):
    return postings(spark, sf_dir).select("posting_id", X.pay_frequency(F.col("full_text")).alias("pay_frequency"))


_EMP_SQL = ("CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(full_text, '')), {sql_str(p)}) THEN {sql_str(l)}"
                                for p, l in lx.EMPLOYMENT_TEXT_RULES)
            + f" WHEN regexp_matches(lower(coalesce(employment_raw, '')), {sql_str(lx.EMPLOYMENT_NAME_RULE[0])})"
            + f" THEN {sql_str(lx.EMPLOYMENT_NAME_RULE[1])} END")


@register("employment", with_postings(f"SELECT posting_id, {_EMP_SQL} AS employment FROM postings"))
def q_employment(spark, sf_dir):
    p = postings(spark, sf_dir)
    return p.select("posting_id", X.employment_type(F.col("full_text"), F.col("employment_raw")).alias("employment"))


def _clean_sql(c: str) -> str:
    t = f"regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g')"
    t = f"regexp_replace({t}, '[\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')"
    t = f"translate({t}, '  ', '  ')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


_FORMAT_CHUNKS = ["employment_raw", "duties_raw", "format_text", "benefits", "hours_text"]


def _format_sql() -> str:
    blob = "concat_ws(' ', " + ", ".join(f"lower({_clean_sql(c)})" for c in _FORMAT_CHUNKS) + ")"
    whens = []
    for stems, label in lx.WORK_FORMAT_RULES:
        cond = " OR ".join(f"contains(blob, {sql_str(s)})" for s in stems)
        whens.append(f"WHEN {cond} THEN {sql_str(label)}")
    return f"(SELECT posting_id, CASE {' '.join(whens)} ELSE '' END AS work_format FROM (SELECT posting_id, {blob} AS blob FROM postings))"


def _format_col():
    return X.work_format([F.col(c) for c in _FORMAT_CHUNKS])


@register("work_format", with_postings(f"SELECT posting_id, work_format FROM {_format_sql()}"))
def q_work_format(spark, sf_dir):
    return postings(spark, sf_dir).select("posting_id", _format_col().alias("work_format"))


# ------------------------------------------------------------------ T9 ----
def _exp_bucket_sql(c: str) -> str:
    t = f"lower({_clean_sql(c)})"
    return (f"CASE WHEN {t} = '' THEN '' "
            f"WHEN contains({t}, 'без опыта') OR contains({t}, 'не требуется') THEN {sql_str(lx.EXPERIENCE_NONE_LABEL)} "
            f"WHEN regexp_matches({t}, '(1|один).*?([23]|тр)[^\\d]*год') THEN '1-3' "
            f"WHEN regexp_matches({t}, '(3|три).*?6') OR contains({t}, '3-6') THEN '3-6' "
            f"WHEN regexp_matches({t}, '(6|шест).*(лет|год)') THEN '6+' "
            f"WHEN contains({t}, 'от 1') THEN '1-3' WHEN contains({t}, 'от 3') THEN '3-6' "
            f"WHEN contains({t}, 'от 5') OR contains({t}, 'от 6') THEN '6+' ELSE {t} END")


@register("experience_bucket", with_postings(
    f"SELECT posting_id, {_exp_bucket_sql('experience_raw')} AS experience FROM postings"))
def q_experience_bucket(spark, sf_dir):
    return postings(spark, sf_dir).select("posting_id", X.experience_bucket(F.col("experience_raw")).alias("experience"))


def _share_sql(expr_sql: str) -> str:
    return ("SELECT category, round_even(n * 100.0 / sum(n) OVER (), 1) AS share_pct FROM ("
            f" SELECT coalesce(v, {sql_str(lx.UNKNOWN_LABEL)}) AS category, count(*) AS n FROM ({expr_sql}) GROUP BY 1)")


@register("exp_share", with_postings(_share_sql(
    f"SELECT {_exp_bucket_sql('experience_raw')} AS v FROM postings")))
def q_exp_share(spark, sf_dir):
    return marts.share(postings(spark, sf_dir), X.experience_bucket(F.col("experience_raw")))


@register("format_share", with_postings(_share_sql(f"SELECT work_format AS v FROM {_format_sql()}")))
def q_format_share(spark, sf_dir):
    return marts.share(postings(spark, sf_dir), _format_col())


# ------------------------------------------------------------------ T10 ---
def _benefit_tags_sql(c: str) -> str:
    t = f"lower(coalesce({c}, ''))"
    items = ", ".join(f"CASE WHEN contains({t}, {sql_str(k)}) THEN {sql_str(k.upper() if k == 'дмс' else k)} END"
                      for k in lx.BENEFIT_KEYWORDS)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


_BT_SRC = "concat_ws(' ', benefits, full_text)"


@register("benefit_tags", with_postings(
    f"SELECT posting_id, CASE WHEN len(l) > 0 THEN array_to_string(l, ', ') END AS benefit_tags FROM"
    f" (SELECT posting_id, {_benefit_tags_sql(_BT_SRC)} AS l FROM postings)"))
def q_benefit_tags(spark, sf_dir):
    p = postings(spark, sf_dir).select("posting_id", F.lower(F.concat_ws(" ", "benefits", "full_text")).alias("_t"))
    return p.select("posting_id", X.benefit_tags(F.col("_t")).alias("benefit_tags"))


# ------------------------------------------------------------------ F6 ----
def _gross_sql(c: str) -> str:
    norm = f"trim(regexp_replace(translate(lower(coalesce({c}, '')), ' ', ' '), '\\s+', ' ', 'g'))"
    coll = f"regexp_replace({norm}, '\\s+', '', 'g')"
    neg, pos = rx_any(lx.GROSS_NEGATIVE), rx_any(lx.GROSS_POSITIVE)
    mark = " OR ".join(f"contains({coll}, {sql_str(m)})" for m in lx.GROSS_COLLAPSED_MARKERS)
    return (f"CASE WHEN {norm} = '' THEN false WHEN regexp_matches({norm}, {neg}) OR regexp_matches({coll}, {neg}) "
            f"THEN false WHEN regexp_matches({norm}, {pos}) OR regexp_matches({coll}, {pos}) THEN true ELSE ({mark}) END")


@register("gross_flag", with_postings(f"SELECT posting_id, {_gross_sql('pay_text')} AS is_gross FROM postings"))
def q_gross_flag(spark, sf_dir):
    return postings(spark, sf_dir).select("posting_id", X.gross_flag(F.col("pay_text")).alias("is_gross"))


# ------------------------------------------------------------------ F7 ----
def _match_form_sql(c: str) -> str:
    return (f"regexp_replace(lower(trim(regexp_replace(translate(coalesce({c}, ''), ' ', ' '), '\\s+', ' ', 'g'))),"
            " '\\s+', ' ', 'g')")


@register("rate_flag", with_postings(
    f"SELECT posting_id, regexp_matches({_match_form_sql('full_text')}, {rx_any(lx.HOURLY_MARKERS)}) AS is_hourly,"
    f" regexp_matches({_match_form_sql('full_text')}, {rx_any(lx.SHIFT_MARKERS)}) AS is_shift FROM postings"))
def q_rate_flag(spark, sf_dir):
    p = postings(spark, sf_dir).select("posting_id", X._match_form(F.col("full_text")).alias("_m"))
    return p.select("posting_id", X.is_hourly_rate(F.col("_m"), prepared=True).alias("is_hourly"),
                    X.is_shift_rate(F.col("_m"), prepared=True).alias("is_shift"))


# ------------------------------------------------------------------ T3 ----
def _period_sql(c: str) -> str:
    t = f"lower(coalesce({c}, ''))"
    rules = [(r"в\s*час|/\s*ч|за\s*час|per\s*hour|hourly", "per_hour"), (r"за\s*смен|per\s*shift", "per_shift"),
             (r"в\s*день|per\s*day", "per_day"), (r"в\s*недел", "per_week"), (r"в\s*месяц|per\s*month", "per_month")]
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, {sql_str(p)}) THEN '{v}'" for p, v in rules) + " END"


@register("salary_period", with_postings(f"SELECT posting_id, {_period_sql('description')} AS period FROM postings"))
def q_salary_period(spark, sf_dir):
    return postings(spark, sf_dir).select("posting_id", X.salary_period(F.col("description")).alias("period"))


# ------------------------------------------------------------------ T11 ---
def _duties_sql(c: str) -> str:
    txt = f"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
    starts = []
    for h in lx.DUTY_HEADINGS:
        for sep in (":", " :"):
            starts.append(f"CASE WHEN strpos(lower(txt), {sql_str(h + sep)}) > 0 THEN "
                          f"strpos(lower(txt), {sql_str(h + sep)}) - 1 + {len(h) + len(sep)} END")
    ends = ", ".join(f"CASE WHEN strpos(lower(tail), {sql_str(nh + ':')}) > 0 THEN strpos(lower(tail), {sql_str(nh + ':')}) - 1 END"
                     for nh in lx.DUTY_NEXT_HEADINGS)
    return f"""(SELECT posting_id,
        CASE WHEN st IS NULL THEN coalesce(
               CASE WHEN regexp_matches(txt, '^[—\\-•]') AND trim(txt, ' -•—\t') <> '' THEN trim(txt, ' -•—\t') END,
               CASE WHEN txt <> '' THEN txt END)
             WHEN body <> '' THEN body END AS duties
      FROM (SELECT *, trim(regexp_replace(substr(tail, 1, coalesce(least({ends}), length(tail))), '^[\\s\\-•—]+', '')) AS body
            FROM (SELECT *, substr(txt, st + 1) AS tail
                  FROM (SELECT posting_id, txt, coalesce({', '.join(starts)}) AS st
                        FROM (SELECT posting_id, {txt} AS txt FROM postings)))))"""


@register("duties", with_postings(f"SELECT posting_id, duties FROM {_duties_sql('duties_raw')}"))
def q_duties(spark, sf_dir):
    return X.with_duties(postings(spark, sf_dir).select("posting_id", "duties_raw"), "duties_raw").select(
        "posting_id", "duties")


# ------------------------------------------------------------------ T12 ---
AS_OF = "1998-08-02 12:00:00"


def _reldate_sql(c: str) -> str:
    t = f"lower(trim(coalesce({c}, '')))"
    asof = f"TIMESTAMP '{AS_OF}'"
    hh = f"regexp_extract({t}, '(\\d{{1,2}}):(\\d{{2}})', 1)"
    mm = f"regexp_extract({t}, '(\\d{{1,2}}):(\\d{{2}})', 2)"
    has_t = f"({hh} <> '' AND CAST({hh} AS INT) < 24 AND CAST({mm} AS INT) < 60)"

    def comb(d):
        return (f"(CASE WHEN {has_t} THEN {d} + to_hours(CAST({hh} AS INT)) + to_minutes(CAST({mm} AS INT)) "
                f"ELSE {d} END)")
    day0 = f"date_trunc('day', {asof})"
    n = lambda p: f"regexp_extract({t}, '(\\d+)\\s*(?:{p})', 1)"
    d_re = "'(\\d{1,2})\\.(\\d{1,2})(?:\\.(\\d{2,4}))?'"
    dd, mo, yy = (f"regexp_extract({t}, {d_re}, {k})" for k in (1, 2, 3))
    year = f"(CASE WHEN {yy} = '' THEN year({asof}) WHEN length({yy}) = 2 THEN CAST({yy} AS INT) + 2000 ELSE CAST({yy} AS INT) END)"
    mk = (f"(CASE WHEN CAST({mo} AS INT) BETWEEN 1 AND 12 AND CAST({dd} AS INT) >= 1 AND "
          f"CAST({dd} AS INT) <= day(last_day(make_date({year}, CAST({mo} AS INT), 1))) THEN "
          f"CAST(make_date({year}, CAST({mo} AS INT), CAST({dd} AS INT)) AS TIMESTAMP) END)")
    return f"""CASE WHEN {t} = '' THEN NULL
      WHEN contains({t}, 'сегодня') THEN {comb(day0)}
      WHEN contains({t}, 'вчера') THEN {comb(f"({day0} - INTERVAL 1 DAY)")}
      WHEN contains({t}, 'назад') AND {n('час|ч')} <> '' THEN {asof} - to_hours(CAST({n('час|ч')} AS INT))
      WHEN contains({t}, 'назад') AND {n('дн|day')} <> '' THEN {comb(f"date_trunc('day', {asof} - to_days(CAST({n('дн|day')} AS INT)))")}
      WHEN contains({t}, 'назад') AND {n('нед|week')} <> '' THEN {comb(f"date_trunc('day', {asof} - to_days(7 * CAST({n('нед|week')} AS INT)))")}
      WHEN {dd} <> '' THEN {comb(mk)} END"""


@register("rel_dates", with_postings(f"SELECT posting_id, {_reldate_sql('posted_raw')} AS posted_at FROM postings"))
def q_rel_dates(spark, sf_dir):
    p = postings(spark, sf_dir)
    return p.select("posting_id", X.relative_datetime(F.col("posted_raw"), F.lit(AS_OF).cast("timestamp")).alias("posted_at"))


# Dates in words that the postings' own raw dates don't use (a form a key).
DATE_FORMS = ["{n} минут назад", "{d} мая", "{d} декабря 1997 в 10:3{m}", "3{m} февраля", "2000000000 дней назад", "2000000000 часов назад",
              "01.02.99999", "{d}.0{m1}.97 7:0{m}", "{n} день назад 09:15", "{d} авг.", "99999999999 минут назад", "{m1} weeks назад", "скоро"]
_FORM_ARGS = {"n": "ok % 50", "d": "ok % 31 + 1", "m": "ok % 3", "m1": "ok % 9 + 1"}


def _form_case() -> str:
    def sql(form):
        out = sql_str(form)
        for k, v in _FORM_ARGS.items():
            out = out.replace("{" + k + "}", f"' || ({v}) || '")
        return out
    return f"(CASE (ok + ln * 5) % {len(DATE_FORMS)} " + " ".join(f"WHEN {i} THEN {sql(f)}" for i, f in enumerate(DATE_FORMS)) + " END)"


def _words_date_sql(c: str) -> str:
    """Dates in words, for the forms above (amounts are bounded before use)."""
    t = f"lower(trim(coalesce({c}, '')))"
    asof, day0 = f"TIMESTAMP '{AS_OF}'", f"date_trunc('day', TIMESTAMP '{AS_OF}')"
    hh, mm = (f"TRY_CAST(regexp_extract({t}, '(\\d{{1,2}}):(\\d{{2}})', {k}) AS INT)" for k in (1, 2))
    comb = lambda d: f"(CASE WHEN {hh} < 24 AND {mm} < 60 THEN {d} + to_hours({hh}) + to_minutes({mm}) ELSE {d} END)"

    def amount(words, bound):
        raw = f"regexp_extract({t}, '(\\d+)\\s*(?:{words})', 1)"
        n = f"TRY_CAST({raw} AS INT)"
        return f"contains({t}, 'назад') AND {raw} <> ''", f"(CASE WHEN {n} <= {bound} THEN {n} END)"

    def made(y, m, d):
        return (f"(CASE WHEN {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND day(last_day(make_date({y}, {m}, 1)))"
                f" THEN CAST(make_date({y}, {m}, {d}) AS TIMESTAMP) END)")
    mins, hours, days, weeks = (amount(w, b) for w, b in (("мин|min", 999999999), ("час|ч|hour", 16000000), ("дн|ден|day", 690000), ("нед|week", 98000)))
    dot = "'(\\d{1,2})\\.(\\d{1,2})(?:\\.(\\d+))?'"
    dd, mo, yy = (f"regexp_extract({t}, {dot}, {k})" for k in (1, 2, 3))
    year = (f"(CASE WHEN {yy} = '' THEN year({asof}) WHEN length({yy}) = 2 THEN CAST({yy} AS INT) + 2000 WHEN length({yy}) <= 4 THEN CAST({yy} AS INT) END)")
    named = "'(\\d{1,2})\\s+(" + "|".join(stem for stem, _ in lx.MONTH_STEMS) + ")[а-яa-z]*\\.?(?:\\s+(\\d{4})(?:[^0-9]|$))?'"
    nd, stem, ny = (f"regexp_extract({t}, {named}, {k})" for k in (1, 2, 3))
    month = "(CASE " + " ".join(f"WHEN regexp_matches({stem}, '{s}') THEN {m}" for s, m in lx.MONTH_STEMS) + " END)"
    nyear = f"(CASE WHEN {ny} <> '' THEN CAST({ny} AS INT) ELSE year({asof}) - (CASE WHEN {month} > month({asof}) THEN 1 ELSE 0 END) END)"
    return f"""CASE WHEN {t} = '' THEN NULL
      WHEN {mins[0]} THEN {asof} - to_minutes({mins[1]}) WHEN {hours[0]} THEN {asof} - to_hours({hours[1]})
      WHEN {days[0]} THEN {comb(f"({day0} - to_days({days[1]}))")} WHEN {weeks[0]} THEN {comb(f"({day0} - to_days(7 * {weeks[1]}))")}
      WHEN {dd} <> '' THEN {comb(made(year, f"CAST({mo} AS INT)", f"CAST({dd} AS INT)"))}
      WHEN {nd} <> '' THEN {comb(made(nyear, month, f"CAST({nd} AS INT)"))} END"""


_WORDS_CTE = f"worded AS (SELECT *, {_form_case()} AS raw FROM (SELECT *, seq.l_orderkey AS ok, seq.l_linenumber AS ln FROM postings))"
RANGE_FORMS = ["за 2 недели", "30", "последние 36 часов", "0", "за всё время", "3 мес.", "1 year", "99999999999"]
RANGE_FORM_HOURS = [14 * 24, 30 * 24, 36, None, None, 90 * 24, 365 * 24, None]


def _worded(p):
    keyed = p.withColumns({"ok": F.col("seq.l_orderkey"), "ln": F.col("seq.l_linenumber")})
    return keyed.withColumn("raw", F.expr(_form_case()))


@register("rel_dates_words", with_postings(f"SELECT posting_id, raw, {_words_date_sql('raw')} AS posted_at FROM worded", _WORDS_CTE))
def q_rel_dates_words(spark, sf_dir):
    """Month names, minutes, odd years and amounts beyond any calendar."""
    p = _worded(postings(spark, sf_dir))
    return p.select("posting_id", "raw", X.relative_datetime(F.col("raw"), F.lit(AS_OF).cast("timestamp_ntz")).alias("posted_at"))


@register("fresh_range", with_postings(
    "SELECT posting_id, posted_at, word FROM (SELECT posting_id, " + _words_date_sql("raw") + " AS posted_at, ["
    + ", ".join(sql_str(w) for w in RANGE_FORMS) + "][1 + pk % 8] AS word, ["
    + ", ".join("NULL" if h is None else str(h) for h in RANGE_FORM_HOURS) + "][1 + pk % 8] AS h"
    " FROM (SELECT *, seq.l_partkey AS pk FROM worded))"
    f" WHERE posted_at IS NULL OR h IS NULL OR posted_at >= TIMESTAMP '{AS_OF}' - to_hours(h)", _WORDS_CTE))
def q_fresh_range(spark, sf_dir):
    """Freshness by a range in words, stated per row."""
    from ..operators.dates import fresh_range
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    words = F.array(*[F.lit(w) for w in RANGE_FORMS])
    p = _worded(postings(spark, sf_dir)).select("posting_id", X.relative_datetime(F.col("raw"), as_of).alias("posted_at"),
                                                F.element_at(words, (F.col("seq.l_partkey") % 8 + 1).cast("int")).alias("word"))
    return fresh_range(p, F.col("posted_at"), as_of, F.col("word"))


# ------------------------------------------------------------------ T4 ----
@register("shift_len")
def q_shift_len(spark, sf_dir):
    """Shift-length mentions resolved per posting (rows-only check; the
    fixture tests pin the original examples)."""
    p = postings(spark, sf_dir).select("posting_id", F.concat_ws(". ", "hours_text", "description").alias("_txt"))
    s = X.with_shift_length(p, "_txt", "_s")
    return s.select("posting_id", F.col("_s.hours").alias("shift_hours"), F.col("_s.source").alias("source"),
                    F.col("_s.confidence").alias("confidence"), F.col("_s.ambiguous").alias("ambiguous"))


# ------------------------------------------------------------------ T3 ----
_HOUR_RE2 = ("((?:^|[^\\d])(\\d[\\d\\s]{1,}(?:[\\.,]\\d+)?)\\s*(?:₽|р|руб)?\\s*(?:/|за|в)?\\s*(?:ч|час|hour|hr))"
             + W1)
EXPLICIT_PAY_CTE = f"""
ep0 AS (
  SELECT posting_id, seq, translate(translate(lower(coalesce(full_text, '')), ' ', ' '), '–—−', '---') AS t FROM postings
),
ep1 AS (
  SELECT *, regexp_extract(t, {sql_str(_HOUR_RE2)}, 1) AS whole, regexp_extract(t, {sql_str(_HOUR_RE2)}, 2) AS hnum,
            regexp_extract(t, {sql_str(X.SHIFT_PAY_RE)}, 0) AS swhole, regexp_extract(t, {sql_str(X.SHIFT_PAY_RE)}, 1) AS snum
  FROM ep0
),
ep2 AS (
  SELECT posting_id, seq,
    CASE WHEN whole <> '' AND NOT regexp_matches(substr(t, greatest(strpos(t, whole) - 24, 1),
                                 length(whole) + 48 + least(strpos(t, whole) - 25, 0)), '(мес|месяц|год)')
         THEN TRY_CAST(replace(regexp_replace(hnum, '[^\\d\\.,]', '', 'g'), ',', '.') AS DOUBLE) END AS h0,
    CASE WHEN swhole <> '' THEN TRY_CAST(replace(regexp_replace(snum, '[^\\d\\.,]', '', 'g'), ',', '.') AS DOUBLE) END AS s0
  FROM ep1
)"""


@register("explicit_pay", with_postings(
    "SELECT posting_id, CASE WHEN h0 IS NOT NULL AND h0 <> 0 THEN round_even(h0, 2) END AS hourly,"
    " CASE WHEN s0 IS NOT NULL AND s0 <> 0 THEN round_even(s0, 2) END AS shift_pay FROM ep2", EXPLICIT_PAY_CTE))
def q_explicit_pay(spark, sf_dir):
    e = postings(spark, sf_dir).select("posting_id", X.explicit_pay(F.col("full_text")).alias("_e"))
    return e.select("posting_id", F.col("_e.hourly").alias("hourly"), F.col("_e.shift_pay").alias("shift_pay"))


# ------------------------------------------------------------------ T1 ----
def rate_blob(p):
    return F.concat_ws(" ", "full_text", "title", "duties_raw", "benefits", "schedule", "employment_raw")


def rates_df(spark, sf_dir):
    p = postings(spark, sf_dir).select("url", "seq", rate_blob(None).alias("text"))
    return X.rate_mentions(p, "url", "text", order="seq")


# The texts come from known keys, so the expected rates are stated from the
# keys, not by a second set of patterns: one rate a posting, quantity * 10 +
# 150, hourly on even lines and per shift on odd ones, first posting per URL.
RATES_CTE = """
rate0 AS (SELECT url, seq, CASE WHEN seq.l_linenumber % 2 = 0 THEN 'hourly' ELSE 'shift' END AS type,
  CAST(seq.l_quantity AS INTEGER) * 10 + 150 AS v FROM postings WHERE url IS NOT NULL),
rates AS (SELECT url, type, CAST(v AS VARCHAR) || ' ₽' AS value, CAST(v AS DOUBLE) AS min, CAST(v AS DOUBLE) AS max, 'RUB' AS currency,
  'Оплата ' || CAST(v AS VARCHAR) || CASE WHEN type = 'hourly' THEN ' руб/час' ELSE ' ₽ за смену' END AS raw
  FROM (SELECT url, type, arg_min(v, seq) AS v FROM rate0 GROUP BY url, type))"""


@register("rate_mentions", with_postings("SELECT url, type, value, min, max, currency, raw FROM rates", RATES_CTE))
def q_rate_mentions(spark, sf_dir):
    """First parsable hourly / shift rate per URL."""
    return rates_df(spark, sf_dir)


# ------------------------------------------------------------------ P15 ---
@register("rates_wide", with_postings(
    "SELECT CASE WHEN type = 'hourly' THEN value ELSE '' END AS hourly_value,"
    " CASE WHEN type = 'shift' THEN value ELSE '' END AS shift_value, trim(url) AS url FROM rates", RATES_CTE))
def q_rates_wide(spark, sf_dir):
    r = rates_df(spark, sf_dir).where(F.trim(F.coalesce("value", F.lit(""))) != "")
    v = F.trim(F.col("value"))
    return r.select(F.when(F.lower("type") == "hourly", v).otherwise(F.lit("")).alias("hourly_value"),
                    F.when(F.lower("type") == "shift", v).otherwise(F.lit("")).alias("shift_value"),
                    F.trim(F.coalesce("url", F.lit(""))).alias("url"))


# ------------------------------------------------------------------ T6 ----
def hours_contexts(spark, sf_dir):
    """Contexts of every posting: the hours parameter (weight 6) and the
    description text (weight 10)."""
    p = postings(spark, sf_dir)
    ctx = lambda text, selector, weight: F.struct(F.col(text).alias("text"), F.lit(selector).alias("selector"), F.col("url").alias("url"),
                                                  F.lit(weight).alias("weight"))
    both = F.array(ctx("hours_text", "params:hours", 6), ctx("description", "description", 10))
    return p.select("posting_id", F.filter(both, lambda c: c["text"].isNotNull()).alias("contexts"))


# What the hours texts say, by the key (part % 7) that chose them: 2 is the
# text with weekdays, 4 the one around the clock, 6 none; the others leave the
# schedule and the shift length of the description (from supplier and part).
@register("working_hours", with_postings(
    "SELECT posting_id, CASE WHEN k = 2 THEN '10/16' ELSE CAST(seq.l_suppkey % 5 + 1 AS VARCHAR) || '/' ||"
    " CAST(seq.l_suppkey % 3 + 1 AS VARCHAR) END AS schedule_hint,"
    " CASE k WHEN 2 THEN 1.0 WHEN 4 THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence, 'ru' AS lang,"
    " CASE WHEN k = 2 THEN 'Sun: closed' END AS notes, CASE WHEN k = 2 THEN 6 ELSE 0 END AS n_day_rules, k = 4 AS is_247,"
    " CASE k WHEN 2 THEN 9.0 WHEN 4 THEN NULL ELSE seq.l_partkey % 5 + 8 END::DOUBLE AS shift_hours,"
    " CASE WHEN k = 6 THEN 1 ELSE 2 END AS n_matches FROM (SELECT *, seq.l_partkey % 7 AS k FROM postings)"))
def q_working_hours(spark, sf_dir):
    """Working hours per posting."""
    from ..operators.hours import working_hours
    wh = working_hours(hours_contexts(spark, sf_dir), facts=["raw_matches", "schedule_hint", "confidence", "lang", "notes", "normalized"])
    return wh.select("posting_id", "schedule_hint", "confidence", "lang", "notes",
                     F.size("normalized.by_days").alias("n_day_rules"), F.col("normalized.is_247").alias("is_247"),
                     F.col("normalized.shift_based.shift_length_hours").alias("shift_hours"),
                     F.size("raw_matches").alias("n_matches"))


@register("weekday_hours", with_postings(
    "SELECT posting_id, d.day AS day, d.s AS start, d.e AS \"end\" FROM postings, (VALUES ('Mon', '09:00', '18:00'), ('Tue', '09:00', '18:00'),"
    " ('Wed', '09:00', '18:00'), ('Thu', '09:00', '18:00'), ('Fri', '09:00', '18:00'), ('Sat', '10:00', '16:00')) AS d(day, s, e)"
    " WHERE seq.l_partkey % 7 = 2"))
def q_weekday_hours(spark, sf_dir):
    """Per-day opening hours exploded from the working-hours result."""
    from ..operators.hours import working_hours
    wh = working_hours(hours_contexts(spark, sf_dir), facts=["normalized"])
    # outer, then filtered: a filter inferred from the rules would parse every context again
    return wh.select("posting_id", F.explode_outer("normalized.by_days").alias("d")).where(F.col("d").isNotNull()).select(
        "posting_id", "d.day", "d.start", "d.end")


# Each context is one line, so each has one candidate or none; by the key the
# hours text triggers as 247 (4), by days (2), flexible (5) or by its words.
@register("working_hours_log", with_postings(
    "SELECT posting_id, pos, selector, raw, reason, confidence, chosen FROM ("
    " SELECT posting_id, 0 AS pos, 'params:hours' AS selector, hours_text AS raw, ['section-range', 'section-range', 'day-time', 'shift-length', '247', 'flexible'][k + 1] AS reason,"
    "  [0.6, 0.6, 1.0, 0.6, 0.9, 0.3][k + 1]::DOUBLE AS confidence, k IN (2, 4) AS chosen FROM q WHERE k < 6"
    " UNION ALL SELECT posting_id, CASE WHEN k < 6 THEN 1 ELSE 0 END, 'description', description,"
    "  CASE WHEN contains(description, 'смен') THEN 'shift-length' ELSE 'schedule' END, 0.6::DOUBLE, k NOT IN (2, 4) FROM q)",
    "q AS (SELECT *, seq.l_partkey % 7 AS k FROM postings)"))
def q_working_hours_log(spark, sf_dir):
    """Every candidate that the decision on a posting's working hours looked at."""
    from ..operators.hours import working_hours
    wh = working_hours(hours_contexts(spark, sf_dir), facts=["log"])
    # outer, then filtered, as in weekday_hours
    return wh.select("posting_id", F.posexplode_outer("log").alias("pos", "e")).where(F.col("pos").isNotNull()).select("posting_id", "pos", "e.*")


# ------------------------------------------------------------------ T9 (phrase) --
def _exp_phrase_sql(c: str) -> str:
    t = f"lower(coalesce({c}, ''))"
    pats = X.EXPERIENCE_PATTERNS
    seg = " ".join(f"WHEN regexp_extract({t}, {sql_str(p)}, 0) <> '' THEN regexp_extract({t}, {sql_str(p)}, {{g}})"
                   for p in pats)
    def pick(g):
        return "(CASE " + seg.replace("{g}", str(g)) + " END)"
    num = f"TRY_CAST(replace({pick(1)}, ',', '.') AS DOUBLE)"
    vstr = (f"(CASE WHEN {num} = floor({num}) THEN CAST(CAST(floor({num}) AS BIGINT) AS VARCHAR)"
            f" ELSE CAST({num} AS VARCHAR) END)")
    unit = (f"(CASE WHEN starts_with({pick(2)}, 'месяц') THEN (CASE WHEN {vstr} = '1' THEN 'месяц' ELSE 'месяцев' END)"
            f" WHEN {vstr} = '1' THEN 'год' WHEN {vstr} IN ('2', '3', '4') THEN 'года' ELSE 'лет' END)")
    prefix = f"(CASE WHEN regexp_matches({pick(0)}, 'от|не менее') THEN 'от ' ELSE '' END)"
    return (f"CASE WHEN {t} = '' THEN NULL WHEN contains({t}, 'без опыта') THEN 'Без опыта'"
            f" WHEN regexp_matches({t}, 'опыт(?: работы)?\\s*(?:от\\s*)?(полгода|пол\\s*года)') THEN 'от 0.5 года'"
            f" WHEN {pick(0)} IS NOT NULL THEN trim({prefix} || {vstr} || ' ' || {unit})"
            f" WHEN contains({t}, 'опыт') THEN 'Опыт требуется' END")


@register("experience_phrase", with_postings(
    f"SELECT posting_id, {_exp_phrase_sql('experience_raw')} AS experience FROM postings"))
def q_experience_phrase(spark, sf_dir):
    p = postings(spark, sf_dir)
    return p.select("posting_id", X.experience_phrase(F.col("experience_raw")).alias("experience"))


# ------------------------------------------------------------------ T10 (conditions) --
@register("conditions_merge", with_postings(
    "SELECT posting_id, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)),"
    " lower(x)) = i), '; ') AS conditions FROM ("
    " SELECT posting_id, list_filter(list_transform(string_split_regex(coalesce(duties_raw, ''), '[\\n;]')"
    " || string_split(coalesce(benefits, ''), ';'), lambda s: " + _clean_sql("s") + "), lambda s: s <> '') AS l"
    " FROM postings)"))
def q_conditions_merge(spark, sf_dir):
    """Conditions text: condition lines and benefit items, cleaned, with
    case-insensitive repeats dropped (first kept), joined with '; '."""
    p = postings(spark, sf_dir)
    items = F.concat(F.split(F.coalesce("duties_raw", F.lit("")), r"[\n;]"), F.split(F.coalesce("benefits", F.lit("")), ";"))
    return p.select("posting_id", X.join_unique(items).alias("conditions"))


# ------------------------------------------------------------------ T4 oracle --
_TR2 = ("(?:(?:^|" + W + ")с\\s*)?(\\d{1,2})(?::(\\d{1,2}))?\\s*(?:до|по|-|—|–)\\s*(\\d{1,2})(?::(\\d{1,2}))?")
_HR2 = ("\\b(\\d{1,2}(?:[\\.,]\\d+)?)\\s*(?:-|‑)?\\s*(?:час(?:ов|а|овой|овая|овые|овый)?|ч\\.?(?:$|" + W + "))")


def _any_sql(c, words):
    return "(" + " OR ".join(f"contains({c}, {sql_str(w)})" for w in words) + ")"


SHIFT_LEN_CTE = f"""
sl0 AS (
  SELECT posting_id, seq, trim(regexp_replace(replace(replace(translate(translate(lower(concat_ws('. ', hours_text, description)),
         ' ', ' '), '–—−', '---'), 'ч.', 'ч'), 'час.', 'час'), '\\s+', ' ', 'g')) AS t
  FROM postings
),
sl1 AS (
  SELECT posting_id, seq, t,
    regexp_extract_all(t, {sql_str(_TR2)}, 0) AS tm, list_transform(regexp_split_to_array(t, {sql_str(_TR2)}), lambda f: length(f)) AS tf,
    regexp_extract_all(t, {sql_str(_HR2)}, 0) AS hm, list_transform(regexp_split_to_array(t, {sql_str(_HR2)}), lambda f: length(f)) AS hf
  FROM sl0
),
tr_rows AS (
  SELECT seq, t, m, i, CAST(coalesce(list_sum(tf[1:i]), 0)
         + coalesce(list_sum(list_transform(tm[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT seq, t, tf, tm, unnest(tm) AS m, generate_subscripts(tm, 1) AS i FROM sl1)
),
tr_c AS (
  SELECT seq, i, 3.0::DOUBLE AS w, round_even(dur, 2) AS h, 'description_time_range' AS src, 'high' AS conf FROM (
    SELECT *, CASE WHEN d0 <= 0 THEN d0 + 24.0 ELSE d0 END AS dur FROM (
      SELECT *, (eh + em / 60.0) - (sh + sm / 60.0) AS d0 FROM (
        SELECT seq, i, trim(m) AS raw, substr(t, s + length(m) + 1, 6) AS tail,
          CAST(regexp_extract(m, {sql_str(_TR2)}, 1) AS INTEGER) AS sh,
          coalesce(TRY_CAST(nullif(regexp_extract(m, {sql_str(_TR2)}, 2), '') AS INTEGER), 0) AS sm,
          CAST(regexp_extract(m, {sql_str(_TR2)}, 3) AS INTEGER) AS eh,
          coalesce(TRY_CAST(nullif(regexp_extract(m, {sql_str(_TR2)}, 4), '') AS INTEGER), 0) AS em
        FROM tr_rows)))
  WHERE (contains(raw, ':') OR starts_with(raw, 'с ')) AND NOT {_any_sql('tail', lx.SHIFT_TAIL_STOP)}
    AND sh BETWEEN 0 AND 23 AND eh BETWEEN 0 AND 23 AND dur BETWEEN 0.5 AND 24.0
),
hr_rows AS (
  SELECT seq, t, m, i,
         CAST(coalesce(list_sum(hf[1:i]), 0) + coalesce(list_sum(list_transform(hm[1:i - 1], lambda x: length(x))), 0)
              AS BIGINT) AS s,
         length(m) - (CASE WHEN regexp_matches(m, {sql_str('ч\\.?' + W + '$')}) THEN 1 ELSE 0 END) AS len
  FROM (SELECT seq, t, hf, hm, unnest(hm) AS m, generate_subscripts(hm, 1) AS i FROM sl1)
),
hr_c AS (
  SELECT seq, 1000 + i AS i,
    (CASE WHEN {_any_sql('ctx', lx.SHIFT_BAD_WORDS)} THEN -3.0 ELSE 0.0 END)
    + (CASE WHEN {_any_sql('ctx', lx.SHIFT_GOOD_WORDS)} THEN 3.0 ELSE 0.0 END)
    + (CASE WHEN contains(ctx, 'смен') THEN 1.5 ELSE 0.0 END)
    + (CASE WHEN contains(ctx, 'рабоч') OR contains(ctx, 'граф') THEN 1.0 ELSE 0.0 END)
    + val / 50.0 AS w,
    val AS h,
    CASE WHEN contains(ctx, 'смен') OR contains(ctx, 'граф') THEN 'description_explicit_hours' ELSE 'heuristic' END AS src,
    CASE WHEN contains(ctx, 'смен') OR contains(ctx, 'граф') THEN 'high' ELSE 'medium' END AS conf
  FROM (
    SELECT seq, i, TRY_CAST(replace(regexp_extract(m, {sql_str(_HR2)}, 1), ',', '.') AS DOUBLE) AS val,
           substr(t, s + len + 1, 6) AS tail,
           substr(t, greatest(s - 25, 0) + 1, s + len + 25 - greatest(s - 25, 0)) AS ctx
    FROM hr_rows)
  WHERE val BETWEEN 1 AND 24 AND NOT {_any_sql('tail', lx.SHIFT_TAIL_STOP)}
),
sl_best AS (
  SELECT seq, arg_max(struct_pack(w := w, h := h, src := src, conf := conf), struct_pack(w := w, h := h, o := -i)) AS b,
         count(DISTINCT round_even(h, 2)) > 1 AS amb
  FROM (SELECT * FROM tr_c UNION ALL SELECT * FROM hr_c) GROUP BY seq
)"""


def _shift_len_oracle() -> str:
    return with_postings(
        "SELECT p.posting_id, CASE WHEN b.w > -1.0 THEN b.h END AS shift_hours,"
        " CASE WHEN b.w > -1.0 THEN b.src ELSE 'unresolved' END AS source,"
        " CASE WHEN b.w > -1.0 THEN (CASE WHEN amb THEN 'medium' ELSE b.conf END) ELSE 'low' END AS confidence,"
        " coalesce(b.w > -1.0 AND amb, false) AS ambiguous"
        " FROM postings p LEFT JOIN sl_best s ON p.seq = s.seq", SHIFT_LEN_CTE)


from . import catalog as _catalog  # noqa: E402

_catalog.REGISTRY["shift_len"] = _catalog.Query("shift_len", _catalog.REGISTRY["shift_len"].build, _shift_len_oracle())
