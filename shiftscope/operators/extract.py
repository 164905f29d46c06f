"""Text-extraction jobs (T1–T14, F6–F8): corpus -> mentions -> resolved.

Every extractor is a Column expression (or a DataFrame job built from
them) over any ``(id, text)`` DataFrame, evaluated with Spark's JVM regex
engine inside whole-stage codegen; nothing leaves the JVM.  Java regex
needs ``(?U)`` for Unicode ``\\w``/``\\b`` on Cyrillic, so every pattern
here carries it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.lookups import currency_code, lookup
from ..functions.text import NBSP, _WS_RE, _where_needed, clean_text, first_label, let, rate_text, strip_html
from .dates import relative_datetime  # noqa: F401

U = "(?iU)"


# Word edges on lower-cased Latin and Cyrillic text, as classes: much cheaper
# than Unicode-aware, case-folding boundaries.
WORD_CLASS = "0-9a-zа-яёієїґ_"
E0, E1 = f"(?<![{WORD_CLASS}])", f"(?![{WORD_CLASS}])"
GAP = r"[\s\u00a0\u202f]"


def _rx(p: str) -> Column:
    return F.lit(U + p)


def _pairs(t: Column, pattern: str, literal: Column, fmt=None) -> Column:
    """Array of 'a/b' strings from all (group1, group2) matches in lower-cased
    text; ``literal`` is a cheap test without which there can be none.

    One scan for the whole matches; the groups are then taken from each
    short match string, so the lambda never re-reads the full text."""
    conv = fmt or (lambda x: x)
    ms = F.regexp_extract_all(t, F.lit(pattern), 0)
    found = F.transform(ms, lambda m: F.concat(conv(F.regexp_extract(m, pattern, 1)), F.lit("/"),
                                               conv(F.regexp_extract(m, pattern, 2))))
    return F.when(literal, found).otherwise(F.array().cast("array<string>"))


# -- T5 / F8 ---------------------------------------------------------------
SCHED_SEP = r"\s*[/\-–xх×]\s*"
NUM_WORDS = "|".join(sorted((w for w, _ in lx.SCHEDULE_NUMBER_WORDS), key=len, reverse=True))


def schedule_text(text: Column, src: Column | None = None) -> Column:
    """The normal form schedules are searched in: text + ' ' + source,
    lower-cased, '–' -> '-', Cyrillic 'х' -> 'x'."""
    src = src if src is not None else F.lit("")
    t = F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(src, F.lit("")))
    return F.replace(F.replace(F.lower(t), F.lit("–"), F.lit("-")), F.lit("х"), F.lit("x"))


def with_schedule_list(df: DataFrame, text: str, out: str = "schedules") -> DataFrame:
    """``schedule_list`` with the normal form staged as a column, so its
    nine regex passes read one precomputed string."""
    d = df.withColumn("_st", schedule_text(F.col(text)))
    return d.withColumn(out, schedule_list(F.col("_st"), prepared=True)).drop("_st")


def schedule_list(text: Column, src: Column | None = None, prepared: bool = False) -> Column:
    """All schedules mentioned ('2/2, 5/2, 1/3'), first-seen order; NULL if none.
    ``prepared``: ``text`` already is ``schedule_text(...)``."""
    if not prepared:
        return let(schedule_text(text, src), lambda t: schedule_list(t, prepared=True))
    t = text
    word_num = lambda x: lookup([(w, str(n)) for w, n in lx.SCHEDULE_NUMBER_WORDS], x)
    number, through = "([1-9][0-9]?)", t.contains("через")
    sep = SCHED_SEP.replace(r"\s", GAP)
    pair = E0 + number + sep + number + E1
    parts = [
        _pairs(t, pair, t.rlike(f"[0-9]{sep}[1-9]")),
        _pairs(t, f"{E0}({NUM_WORDS}){GAP}+через{GAP}+({NUM_WORDS}){E1}", through, word_num),
        _pairs(t, f"{E0}{number}{GAP}+через{GAP}+{number}{E1}", through),
        _pairs(t, f"{E0}вахт[{WORD_CLASS}]*{GAP}*{number}{sep}{number}{E1}", t.contains("вахт")),
    ]
    for pat, val in lx.SCHEDULE_PHRASES:
        first = re.match("[а-я]+", pat).group()
        plain = pat.replace(r"\w", f"[{WORD_CLASS}]").replace(r"\s", GAP)
        parts.append(F.when(t.contains(first) & t.rlike(plain), F.array(F.lit(val))).otherwise(F.array().cast("array<string>")))
    return let(F.array_distinct(F.concat(*parts)), lambda found: F.when(F.size(found) > 0, F.array_join(found, ", ")))


def sane_schedule(val: Column) -> Column:
    v = F.trim(val)
    return F.when(v.rlike(r"^\d+/\d+(?:\s*,\s*\d+/\d+)*$"), v)


# -- T7 -------------------------------------------------------------------
def script_lang(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return (F.when(low.rlike("[ієїґ]"), F.lit("uk"))
             .when(low.rlike("[а-яё]"), F.lit("ru"))
             .when(low.rlike("[a-z]"), F.lit("en")))


# -- T8 -------------------------------------------------------------------
def pay_frequency(text: Column) -> Column:
    return first_label(F.lower(text), lx.PAY_FREQUENCY_RULES)


def employment_type(text: Column, name: Column | None = None) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    out = first_label(t, lx.EMPLOYMENT_TEXT_RULES)
    if name is not None:
        pat, label = lx.EMPLOYMENT_NAME_RULE
        out = out.when(F.lower(F.coalesce(name, F.lit(""))).rlike(pat), F.lit(label))
    return out


def work_format(chunks: list[Column], schedule: Column | None = None) -> Column:
    blob = F.concat_ws(" ", *[F.lower(clean_text(c)) for c in chunks])
    out = None
    for stems, label in lx.WORK_FORMAT_RULES:
        cond = None
        for s in stems:
            c = blob.contains(s)
            cond = c if cond is None else (cond | c)
        if label == "вахта" and schedule is not None:
            cond = cond | (F.lower(F.coalesce(schedule, F.lit(""))) == "вахта")
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(""))


# -- T9 -------------------------------------------------------------------
def experience_bucket(raw: Column) -> Column:
    """'без опыта' | '1-3' | '3-6' | '6+' | the cleaned text | ''."""
    t = F.lower(clean_text(raw))
    return (F.when(t == "", F.lit(""))
             .when(t.contains("без опыта") | t.contains("не требуется"), F.lit(lx.EXPERIENCE_NONE_LABEL))
             .when(t.rlike(U + r"(1|один).*?([23]|тр)[^\d]*год"), F.lit("1-3"))
             .when(t.rlike(U + r"(3|три).*?6") | t.contains("3-6"), F.lit("3-6"))
             .when(t.rlike(U + r"(6|шест).*(лет|год)"), F.lit("6+"))
             .when(t.rlike("от 1(?![0-9])"), F.lit("1-3"))
             .when(t.rlike("от 3(?![0-9])"), F.lit("3-6"))
             .when(t.rlike("от [56](?![0-9])") | t.rlike("от [1-9][0-9]"), F.lit("6+"))
             .otherwise(t))


_EXP_UNITS = r"(год|лет|года|месяц|месяца|месяцев)"
EXPERIENCE_PATTERNS = [
    r"опыт(?: работы)?\s*(?:не менее\s*)?(?:от\s*)?(\d+(?:[\.,]\d+)?)\s*" + _EXP_UNITS,
    r"от\s*(\d+(?:[\.,]\d+)?)\s*" + _EXP_UNITS + r"\s*(?:опыта|стажа)",
    r"(\d+(?:[\.,]\d+)?)\s*" + _EXP_UNITS + r"\s*опыт",
]


def experience_phrase(text: Column) -> Column:
    """'Без опыта' | 'от 0.5 года' | '[от ]N год/года/лет/месяц/месяцев' |
    'Опыт требуется' | NULL."""
    t = F.lower(F.coalesce(text, F.lit("")))
    found = None
    for p in EXPERIENCE_PATTERNS:
        seg = F.regexp_extract(t, U + p, 0)
        st = F.struct(seg.alias("seg"), F.regexp_extract(t, U + p, 1).alias("num"),
                      F.regexp_extract(t, U + p, 2).alias("unit"))
        found = F.when(seg != "", st) if found is None else found.when(seg != "", st)
    num = F.regexp_replace(found["num"], ",", ".").try_cast("double")
    vstr = F.when(num == F.floor(num), F.floor(num).cast("long").cast("string")).otherwise(num.cast("string"))
    unit = (F.when(found["unit"].startswith("месяц"),
                   F.when(vstr == "1", F.lit("месяц")).otherwise(F.lit("месяцев")))
             .when(vstr == "1", F.lit("год"))
             .when(vstr.isin("2", "3", "4"), F.lit("года"))
             .otherwise(F.lit("лет")))
    prefix = F.when(found["seg"].rlike("от|не менее"), F.lit("от ")).otherwise(F.lit(""))
    phrase = F.trim(F.concat(prefix, vstr, F.lit(" "), unit))
    return (F.when(t == "", F.lit(None).cast("string"))
             .when(t.contains("без опыта"), F.lit("Без опыта"))
             .when(t.rlike(U + r"опыт(?: работы)?\s*(?:от\s*)?(полгода|пол\s*года)"), F.lit("от 0.5 года"))
             .when(found.isNotNull(), phrase)
             .when(t.contains("опыт"), F.lit("Опыт требуется")))


# -- T10 ------------------------------------------------------------------
def benefit_tags(text: Column) -> Column:
    """Keywords found (list order, 'ДМС' upper-cased), ', '-joined; NULL if none."""
    # the keywords differ, so no tag can repeat; concat_ws skips the absent ones
    t = F.lower(F.coalesce(text, F.lit("")))
    tags = F.concat_ws(", ", *[F.when(t.contains(kw), F.lit(kw.upper() if kw == "дмс" else kw)) for kw in lx.BENEFIT_KEYWORDS])
    return F.nullif(tags, F.lit(""))


BENEFIT_STEMS = r"питани|обеды|форма|медкниж|страхов|проезд|сменн\w* график"


def benefit_lines(text: Column) -> Column:
    """Lines (stripped of ' -•\\t') that mention a benefit stem, found in one
    pass: a match begins where a line does and takes the line to its end."""
    pattern = U + rf"(?<![^\r\n])[^\r\n]*?(?:{BENEFIT_STEMS})[^\r\n]*"
    lines = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return F.transform(lines, lambda s: F.btrim(s, F.lit(" -•\t")))


def join_unique(items: Column) -> Column:
    """Clean each item, drop blanks and case-insensitive repeats (first
    wins), join with '; '."""
    cleaned = F.filter(F.transform(items, lambda s: clean_text(s)), lambda s: s != "")
    keep = F.filter(cleaned, lambda s, i: F.array_position(F.transform(cleaned, lambda x: F.lower(x)), F.lower(s)) == i + 1)
    return F.array_join(keep, "; ")


# -- F6 -------------------------------------------------------------------
def gross_flag(text: Column) -> Column:
    norm = F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), NBSP, " "), r"\s+", " "))
    collapsed = F.regexp_replace(norm, r"\s+", "")
    neg = U + "(?:" + ")|(?:".join(lx.GROSS_NEGATIVE) + ")"
    pos = U + "(?:" + ")|(?:".join(lx.GROSS_POSITIVE) + ")"
    marker = None
    for m in lx.GROSS_COLLAPSED_MARKERS:
        c = collapsed.contains(m)
        marker = c if marker is None else (marker | c)
    return (F.when(norm == "", F.lit(False))
             .when(norm.rlike(neg) | collapsed.rlike(neg), F.lit(False))
             .when(norm.rlike(pos) | collapsed.rlike(pos), F.lit(True))
             .otherwise(marker))


# -- F7 -------------------------------------------------------------------
def _match_form(text: Column) -> Column:
    return F.regexp_replace(F.lower(rate_text(text)), r"\s+", " ")


def _marker_literals(pattern: str) -> list[str]:
    """The texts that every match of a marker holds."""
    optional = r"\\b|\\[sw]\*|\(\?:[^)]*\)\?|\\\.\?|\[[^\]]*\](?:\{[^}]*\}|\?)?"
    return [s.replace("\\$", "$") for s in re.split(optional, pattern) if s]


def has_marker(low: Column, pattern: str) -> Column:
    """A rate marker is in lower-cased text: its pattern runs only where its
    literal parts are."""
    out = None
    for s in sorted(_marker_literals(pattern), key=len, reverse=True):
        c = low.contains(s)
        out = c if out is None else out & c
    return out & low.rlike(U + pattern)


def _has_any_marker(text: Column, patterns: list[str], prepared: bool) -> Column:
    if not prepared:
        return let(_match_form(text), lambda t: _has_any_marker(t, patterns, True))
    out = None
    for p in patterns:
        c = has_marker(text, p)
        out = c if out is None else out | c
    return out


def is_hourly_rate(text: Column, prepared: bool = False) -> Column:
    """``prepared``: ``text`` already is ``_match_form(...)``."""
    return _has_any_marker(text, lx.HOURLY_MARKERS, prepared)


def is_shift_rate(text: Column, prepared: bool = False) -> Column:
    return _has_any_marker(text, lx.SHIFT_MARKERS, prepared)


# -- T3 -------------------------------------------------------------------
def _to_num(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"[^\d\.,]", ""), ",", ".").try_cast("double")


HOUR_PAY_RE = r"(?:^|[^\d])(\d[\d\s]{1,}(?:[\.,]\d+)?)\s*(?:₽|р|руб)?\s*(?:/|за|в)?\s*(?:ч|час|hour|hr)\b"
SHIFT_PAY_RE = r"(?:за\s*смену|смена\s*(?:оплата|ставка)?|/\s*смен[ауы])\D{0,8}(\d[\d\s]{1,}(?:[\.,]\d+)?)\s*(?:₽|р|руб)?"


def explicit_pay(text: Column) -> Column:
    """Struct(hourly, shift_pay): explicit amounts; an hourly amount with
    'мес'/'месяц'/'год' within 24 chars around it is rejected."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for a, b in ((NBSP, " "), ("–", "-"), ("—", "-"), ("−", "-")):
        t = F.replace(t, F.lit(a), F.lit(b))
    # the text is lower-cased, so no case folding; amounts are taken from the short matches
    whole = F.regexp_extract(t, "(?U)" + HOUR_PAY_RE, 0)
    pos = F.position(whole, t)  # 1-based start of the first match
    win = F.substring(t, F.greatest(pos - 24, F.lit(1)), F.length(whole) + 48 + F.least(pos - 25, F.lit(0)))
    hour = F.when((whole != "") & ~win.rlike("(мес|месяц|год)"), _to_num(F.regexp_extract(whole, "(?U)" + HOUR_PAY_RE, 1)))
    paid = F.when(t.contains("смен"), F.regexp_extract(t, "(?U)" + SHIFT_PAY_RE, 0)).otherwise(F.lit(""))
    shift = F.when(paid != "", _to_num(F.regexp_extract(paid, "(?U)" + SHIFT_PAY_RE, 1)))
    return F.struct(F.when(_truthy(hour), F.bround(hour, 2)).alias("hourly"),
                    F.when(_truthy(shift), F.bround(shift, 2)).alias("shift_pay"))


def _truthy(c: Column) -> Column:
    return c.isNotNull() & (c != 0)


def salary_period(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return (F.when(t.rlike(U + r"в\s*час|/\s*ч|за\s*час|per\s*hour|hourly"), F.lit("per_hour"))
             .when(t.rlike(U + r"за\s*смен") | t.rlike(U + r"per\s*shift"), F.lit("per_shift"))
             .when(t.rlike(U + r"в\s*день|per\s*day"), F.lit("per_day"))
             .when(t.rlike(U + r"в\s*недел"), F.lit("per_week"))
             .when(t.rlike(U + r"в\s*месяц|per\s*month"), F.lit("per_month")))


SALARY_NUMBER_RE = "\\d[\\d\\s ]*(?:[\\.,]\\d+)?"


def salary_span(text: Column) -> Column:
    """Struct(min, max, currency) from the first two numbers of a card
    salary line (ordered), currency code of the first currency token."""
    def span(seg: Column) -> Column:
        nums = F.slice(F.regexp_extract_all(seg, _rx(SALARY_NUMBER_RE), 0), 1, 2)
        found = F.filter(F.transform(nums, lambda s: F.regexp_replace(F.regexp_replace(s, "[  ]", ""), ",", ".")
                                     .try_cast("double")), lambda x: x.isNotNull())
        cur = F.regexp_extract(seg, U + lx.CURRENCY_TOKEN_RE, 0)

        def ends(vals: Column) -> Column:
            lo = F.get(vals, F.lit(0))
            hi = F.when(F.size(vals) > 1, F.element_at(vals, -1)).otherwise(lo)
            return F.when(F.size(vals) > 0, F.struct(F.least(lo, hi).alias("min"), F.greatest(lo, hi).alias("max"),
                                                     F.when(cur != "", let(cur, currency_code)).alias("currency")))

        return let(found, ends)

    # the text and the numbers are bound once: both are needed many times
    return let(clean_text(text), span)


# -- T11 ------------------------------------------------------------------
def with_duties(df: DataFrame, text: str, out: str = "duties", fallback: str | None = None) -> DataFrame:
    """``duties`` staged: the stripped text, the heading start, the tail and
    its end are columns, so the many look-ups reference them instead of
    repeating each other (keeps the generated code small)."""
    d = df.withColumn("_dt", strip_html(F.col(text)))
    d = d.withColumn("_dl", F.lower("_dt"))
    start = None
    for h in lx.DUTY_HEADINGS:
        for sep in (":", " :"):
            i = F.locate(h + sep, F.col("_dl"))
            cand = F.when(i > 0, i - 1 + F.lit(len(h) + len(sep)))
            start = cand if start is None else F.coalesce(start, cand)
    d = d.withColumn("_st", start)
    d = d.withColumn("_tail", F.substring(F.col("_dt"), F.col("_st") + 1, F.lit(1 << 30)))
    d = d.withColumn("_tl", F.lower("_tail"))
    ends = [F.when(F.locate(nh + ":", F.col("_tl")) > 0, F.locate(nh + ":", F.col("_tl")) - 1)
            for nh in lx.DUTY_NEXT_HEADINGS]
    d = d.withColumn("_end", F.coalesce(F.least(*ends), F.length("_tail")))
    body = F.trim(F.regexp_replace(F.substring(F.col("_tail"), F.lit(1), F.col("_end")), r"^[\s\-•—]+", ""))
    fb = F.col(fallback) if fallback else F.lit(None).cast("string")
    txt = F.col("_dt")
    bullets = F.when(txt.rlike("^[—\\-•]"), F.btrim(txt, F.lit(" -•—\t")))
    no_head = F.coalesce(F.when(F.coalesce(bullets, F.lit("")) != "", bullets), fb,
                         F.when(txt != "", txt))
    d = d.withColumn("_body", body)
    d = d.withColumn(out, F.when(F.col("_st").isNull(), no_head).otherwise(
        F.when(F.col("_body") != "", F.col("_body")).otherwise(fb)))
    return d.drop("_dt", "_dl", "_st", "_tail", "_tl", "_end", "_body")


# -- T12 (dates in words: operators.dates) ----------------------------------
def iso_date(s: Column) -> Column:
    """ISO datetime (offset with or without colon, or Z) -> its date part;
    unparsable -> the text before 'T'."""
    raw = F.trim(s)
    d = F.try_to_date(F.substring(raw, 1, 10), "yyyy-MM-dd")
    return F.when(raw.isNull() | (raw == ""), F.lit(None).cast("string")).otherwise(
        F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.split(raw, "T", 2).getItem(0)))


# -- T4 -------------------------------------------------------------------
# (on lower-cased text with plain blanks)
TIME_RANGE_RE = rf"(?:{E0}с\s*)?([0-9]{{1,2}})(?::([0-9]{{1,2}}))?\s*(?:до|по|-|—|–)\s*([0-9]{{1,2}})(?::([0-9]{{1,2}}))?"
HOURS_RE = rf"{E0}([0-9]{{1,2}}(?:[\.,][0-9]+)?)\s*(?:-|‑)?\s*(?:час(?:ов|а|овой|овая|овые|овый)?|ч{E1})"
MARK, MARK_END = "\u0001", "\u0002"   # stand at (the ends of) a match while a text is cut there


def _shift_norm(text: Column) -> Column:
    low = F.replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ч."), F.lit("ч")), F.lit("час."), F.lit("час"))
    t = F.translate(low, NBSP + "–—−", " ---")
    return _where_needed(low, "[\\u00a0–—−]|" + _WS_RE, F.trim(F.regexp_replace(t, r"\s+", " ")))


SPAN_TYPE = "array<struct<m:string,s:int,tail:string,ctx:string>>"


def _match_spans(t: Column, pattern: str, ctx: int = 25, tail: int = 6) -> Column:
    """Array<struct<m, s, tail, ctx>>: every match with its 0-based start,
    the ``tail`` chars after it and +-``ctx`` chars around it.

    One scan marks both ends of every match; the pieces between the marks
    give the matches and, summed up, their offsets."""
    def spans(v: Column) -> Column:
        def step(acc, p):
            m = F.substring_index(p, MARK_END, 1)
            st = acc["pos"]
            end = st + F.length(m)
            cs = F.greatest(st - ctx, F.lit(0))
            span = F.struct(m.alias("m"), st.alias("s"), F.substring(v["t"], end + 1, tail).alias("tail"),
                            F.substring(v["t"], cs + 1, end + ctx - cs).alias("ctx"))
            return F.struct((st + F.length(p) - 1).alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))
        init = F.struct(F.length(F.get(v["p"], F.lit(0))).alias("pos"), F.array().cast(SPAN_TYPE).alias("out"))
        return F.aggregate(F.slice(v["p"], 2, F.size(v["p"])), init, step, lambda acc: acc["out"])
    return let(F.struct(t.alias("t"), _pieces(t, pattern).alias("p")), spans)


def _pieces(t: Column, pattern: str) -> Column:
    """The text before the first match, then each match, its end mark and the
    text up to the next one."""
    plain = F.translate(t, MARK + MARK_END, "\u0003\u0003")
    safe = F.when(t.contains(MARK) | t.contains(MARK_END), plain).otherwise(t)
    return F.split(F.regexp_replace(safe, pattern, MARK + "$0" + MARK_END), MARK, -1)


def _any_contains(c: Column, words: list[str]) -> Column:
    out = None
    for w in words:
        x = c.contains(w)
        out = x if out is None else (out | x)
    return out


def with_shift_length(df: DataFrame, text: str, out: str = "shift") -> DataFrame:
    """``shift_length`` with the normalised text staged as a column (its
    span passes read it six times)."""
    d = df.withColumn("_sn", _shift_norm(F.col(text)))
    return d.withColumn(out, shift_length(F.col("_sn"), prepared=True)).drop("_sn")


def shift_length(text: Column, prepared: bool = False) -> Column:
    """Struct(hours, raw, source, confidence, ambiguous, matches).

    Candidates: time ranges (weight 3, over midnight +24 h, 0.5–24 h) and
    'N часов' mentions scored on +-25 chars of context; best = max
    (weight, hours); several distinct hours -> ambiguous; a best weight
    <= -1 leaves it unresolved.  ``prepared``: ``text`` is already normalised."""
    t = text if prepared else _shift_norm(text)
    none = F.array().cast(SPAN_TYPE)
    tr = F.when(t.rlike("[0-9]\\s*(?:до|по|[-—–])"), _match_spans(t, TIME_RANGE_RE)).otherwise(none)

    def time_cand(x):
        raw = F.trim(x["m"])
        g = lambda k: F.regexp_extract(x["m"], TIME_RANGE_RE, k).try_cast("int")
        clock = F.struct(g(1).alias("sh"), F.coalesce(g(2), F.lit(0)).alias("sm"), g(3).alias("eh"), F.coalesce(g(4), F.lit(0)).alias("em"))

        def lasting(c):
            return let((c["eh"] + c["em"] / 60.0) - (c["sh"] + c["sm"] / 60.0), lambda d: F.when(d <= 0, d + 24.0).otherwise(d))

        def cand(c):
            return let(lasting(c), lambda dur: F.when(
                c["sh"].between(0, 23) & c["eh"].between(0, 23) & dur.between(0.5, 24.0),
                F.struct(F.lit(3.0).alias("w"), F.bround(dur, 2).alias("h"), raw.alias("raw"),
                         F.lit("description_time_range").alias("src"), F.lit("high").alias("conf"))))
        stated = (raw.contains(":") | raw.startswith("с ")) & ~_any_contains(x["tail"], lx.SHIFT_TAIL_STOP)
        return F.when(stated, let(clock, cand))
    hr = F.when(t.rlike("[0-9]\\s*[-‑]?\\s*ч"), _match_spans(t, HOURS_RE)).otherwise(none)

    def hour_cand(x):
        val = F.replace(F.regexp_extract(x["m"], HOURS_RE, 1), F.lit(","), F.lit(".")).try_cast("double")
        return F.when(~_any_contains(x["tail"], lx.SHIFT_TAIL_STOP), let(val, lambda v: hours_said(x, v)))

    def hours_said(x, val):
        ctx = x["ctx"]
        w = (F.when(_any_contains(ctx, lx.SHIFT_BAD_WORDS), -3.0).otherwise(0.0)
             + F.when(_any_contains(ctx, lx.SHIFT_GOOD_WORDS), 3.0).otherwise(0.0)
             + F.when(ctx.contains("смен"), 1.5).otherwise(0.0)
             + F.when(ctx.contains("рабоч") | ctx.contains("граф"), 1.0).otherwise(0.0)
             + val / 50.0)
        explicit = ctx.contains("смен") | ctx.contains("граф")
        return F.when(val.between(1, 24), F.struct(w.alias("w"), val.alias("h"), F.trim(x["m"]).alias("raw"),
                                   F.when(explicit, "description_explicit_hours").otherwise("heuristic").alias("src"),
                                   F.when(explicit, "high").otherwise("medium").alias("conf")))
    cands = F.filter(F.concat(F.transform(tr, time_cand), F.transform(hr, hour_cand)), lambda c: c.isNotNull())
    # One pass: best by (weight, hours) — ties keep the first candidate —
    # and the distinct hours; the finish step builds the result from the
    # accumulator only, so the candidate list is computed once per row.
    cand_t = "struct<w:double,h:double,raw:string,src:string,conf:string>"
    init = F.struct(F.lit(None).cast(cand_t).alias("b"), F.array().cast("array<double>").alias("hs"))

    def merge(acc, c):
        b = acc["b"]
        better = b.isNull() | (c["w"] > b["w"]) | ((c["w"] == b["w"]) & (c["h"] > b["h"]))
        return F.struct(F.when(better, c).otherwise(b).alias("b"),
                        F.array_union(acc["hs"], F.array(F.bround(c["h"], 2))).alias("hs"))

    def finish(acc):
        b = acc["b"]
        uniq = F.array_sort(acc["hs"])
        amb = F.size(uniq) > 1
        resolved = b.isNotNull() & (b["w"] > -1.0)
        return F.struct(
            F.when(resolved, b["h"]).alias("hours"),
            F.when(resolved, b["raw"]).alias("raw"),
            F.when(resolved, b["src"]).otherwise(F.lit("unresolved")).alias("source"),
            F.when(resolved, F.when(amb, F.lit("medium")).otherwise(b["conf"])).otherwise(F.lit("low")).alias("confidence"),
            (resolved & amb).alias("ambiguous"),
            F.when(resolved, uniq).alias("matches"),
        )
    return F.aggregate(cands, init, merge, finish)


# -- T2 -------------------------------------------------------------------
def currency(token: Column) -> Column:
    return currency_code(token)


def currency_symbols(value: Column) -> Column:
    """Currency words -> symbols (word-bounded), in list order."""
    out = value
    for word, sym in lx.CURRENCY_WORD_SYMBOLS:
        out = F.regexp_replace(out, U + r"\b" + word + r"\b", sym.replace("$", "\\$"))
    return out


# -- T14 ------------------------------------------------------------------
def audit_rows(df: DataFrame, id_col: str, url: Column, inactive: Column, notes: Column,
               status: Column) -> DataFrame:
    """One row per (record, event): inactive card, calc notes, HTTP status."""
    ev = F.array_compact(F.array(
        F.when(inactive, F.struct(F.lit("card").alias("stage"), F.lit("Объявление недоступно").alias("message"))),
        F.when(F.coalesce(notes, F.lit("")) != "", F.struct(F.lit("calc").alias("stage"), notes.alias("message"))),
        F.when(status.isNotNull() & (status != 0) & (status != 200),
               F.struct(F.lit("card").alias("stage"), F.concat(F.lit("HTTP статус "), status.cast("string")).alias("message"))),
    ))
    return df.select(F.col(id_col), url.alias("url"), F.posexplode(ev).alias("pos", "ev")).select(
        id_col, "pos", F.col("ev.stage").alias("stage"), F.col("ev.message").alias("message"), "url")


# -- T1 -------------------------------------------------------------------
CLAUSE_STOP = ".,;!\n\r"
RATE_NUMBER_RE = r"\d[\d\s]*(?:[\.,]\d+)?"
SEP_RE = "(?: или | либо | / )"
PREFIX_CURRENCY_RE = r"(₽|\$|€|£|₴|₸|руб\.?|rur|rub|uah|грн|usd|eur|kzt|byn|gbp|br)\s*$"
CURRENCY_WORD_END_RE = r"(?:руб\.?|rur|rub|uah|грн|eur|usd|kzt|byn|gbp|br)$"
AFTER_SYMBOL_RE = r"^\s*(?:₽|\$|€|£|₴|₸)"
AFTER_UNIT_RE = r"^\s*(?:/|per[-\s]?|в|за)\s*(?:час|ч|hour|hr|смен|shift)"
UNITS_RE = r"(?:\s*(?:/|в|per[-\s]?|за)\s*(?:час|ч|hour|hr|смен[ауы]|shift|сменн\w*\s*ставка))+"
NUM_SPAN_TYPE = "array<struct<m:string,s:int,e:int,before:string,after:string>>"


def _number_spans(t: Column) -> Column:
    """Numbers with [s, e) offsets and 6 chars before / 8 chars after."""
    def spans(v: Column) -> Column:
        def step(acc, p):
            m = F.substring_index(p, MARK_END, 1)
            st = acc["pos"]
            end = st + F.length(m)
            b0 = F.greatest(st - 6, F.lit(0))
            span = F.struct(m.alias("m"), st.alias("s"), end.alias("e"),
                            F.substring(v["t"], b0 + 1, st - b0).alias("before"),
                            F.substring(v["t"], end + 1, 8).alias("after"))
            return F.struct((st + F.length(p) - 1).alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))
        init = F.struct(F.length(F.get(v["p"], F.lit(0))).alias("pos"), F.array().cast(NUM_SPAN_TYPE).alias("out"))
        return F.aggregate(F.slice(v["p"], 2, F.size(v["p"])), init, step, lambda acc: acc["out"])
    return let(F.struct(t.alias("t"), _pieces(t, U + RATE_NUMBER_RE).alias("p")), spans)


def rate_segments(df: DataFrame, url: str = "url", text: str = "text", order: str | None = None) -> DataFrame:
    """Mention table: one row per rate-marker hit with its trimmed clause.

    (url, ord, type, k, pos, segment): ord = the row order column (or 0),
    k = marker index, pos = hit order; the clause is widened to [.,;!]
    boundaries and cut at ' или ', ' либо ', ' / ' around the hit."""
    ordc = F.col(order) if order else F.lit(0)
    # the test for an empty clean text, on the text: stated by "cleaned", it would be pushed down and clean every text twice
    base = df.where((F.trim(F.col(url)) != "") & F.col(text).rlike(r"[^\s\u00a0]")).select(
        F.trim(F.col(url)).alias("url"), ordc.alias("ord"), rate_text(F.col(text)).alias("cleaned"))
    base = base.withColumn("_low", F.lower(F.col("cleaned")))   # staged: read by 23 marker scans
    low = F.col("_low")

    def tag(typ, k):
        return lambda x, i: F.struct(F.lit(typ).alias("type"), F.lit(k).alias("k"), i.alias("pos"),
                                     x["s"].alias("s"), F.length(x["m"]).alias("len"))
    hits = []
    for typ, pats in (("hourly", lx.HOURLY_MARKERS), ("shift", lx.SHIFT_MARKERS)):
        for k, p in enumerate(pats):
            # the span pass (interpreted lambdas) runs only where the marker is at all
            hits.append(F.when(has_marker(low, p), F.transform(_match_spans(low, U + p), tag(typ, k)))
                         .otherwise(F.array().cast("array<struct<type:string,k:int,pos:int,s:int,len:int>>")))
    # staged, since a generator's own input is interpreted; outer, then filtered: no filter on the hits is inferred,
    # which would scan the markers again
    m = base.select("url", "ord", "cleaned", F.concat(*hits).alias("_hits")).select(
        "url", "ord", "cleaned", F.explode_outer("_hits").alias("h")).where(F.col("h").isNotNull()).select("url", "ord", "cleaned", "h.*")
    c = F.col("cleaned")
    stops = CLAUSE_STOP.replace("\n", "\\n").replace("\r", "\\r")
    stop = "[^" + stops + "]*"
    left = F.regexp_replace(F.substring(c, F.lit(1), F.col("s")), "(?s)^.*[" + stops + "]", "")   # behind the last stop
    right = F.regexp_extract(F.substring(c, F.col("s") + F.col("len") + 1, F.lit(1 << 30)), "^" + stop, 0)
    m = m.withColumns({
        "seg0": F.trim(F.concat(left, F.substring(c, F.col("s") + 1, F.col("len")), right)),
        "rel_start": F.length(left),
    })
    seg0 = F.col("seg0")
    before = F.regexp_extract(F.substring(F.lower(seg0), F.lit(1), F.col("rel_start")), "^(.*)" + SEP_RE, 0)
    cut = F.length(before)
    m = m.withColumns({"seg1": F.substring(seg0, cut + 1, F.lit(1 << 30)),
                       "rel_end": F.col("rel_start") + F.col("len") - cut})
    seg1 = F.col("seg1")
    tail = F.substring(F.lower(seg1), F.col("rel_end") + 1, F.lit(1 << 30))
    has_sep = tail.rlike(SEP_RE)
    after_pos = F.when(has_sep, F.col("rel_end") + F.length(F.regexp_extract(tail, "^(.*?)" + SEP_RE, 1))
                       ).otherwise(F.length(seg1))
    seg = F.trim(F.substring(seg1, F.lit(1), after_pos))
    # no filter here: a predicate on this computed column would be pushed
    # down through the staged projections with every stage inlined into
    # it; an empty segment simply parses to nothing downstream
    return m.select("url", "ord", "type", "k", "pos", seg.alias("segment"))


def with_rate_parse(df: DataFrame, segment: str = "segment") -> DataFrame:
    """Adds ``_x`` = struct(min, max, s, e, rng, seg) for one rate clause
    (NULL when it holds no number): numbers next to a currency or a unit
    are preferred; 'от … до …' takes the first two.

    Each intermediate is its own column, referenced by name afterwards, so
    no sub-expression is copied into the plan more than once."""
    d = df.withColumn("_seg", rate_text(F.col(segment)))
    d = d.withColumns({"_nums": _number_spans(F.col("_seg")),
                       "_rng": F.lower(F.col("_seg")).contains("от") & F.lower(F.col("_seg")).contains("до")})

    def flag(x):
        return (x["before"].rlike(U + "(?:" + lx.CURRENCY_TOKEN_RE + ")") | x["after"].rlike(AFTER_SYMBOL_RE)
                | x["before"].rlike(U + CURRENCY_WORD_END_RE) | x["after"].rlike(U + AFTER_UNIT_RE))
    d = d.withColumn("_sel0", F.filter(F.col("_nums"), flag))
    nums, rng, sel0 = F.col("_nums"), F.col("_rng"), F.col("_sel0")
    n_all, n_sel = F.size(nums), F.size(sel0)
    d = d.withColumn("_sel", F.when(n_sel == 0, F.when(rng & (n_all >= 2), F.slice(nums, 1, 2))
                                    .when(n_all >= 2, F.slice(nums, -2, 2)).otherwise(F.slice(nums, -1, 1)))
                            .when((n_sel == 1) & rng & (n_all >= 2), F.slice(nums, 1, 2))
                            .otherwise(sel0))
    sel = F.col("_sel")
    d = d.withColumn("_vals", F.filter(F.transform(sel, lambda x: F.replace(
        F.regexp_replace(x["m"], r"[\s ]", ""), F.lit(","), F.lit(".")).try_cast("double")),
        lambda v: v.isNotNull()))
    vals = F.col("_vals")
    a = F.get(vals, F.lit(0))    # NULL where the clause holds no number
    b = F.when(F.size(vals) > 1, F.get(vals, F.lit(1))).otherwise(a)
    d = d.withColumns({
        "r_ok": F.size(vals) > 0,
        "r_min": F.least(a, b), "r_max": F.greatest(a, b),
        "r_s": F.array_min(F.transform(sel, lambda x: x["s"])),
        "r_e": F.array_max(F.transform(sel, lambda x: x["e"])),
        "r_rng": rng, "r_seg": F.col("_seg")})
    # the struct view kept for callers that want one column
    d = d.withColumn("_x", F.when(F.col("r_ok"), F.struct(
        F.col("r_min").alias("min"), F.col("r_max").alias("max"), F.col("r_s").alias("s"),
        F.col("r_e").alias("e"), F.col("r_rng").alias("rng"), F.col("r_seg").alias("seg"))))
    return d.drop("_seg", "_nums", "_rng", "_sel0", "_sel", "_vals")


def with_rate_value(d: DataFrame) -> DataFrame:
    """Adds ``r_value`` from the ``r_*`` columns of ``with_rate_parse``,
    one staged step at a time."""
    seg, st, en = F.col("r_seg"), F.col("r_s"), F.col("r_e")
    b0 = F.greatest(st - 6, F.lit(0))
    d = d.withColumn("_pm", F.regexp_extract(F.substring(seg, b0 + 1, st - b0), U + PREFIX_CURRENCY_RE, 0))
    d = d.withColumn("_st2", F.when(F.col("_pm") != "", st - F.length("_pm"))
                     .when(F.col("r_rng") & (st >= 3) & (F.lower(F.substring(seg, st - 2, 3)) == "от "), st - 3)
                     .otherwise(st))
    ext = F.regexp_extract(F.substring(seg, en + 1, F.lit(1 << 30)), "^[^.,;!]*", 0)
    d = d.withColumn("_raw", F.trim(F.substring(seg, F.col("_st2") + 1, en + F.length(ext) - F.col("_st2"))))
    v = F.trim(F.regexp_replace(F.col("_raw"), U + UNITS_RE, ""))
    v = currency_symbols(v)
    v = F.regexp_replace(v, r"(?<=\d)\s*[-–—]\s*(?=\d)", "–")
    d = d.withColumn("_v", F.trim(F.regexp_replace(v, r"\s+", " ")))
    return d.withColumn("r_value", F.when(F.col("_v") == "", F.col("_raw")).otherwise(F.col("_v"))).drop(
        "_pm", "_st2", "_raw", "_v")


def rate_value(x: Column) -> Column:
    """The display value of a parsed clause (``with_rate_parse``): the
    amount text (with a leading currency or 'от '), units dropped,
    currency words as symbols, ranges joined with '–'.  ``x`` should be a
    column reference (it is read several times)."""
    seg, st, en = x["seg"], x["s"], x["e"]
    b0 = F.greatest(st - 6, F.lit(0))
    prefix = F.substring(seg, b0 + 1, st - b0)
    pm = F.regexp_extract(prefix, U + PREFIX_CURRENCY_RE, 0)
    st2 = (F.when(pm != "", st - F.length(pm))
            .when(x["rng"] & (st >= 3) & (F.lower(F.substring(seg, st - 2, 3)) == "от "), st - 3)
            .otherwise(st))
    ext = F.regexp_extract(F.substring(seg, en + 1, F.lit(1 << 30)), "^[^.,;!]*", 0)
    raw = F.trim(F.substring(seg, st2 + 1, en + F.length(ext) - st2))
    v = F.trim(F.regexp_replace(raw, U + UNITS_RE, ""))
    v = currency_symbols(v)
    v = F.regexp_replace(v, r"(?<=\d)\s*[-–—]\s*(?=\d)", "–")
    v = F.trim(F.regexp_replace(v, r"\s+", " "))
    return F.when(v == "", raw).otherwise(v)


RATE_COLUMNS = ("value", "min", "max", "currency", "raw")


def rate_mentions(df: DataFrame, url: str = "url", text: str = "text", order: str | None = None,
                  columns: Iterable[str] = RATE_COLUMNS) -> DataFrame:
    """Resolved rates: the first parsable clause per (url, type) in row
    order, then marker order -> (url, type, value, min, max, currency, raw),
    of which a caller may name the ``columns`` behind the type that it reads.

    The pick is a ``min_by`` aggregation (partial-aggregated per input
    partition), so a URL seen in a third of all rows is not a hot task."""
    segs = rate_segments(df, url, text, order)
    ex = with_rate_value(with_rate_parse(segs).drop("_x"))
    rate = {"value": F.col("r_value"), "min": F.col("r_min"), "max": F.col("r_max"),
            "currency": currency_code(F.regexp_extract(F.col("r_seg"), U + "(?:" + lx.CURRENCY_TOKEN_RE + ")", 0)),
            "raw": F.col("segment")}
    columns = [c for c in rate if c in set(columns)]
    if not columns:
        # nothing of the clause is asked for, so any parsable one will do
        return ex.groupBy("url", "type").agg(F.max("r_ok").alias("ok")).where("ok").select("url", "type")
    ex = ex.select("url", "ord", "type", "k", "pos", "r_ok", F.struct(*[rate[c].alias(c) for c in columns]).alias("r"))
    # unparsable clauses get a NULL order, which min_by skips; the
    # "found one" test runs on the aggregate output (never pushed down)
    first = ex.groupBy("url", "type").agg(
        F.min_by(F.col("r"), F.when(F.col("r_ok"), F.struct("ord", "k", "pos"))).alias("r"))
    return first.where(F.col("r").isNotNull()).select("url", "type", *[f"r.{c}" for c in columns])
