"""Working hours (T6): contexts -> trigger lines -> normalised candidates ->
the best of a record, with the log of the decision.

A record's contexts are an array of ``(text, selector, url, weight)`` on its
own row.  Lines, triggers, normalised candidates and the pick are found row by
row by the parsers below (``functions.scan.parse_rows``): nothing is exploded,
nothing is shuffled, and a record needs no key.  Heavy patterns run only
behind cheap literal tests.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .. import lexicon as lx
from ..functions import scan
from . import extract as X
from .extract import E0, E1, WORD_CLASS

_TOKS = "|".join(sorted((t for t, _ in lx.DAY_TOKENS), key=len, reverse=True))
DAY_CODES = dict(lx.DAY_TOKENS)
# patterns on lower-cased text; \s and \d are ASCII, as in Java
DAY_TOKEN = re.compile(f"{E0}({_TOKS}){E1}", re.A)
DAY_RANGE = re.compile(rf"{E0}({_TOKS})\.?\s*[-–—]\s*({_TOKS}){E1}", re.A)
ALL_DAYS = re.compile(r"ежеднев|daily|каждый\s+день|щодн", re.A)
WEEK_DAYS = re.compile("будн|weekdays")
WEEKEND = re.compile("выходн|weekend")
# in any case and between blanks of any script
UNICODE_BLANK = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
SEGMENT_END = re.compile(rf"[;|\n]|,(?={UNICODE_BLANK}*(?:" + _TOKS + "|ежеднев|daily|будн|weekdays|выходн|weekend))", re.I)
AMPM = r"(?:am|pm|a\.m\.|p\.m\.)"
TIME_RANGE = re.compile(r"(\d{1,2}(?::\d{1,2})?\s*" + AMPM + r"?)\s*[-–—~]\s*(\d{1,2}(?::\d{1,2})?\s*" + AMPM + r"?)", re.A)
FROM_TO = re.compile(r"(?:с|from)\s*(\d{1,2}(?::\d{1,2})?)\s*(?:до|to)\s*(\d{1,2}(?::\d{1,2})?)", re.A)
CLOCK = re.compile(r"\d{1,2}:\d{2}", re.A)
TIME = re.compile(r"(\d{1,2})(?::(\d{1,2}))?", re.A)
DOTTED_TIME = re.compile(r"(?<=\d)\.(?=\d)", re.A)
DIGIT = re.compile("[0-9]")
WORDS = re.compile(f"[{WORD_CLASS}]+")
FLEXIBLE, IS247 = (re.compile(p.replace(r"\w", f"[{WORD_CLASS}]"), re.A) for p in (lx.FLEXIBLE_RE, lx.IS247_RE))
CLOSED = re.compile(lx.CLOSED_RE, re.A)
SHIFT_WORDS = ["смен", "shift", "сутк", "вахт"]
ONE_WORD_DAYS = frozenset(t for t in DAY_CODES if WORDS.fullmatch(t))
OTHER_DAYS = [t for t in DAY_CODES if t not in ONE_WORD_DAYS]
TO_HYPHENS, TO_BLANKS = str.maketrans(X.NBSP + "—–", " --"), str.maketrans(X.NBSP, " ")

HOUR_RANGE = re.compile(r"(?<!\d)(\d{1,2})\s*[-–—]\s*(\d{1,2})(?!\d)", re.A)
MARKED = re.compile("[\u0300-\U000e01ef]")


def _any_in(text: str, words: Iterable[str]) -> bool:
    return any(w in text for w in words)


def _names_day(low: str) -> bool:
    return (not ONE_WORD_DAYS.isdisjoint(WORDS.findall(low)) or _any_in(low, OTHER_DAYS)) and DAY_TOKEN.search(low) is not None


def _in_word(t: str, i: int) -> bool:
    """A letter, digit or '_' of any script is there."""
    return 0 <= i < len(t) and (t[i] == "_" or t[i].isalnum() and (t[i].isascii() or unicodedata.category(t[i]) not in ("No", "Nl")))


def _join_marks(t: str) -> str:
    """A combining mark belongs to the letter or digit before it: one more letter."""
    chars, word = [], False
    for i, c in enumerate(t):
        if unicodedata.category(c) == "Mn":
            chars.append("x" if word else c)
        else:
            word = c != "_" and _in_word(t, i)
            chars.append(c)
    return "".join(chars)


def _hour_range(t: str) -> re.Match | None:
    """The first 'H–H' between word edges."""
    m = HOUR_RANGE.search(t)
    if m and MARKED.search(t):
        t = _join_marks(t)
        m = HOUR_RANGE.search(t)
    while m and (_in_word(t, m.start() - 1) or _in_word(t, m.end())):
        m = HOUR_RANGE.search(t, m.start() + 1)
    return m


def reason(low: str) -> str | None:
    """Why a line (or joined lines, lower-cased) is a working-hours candidate, or None."""
    if FLEXIBLE.search(low):
        return "flexible"
    if IS247.search(low):
        return "247"
    if DIGIT.search(low):
        timey = TIME_RANGE.search(low) or FROM_TO.search(low) or _hour_range(low)
        if (timey or CLOCK.search(low)) and _names_day(low):
            return "day-time"
        if timey and _any_in(low, lx.WORK_SECTION_HINTS):
            return "section-range"
    # any shift word triggers: the length result is always truthy there
    if _any_in(low, SHIFT_WORDS):
        return "shift-length"
    return "schedule" if scan.schedule_list(scan.schedule_text(low)) is not None else None


def line_candidates(text: str | None) -> dict[str, str]:
    """Reasons by raw text: trigger lines, or a section hint joined with up
    to three following non-empty lines until one triggers; of equal texts the
    first."""
    lines = [x.strip(" ") for x in (text or "").replace("\r", "\n").split("\n")]
    found: dict[str, str] = {}
    for i, line in enumerate(lines):
        if not line:
            continue
        low = line.lower()
        why = reason(low)
        if why is None and _any_in(low, lx.WORK_SECTION_HINTS):
            for following in lines[i + 1:i + 4]:
                if not following:
                    break
                line = f"{line} {following}"
                why = reason(line.lower())
                if why is not None:
                    break
        if why is not None:
            found.setdefault(line, why)
    return found


# ---------------------------------------------------------------- times ---
def _norm_time(tok: str, default_ampm: str | None = None) -> tuple[str | None, str | None, bool]:
    """('HH:MM' or None, am / pm, said explicitly)."""
    low = tok.strip(" ").lower()
    mark = next((m for m in ("a.m.", "p.m.", "am", "pm") if m in low), None)
    body = low.replace(mark, "") if mark else tok.strip(" ")
    ampm = mark.replace(".", "")[:2] if mark else default_ampm
    m = TIME.match(body.replace(".", ":").strip(" "))
    if m is None:
        return None, ampm, mark is not None
    hour, minute = int(m[1]), int(m[2] or 0)
    if ampm == "am" and hour == 12:
        hour = 0
    elif ampm == "pm" and hour < 12:
        hour += 12
    return f"{hour:02d}:{minute:02d}" if hour <= 23 and minute <= 59 else None, ampm, mark is not None


def time_range(segment: str) -> tuple[str, str] | None:
    """(start, end) of a segment: 'с X до Y' / 'X–Y' with am/pm / 'H–H' hours."""
    t = DOTTED_TIME.sub(":", segment.lower().translate(TO_HYPHENS))
    m = FROM_TO.search(t)
    if m:
        start, end = _norm_time(m[1])[0], _norm_time(m[2])[0]
        if start and end:
            return start, end
    m = TIME_RANGE.search(t)
    if m:
        end, ampm, explicit = _norm_time(m[2])
        start, _, start_explicit = _norm_time(m[1], ampm)
        if start and end:
            plain = _norm_time(m[1])[0]
            # 'HH:MM' sorts as its minutes do
            return (plain if explicit and not start_explicit and plain and start >= end and plain < end else start), end
    m = _hour_range(t)
    if m and int(m[1]) <= 23 and int(m[2]) <= 23:
        return f"{int(m[1]):02d}:00", f"{int(m[2]):02d}:00"
    return None


# ----------------------------------------------------------------- days ---
def _expand(a: str, b: str) -> list[str]:
    """Day codes from a to b in week order, wrapping past Sunday."""
    order = lx.DAY_ORDER
    i, j = order.index(a), order.index(b)
    return order[i:j + 1] if i <= j else order[i:] + order[:j + 1]


def chunk_days(chunk: str) -> list[str]:
    """Days named in a chunk: ranges first, then single names outside the
    ranges; 'daily'/'weekdays'/'weekend' words when no name is present."""
    norm = chunk.translate(TO_BLANKS).lower().translate(TO_HYPHENS)
    if _names_day(norm):
        named = [d for m in DAY_RANGE.finditer(norm) for d in _expand(DAY_CODES[m[1]], DAY_CODES[m[2]])]
        named += [DAY_CODES[m[1]] for m in DAY_TOKEN.finditer(DAY_RANGE.sub(" ", norm))]
        if named:
            return list(dict.fromkeys(named))
    return (lx.DAY_ORDER if ALL_DAYS.search(norm) else lx.DAY_ORDER[:5] if WEEK_DAYS.search(norm)
            else lx.DAY_ORDER[5:] if WEEKEND.search(norm) else [])


def by_days(raw: str) -> tuple[list[dict], list[str]]:
    """Rules (day, start, end) and notes."""
    rules, notes = [], []
    for chunk in SEGMENT_END.split(raw):
        chunk = chunk.strip(" ")
        days = chunk_days(chunk) if chunk else []
        if not days:
            continue
        if CLOSED.search(chunk.lower()):
            notes += [f"{d}: closed" for d in days]
        elif times := time_range(chunk):
            rules += [{"day": d, "start": times[0], "end": times[1]} for d in days]
    return rules, list(dict.fromkeys(notes))


# ------------------------------------------------------------ normalise ---
def normalize(raw: str) -> dict:
    """Of a candidate: by_days, is_247, shift (pattern, hours), schedule_hint,
    notes, confidence (1.0 / 0.9 / 0.6 / 0.5 / 0.3), lang."""
    low = raw.lower()
    # the day parser only runs where a day is named; elsewhere it would find nothing
    dayish = _names_day(low) or ALL_DAYS.search(low) or WEEK_DAYS.search(low) or WEEKEND.search(low)
    rules, notes = by_days(raw.replace(X.MARK, " ")) if dayish else ([], [])
    sched, words = scan.schedule_list(scan.schedule_text(low)), _any_in(low, SHIFT_WORDS)
    hours = scan.shift_length(scan.shift_norm(raw))[0] if sched is not None or words else None
    is_247 = IS247.search(low) is not None
    found = sched is not None or hours is not None
    shift = {"pattern": sched, "shift_length_hours": hours} if found else None
    sure = max(0.9 if is_247 else 0.0, 1.0 if rules else 0.0, (0.5 if hours is None else 0.6) if found else 0.0)
    vague = not rules and not is_247 and not found
    return {"by_days": rules, "is_247": is_247, "shift": shift, "schedule_hint": sched, "notes": notes if rules else [],
            "confidence": max(sure, 0.3) if vague else sure, "lang": scan.script_lang(low)}


RESULT = {
    "raw_matches": "array<string>", "schedule_hint": "string", "confidence": "double", "lang": "string", "notes": "string",
    "normalized": "struct<by_days:array<struct<day:string,start:string,end:string>>,is_247:boolean,"
                  "shift_based:struct<pattern:string,shift_length_hours:double>>",
    "source": "array<struct<selector:string,url:string>>",
    "log": "array<struct<selector:string,raw:string,reason:string,confidence:double,chosen:boolean>>"}
NOTHING = {"by_days": None, "is_247": None, "shift": None, "schedule_hint": None, "notes": [], "confidence": None, "lang": None}


def decide(contexts: list[tuple] | None) -> dict:
    """``RESULT`` of one record from its contexts (text, selector, url, weight)."""
    if contexts is None:
        return {"confidence": 0.0, "normalized": {}}
    entries, best, best_by = [], None, None      # (selector, url, raw, reason, normalised or None)
    for text, selector, url, weight in contexts:
        found = line_candidates(text)
        for raw, why in found.items():
            n = normalize(raw)
            by = (n["confidence"], weight or 0)
            # (confidence, weight), then the earliest candidate
            if best is None or by > best_by:
                best, best_by = len(entries), by
            entries.append((selector, url, raw, why, n))
        if not found:
            entries.append((selector, url, None, "no triggers", None))
    hits = [e for e in entries if e[4] is not None]
    b = NOTHING if best is None else entries[best][4]
    sched = next((h for h in (b["schedule_hint"], *(e[4]["schedule_hint"] for e in hits)) if h is not None), None)
    shift = b["shift"] or (None if sched is None else {"pattern": sched, "shift_length_hours": None})
    return {
        "raw_matches": list(dict.fromkeys(e[2] for e in hits)), "schedule_hint": sched, "confidence": b["confidence"] or 0.0, "lang": b["lang"],
        "notes": "; ".join(b["notes"]) or None, "normalized": {"by_days": b["by_days"], "is_247": b["is_247"], "shift_based": shift},
        "source": [{"selector": s, "url": u} for s, u in dict.fromkeys((e[0], e[1]) for e in hits)],
        "log": [{"selector": e[0], "raw": e[2], "reason": e[3], "confidence": e[4] and e[4]["confidence"], "chosen": i == best}
                for i, e in enumerate(entries)]}


def _contexts(column: pa.Array) -> list[list[tuple] | None]:
    there = column.is_valid().to_pylist()
    sizes = column.value_lengths().to_pylist()
    parts = column.flatten()
    # a NULL context has NULL parts
    fields = {f.name: x for f, x in zip(parts.type, parts.flatten())}
    rows = zip(*[scan.strings(fields[k]) for k in ("text", "selector", "url")], fields["weight"].to_pylist())
    return [[next(rows) for _ in range(n)] if ok else None for ok, n in zip(there, sizes)]


def working_hours(df: DataFrame, contexts: str = "contexts", facts: Iterable[str] = tuple(RESULT)) -> DataFrame:
    """``df``'s other columns and, from its array of contexts (text, selector,
    url, weight): raw_matches, schedule_hint, confidence, lang, notes,
    normalized{by_days, is_247, shift_based}, source[{selector, url}] and log,
    the decision in order: one entry a candidate (selector, raw, reason,
    confidence, chosen), or one that names a context without any.  A caller
    may name the ``facts`` that it reads."""
    facts = [f for f in RESULT if f in set(facts)]
    at = df.columns.index(contexts)

    def parse(rows: pa.RecordBatch) -> list[list]:
        found = [decide(c) for c in _contexts(rows.column(at))]
        return [[r.get(f) for r in found] for f in facts]

    return scan.parse_rows(df, [contexts], StructType.fromDDL(", ".join(f"{f} {RESULT[f]}" for f in facts)), parse)
