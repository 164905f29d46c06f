"""Column-level text helpers (all JVM-side built-ins; no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as lx

NBSP = " "
NNBSP = " "
# non-word class usable in both Java regex and RE2 on lower-cased text
NONWORD = "[^0-9a-zа-яёієїґ_]"


# What the passes below can change; a text without it is only trimmed, one
# scan instead of several rewrites.
_WS_RE = "[\\t\\n\\x0B\\f\\r]|  "
_CLEAN_RE = "[<\\u00a0\\u202f\\x{10000}-\\x{10FFFF}]|" + _WS_RE
_STRIP_RE = "<|" + _WS_RE
_RATE_RE = "\\u00a0|" + _WS_RE


def _where_needed(t: Column, pattern: str, full: Column) -> Column:
    return F.when(t.rlike(pattern), full).otherwise(F.trim(t))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_text(c: Column) -> Column:
    """Tags -> space, astral chars (emoji) dropped, NBSP/NNBSP -> space,
    whitespace squeezed, trimmed; NULL -> ''."""
    raw = F.coalesce(c.cast("string"), F.lit(""))
    t = F.regexp_replace(raw, r"<[^>]+>", " ")
    t = F.regexp_replace(t, r"[\x{10000}-\x{10FFFF}]", "")
    t = F.translate(t, NBSP + NNBSP, "  ")
    return _where_needed(raw, _CLEAN_RE, F.trim(F.regexp_replace(t, r"\s+", " ")))


def strip_html(c: Column) -> Column:
    """Tags -> space, whitespace squeezed, trimmed; NULL -> ''."""
    raw = F.coalesce(c, F.lit(""))
    t = F.regexp_replace(raw, r"<[^>]+>", " ")
    return _where_needed(raw, _STRIP_RE, F.trim(F.regexp_replace(t, r"\s+", " ")))


def rate_text(c: Column) -> Column:
    """NBSP -> space, squeeze, trim (the rate-matching normal form)."""
    raw = F.coalesce(c, F.lit(""))
    return _where_needed(raw, _RATE_RE, F.trim(F.regexp_replace(F.translate(raw, NBSP, " "), r"\s+", " ")))


def any_rlike(c: Column, patterns: list[str], flags: str = "(?iu)") -> Column:
    return c.rlike(flags + "(?:" + ")|(?:".join(patterns) + ")")


def first_label(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Label of the first rule whose regex is found, else NULL."""
    out = None
    for pat, label in rules:
        cond = c.rlike(pat)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def ctrl_clean(c: Column) -> Column:
    return F.regexp_replace(c, lx.CONTROL_CHARS_RE, "")


def fmt_g(x: Column) -> Column:
    """Python ':g'-like rendering for moderate values: 12.0 -> '12', 10.5 -> '10.5'."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def coerce_number(c: Column) -> Column:
    """',' -> '.', drop everything but digits, '.' and '-', then a safe
    double cast ('1-2' and '' become NULL)."""
    s = F.regexp_replace(F.replace(c.cast("string"), F.lit(","), F.lit(".")), r"[^\d.\-]", "")
    return s.try_cast("double")


def slugify(c: Column) -> Column:
    """City dictionary first, else Russian -> Latin transliteration with
    non-alphanumerics collapsed to '_' (fallback 'vakansii')."""
    from .lookups import lookup
    t = F.lower(F.trim(c))
    tr = t
    for a, b in lx.TRANSLIT_MULTI:
        tr = F.replace(tr, F.lit(a), F.lit(b))
    tr = F.translate(tr, lx.TRANSLIT_SINGLE_FROM + lx.TRANSLIT_DROP, lx.TRANSLIT_SINGLE_TO)
    s = F.btrim(F.regexp_replace(tr, "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(lookup(lx.CITY_SLUGS, t), F.nullif(s, F.lit("")), F.lit("vakansii"))


def _collapsed(t: Column) -> Column:
    return F.nullif(F.btrim(F.regexp_replace(t, "[^0-9a-z]+", "_"), F.lit("_")), F.lit(""))


def region_slug(c: Column) -> Column:
    """Path part of a region: known names, else Latin letters and digits
    joined by '_'; 'all' where nothing is left."""
    from .lookups import lookup
    t = F.lower(F.trim(c))
    return F.coalesce(lookup(lx.REGION_SLUGS, t), _collapsed(t), F.lit("all"))


def category_slug(c: Column) -> Column:
    """Path part of a category; NULL where nothing is left."""
    return _collapsed(F.lower(F.trim(c)))


def city_subdomain(c: Column) -> Column:
    """Sub-domain of a city; '' for an unknown one."""
    from .lookups import lookup
    return F.coalesce(lookup(lx.CITY_SLUGS, F.lower(F.trim(c))), F.lit(""))


def listing_city(c: Column) -> Column:
    """City part of a listing; the whole country for an unknown one."""
    from .lookups import lookup
    return F.coalesce(lookup(lx.LISTING_CITIES, F.lower(F.trim(c))), F.lit("rossiya"))


def let(expr: Column, body) -> Column:
    """Evaluate ``expr`` once and pass it to ``body`` as a lambda variable.

    A Python Column reused N times is N copies in the plan (each evaluated);
    binding it through a one-element ``transform`` makes every use a cheap
    variable reference instead."""
    return F.element_at(F.transform(F.array(expr), body), 1)
