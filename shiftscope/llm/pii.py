"""Format-preserving pseudonyms for personal data, in native expressions.

Validated values (card numbers by Luhn, IBANs by mod 97, social security
numbers, phone numbers, IPv4 addresses, calendar dates, e-mail addresses) are
replaced by another valid value of the same format.  The replacement is a
keyed permutation: a value is a row of symbols, each with its own modulus,
and a Feistel network adds to one half a keyed hash of the other half, modulo
each symbol's modulus.  Equal values therefore get equal pseudonyms in every
document, different values different ones, and what is not a valid value of a
format stays as it is.

Everything is DataFrame functions: matches and gaps by regular expression,
the network as higher-order functions over one match.

Defined results: NULL text stays NULL with no findings, empty text stays
empty; text without a valid value is returned unchanged, byte for byte.
Repeated rows are changed alike.  Extra columns pass through untouched, but
for one named like the findings, which they replace.  Left as they are: digits without any
separator (too often no phone number), dates with the month first (not to be
told from those with the day first), lower-case IBANs, IPv6 addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

KEY_SETTING = "spark.shiftscope.pii.key"
PUBLIC_KEY = "shiftscope pseudonyms"  # for trial runs: whoever knows the key can undo the pseudonyms
ROUNDS = 8

# The formats.  None of them starts or ends inside a longer run.
_EDGE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_DATE_END = rf"(?:{_END}|(?<=-[0-9]{{2}})(?=[Tt][0-9]{{2}}))"  # a time may follow an ISO date
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"
#: Length of the IBANs of each country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
# In groups of four, a country's length ends it; other countries end with the groups.
_GROUPED = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "")
                    for n, c in IBAN_LENGTHS.items())
IBAN = rf"(?=[A-Z]{{2}}[0-9]{{2}} )(?:{_GROUPED})|[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,4}})?)"
PHONE = (r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}"
         r"|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}|[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}")
CARD = r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}|[0-9]{13,19}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
IP = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}"
DATE = r"(?:19|20)[0-9]{2}([-/])[0-9]{2}\1[0-9]{2}|[0-9]{2}([./])[0-9]{2}\2(?:19|20)[0-9]{2}"
KINDS = ("email", "iban", "phone", "card", "ssn", "ip", "date")
_FORMS = {"email": EMAIL, "iban": IBAN, "phone": PHONE, "card": CARD, "ssn": SSN, "ip": IP, "date": DATE}
DAY_ZERO, DAYS = "1900-01-01", (150, 487)  # 150 * 487 days: up to 2100-01-01


def _any_pattern() -> str:
    """All formats as one alternation; numbered groups renumbered."""
    out, used = [], 1  # group 1 is the whole match
    for k in KINDS:
        p = _FORMS[k]
        n = p.count("(") - p.count("(?") - p.count(r"\(")
        for i in range(n, 0, -1):
            p = p.replace(f"\\{i}", f"\\{i + used}")
        used += n
        edge = r"(?<![0-9A-Za-z+.])" if k == "ip" else _EDGE
        end = r"(?![0-9A-Za-z])(?!\.[0-9])" if k == "ip" else _DATE_END if k == "date" else _END
        out.append(f"{edge}(?:{p}){end}")
    return "(" + "|".join(out) + ")"


PATTERN = _any_pattern()


# -- the network

def permute(items: Column, tweak: str, key: str, rounds: int = ROUNDS) -> Column:
    """``items array<struct<b, v, m>>``: symbols ``b + v`` with ``0 <= v < m``.
    Returns the permuted symbols ``array<int>``."""
    def net(it: Column) -> Column:
        n = F.size(it)
        half = F.floor(n / 2).cast("int")
        start = F.transform(it, lambda x: x["v"].cast("int"))

        def step(v: Column, r: Column) -> Column:
            left = r % 2 == 0  # even rounds change the left half
            other = F.array_join(F.filter(v, lambda _, i: (i < half) != left).cast("array<string>"), ",")
            return let(other, lambda o: F.transform(v, lambda x, i: F.when((i < half) == left, F.pmod(
                x + _hash(key, tweak, n, r, o, i), F.get(it, i)["m"])).otherwise(x).cast("int")))

        out = F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start.cast("array<int>"), step)
        return let(out, lambda v: F.transform(it, lambda x, i: (x["b"] + F.get(v, i)).cast("int")))

    return let(items, net)


def _hash(key: str, tweak: str, n: Column, r: Column, other: Column, i: Column) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), n.cast("string"), r.cast("string"), other, i.cast("string")).cast("binary"), 256)
    return F.pmod(F.conv(F.substring(h, 1, 12), 16, 10).cast("long"), F.lit(1 << 30).cast("long")).cast("int")


def _item(base: Column, v: Column, m) -> Column:
    return F.struct(base.cast("int").alias("b"), v.cast("int").alias("v"), (m if isinstance(m, Column) else F.lit(m)).cast("int").alias("m"))


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _char_item(c: Column) -> Column:
    """A character within its class: a-z, A-Z, 0-9; others stay."""
    a = F.ascii(c)
    return (F.when(c.between("a", "z"), _item(F.lit(97), a - 97, 26)).when(c.between("A", "Z"), _item(F.lit(65), a - 65, 26))
            .when(c.between("0", "9"), _item(F.lit(48), a - 48, 10)).otherwise(_item(a, F.lit(0), 1)))


def _text_of(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda x: F.char(x.cast("long"))), "")


def _thread(template: Column, digits: Column) -> Column:
    """Put ``digits`` in place of the template's digits, separators kept."""
    return F.array_join(F.transform(_chars(template), lambda c, i: F.when(
        c.between("0", "9"), F.substring(digits, F.length(_digits(F.substring(template, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")


# -- checks and replacements by kind

def luhn_sum(digits: Column, double_last: bool) -> Column:
    """Luhn sum of a digit string; the last digit doubled or not."""
    odd = 0 if double_last else 1
    vals = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(
        i % 2 == odd, let(c.cast("int") * 2, lambda d: F.when(d > 9, d - 9).otherwise(d))).otherwise(c.cast("int")))
    return F.aggregate(vals, F.lit(0), lambda a, x: a + x)


def _mod97(alnum: Column) -> Column:
    """An IBAN-style number (letters as 10 .. 35) modulo 97."""
    return F.aggregate(_chars(alnum), F.lit(0), lambda a, c: F.when(
        c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _email(m: Column, key: str) -> Column:
    tail = F.substring_index(m, ".", -1)
    head = F.substring(m, F.lit(1), F.length(m) - F.length(tail))
    return F.concat(_text_of(permute(F.transform(_chars(head), _char_item), "email", key)), tail)


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        out = _text_of(permute(F.transform(_chars(body), _char_item), "card", key))
        return let(out, lambda p: F.concat(p, F.pmod(10 - luhn_sum(p, True) % 10, F.lit(10)).cast("string")))

    return let(_digits(m), lambda d: F.when(
        (luhn_sum(d, False) % 10 == 0) & d.rlike("[1-9]"), let(new(d), lambda p: _thread(m, p))))


def _phone(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        n = F.length(d)
        # the country code stays and is no part of what is permuted: a number with and without it stays linked
        code = F.when(n > 10, n - 10).when(m.startswith("+"), F.lit(2)).otherwise(F.lit(0))

        def item(c: Column, i: Column) -> Column:
            x, first = c.cast("int"), (i == 0) | (i == 3)  # area and exchange begin with 2 to 9
            return (F.when(first & (x >= 2), _item(F.lit(50), x - 2, 8)).when(first, _item(F.lit(48), x, 2))
                    .otherwise(_item(F.lit(48), x, 10)))

        own = F.transform(_chars(F.substring(d, code + 1, n)), item)
        return F.concat(F.substring(d, F.lit(1), code), _text_of(permute(own, "phone", key)))

    return let(_digits(m), lambda d: F.when(F.length(d).between(8, 15), let(new(d), lambda p: _thread(m, p))))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: _item(F.lit(0), x.cast("int"), 256))
    return F.array_join(permute(parts, "ip", key).cast("array<string>"), ".")


def _ssn(m: Column, key: str) -> Column:
    def new(p: Column) -> Column:
        area, group, serial = p[0], p[1], p[2]
        ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        items = F.array(_item(F.lit(0), F.when(area < 666, area - 1).otherwise(area - 2), 898),
                        _item(F.lit(1), group - 1, 99), _item(F.lit(1), serial - 1, 9999))
        return F.when(ok, let(permute(items, "ssn", key), lambda v: F.format_string(
            "%03d-%02d-%04d", F.when(v[0] < 665, v[0] + 1).otherwise(v[0] + 2), v[1], v[2])))

    return let(F.split(m, "-").cast("array<int>"), new)


def _iban(m: Column, key: str) -> Column:
    def new(s: Column) -> Column:
        land, body = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s) - 4)
        valid = _mod97(F.concat(body, F.substring(s, 1, 4))) == 1
        out = _text_of(permute(F.transform(_chars(body), _char_item), "iban", key))
        return F.when(valid & F.length(s).between(15, 34), let(out, lambda b: F.concat(
            land, F.lpad((98 - _mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b)))

    def thread(p: Column) -> Column:  # blanks back to where they were
        return F.array_join(F.transform(_chars(m), lambda c, i: F.when(c == " ", c).otherwise(F.substring(
            p, F.length(F.replace(F.substring(m, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")

    return let(F.replace(m, F.lit(" "), F.lit("")), lambda s: let(new(s), lambda p: F.when(p.isNotNull(), thread(p))))


def _date(m: Column, key: str) -> Column:
    def shifted(fmt: str) -> Column:
        day = F.try_to_timestamp(m, F.lit(fmt)).cast("date")
        at = F.date_diff(day, F.lit(DAY_ZERO).cast("date"))
        items = F.array(_item(F.lit(0), F.floor(at / DAYS[1]), DAYS[0]), _item(F.lit(0), F.pmod(at, F.lit(DAYS[1])), DAYS[1]))
        return F.when(day.isNotNull(), F.date_format(let(permute(items, "date", key), lambda v: F.date_add(
            F.lit(DAY_ZERO).cast("date"), v[0] * DAYS[1] + v[1])), fmt))

    return (F.when(m.rlike("^[0-9]{4}-"), shifted("yyyy-MM-dd")).when(m.rlike("^[0-9]{4}/"), shifted("yyyy/MM/dd")).when(m.rlike(r"^[0-9]{2}\."), shifted("dd.MM.yyyy"))
            .otherwise(shifted("dd/MM/yyyy")))


_NEW = {"email": _email, "iban": _iban, "phone": _phone, "card": _card, "ssn": _ssn, "ip": _ip, "date": _date}


def pseudonym(m: Column, key: str) -> Column:
    """``struct<kind, value>`` for one match; the value is NULL if the match
    is not a valid value of its kind."""
    kind = None
    for k in KINDS:
        cond = m.rlike(f"^(?:{_FORMS[k]})$")
        kind = F.when(cond, F.lit(k)) if kind is None else kind.when(cond, F.lit(k))

    def value(k: Column) -> Column:
        out = None
        for name in KINDS:
            out = F.when(k == name, _NEW[name](m, key)) if out is None else out.when(k == name, _NEW[name](m, key))
        return let(out, lambda v: F.struct(k.alias("kind"), v.alias("value")))

    return let(kind, value)


def with_pseudonyms(df: DataFrame, key: str, text: str = "text", hits: str = "pii_hits") -> DataFrame:
    """Replace ``text`` and add ``hits array<struct<kind, value, original>>``-like
    findings without the originals: ``array<struct<kind, value>>``.

    A column named like ``hits`` is replaced by them."""
    df = df.drop(hits)
    t = F.col(f"`{text}`")
    may = t.rlike("@|[0-9]")  # every format has one of these
    none = F.array().cast("array<string>")
    rest = [F.col(f"`{c}`") for c in df.columns]
    s = df.select(*rest, F.when(may, F.regexp_extract_all(t, F.lit(PATTERN), F.lit(1))).otherwise(none).alias("__m"))
    s = s.select(*rest, "__m", F.transform("__m", lambda m: pseudonym(m, key)).alias("__h"))
    gaps = F.split(t, PATTERN, -1)
    new = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), F.col("__m").alias("m"), F.col("__h").alias("h")), lambda x: F.concat(
        x["g"], F.coalesce(x["h"]["value"], x["m"], F.lit("")))), "")
    return s.select(*[F.when(F.size("__m") > 0, new).otherwise(t).alias(text) if c == text else F.col(f"`{c}`") for c in df.columns],
                    F.filter("__h", lambda h: h["value"].isNotNull()).alias(hits))


def session_key(spark) -> str:
    """The key that the session names in ``spark.shiftscope.pii.key``; the
    published one, good for trial runs only, where it names none."""
    return spark.conf.get(KEY_SETTING, PUBLIC_KEY)


def op4_pii(docs: DataFrame) -> DataFrame:
    """Per document: the text with pseudonyms, and how many of each kind."""
    d = with_pseudonyms(docs.select("doc_id", "text"), session_key(docs.sparkSession))
    return d.select("doc_id", "text", *[F.size(F.filter("pii_hits", lambda h: h["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS])
