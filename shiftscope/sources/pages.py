"""Raw page corpus jobs.

All work here is native regex over the ``html`` column; the page is never
shipped to Python.  Element-level parsing (cards, detail fields,
sections) lives in ``sources.html_parse``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.text import NBSP, NNBSP
from ..operators.relational import is_item_url, url_canon

# -- P4 ---------------------------------------------------------------------
ENTITIES = [("&nbsp;", NBSP), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def unescape_basic(c: Column) -> Column:
    """Decode the common named entities (&amp; last)."""
    out = c
    for ent, ch in ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def page_text(html: Column) -> Column:
    """Visible text: script/style/comments dropped, tags -> space, entities
    decoded, NBSP/NNBSP -> space, whitespace squeezed."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script\s*>", " ")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = unescape_basic(t)
    t = F.translate(t, NBSP + NNBSP, "  ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


# -- S7 ---------------------------------------------------------------------
def page_title(html: Column) -> Column:
    """og:title content, else the <title> text (trimmed, entities decoded)."""
    # the og:title meta tag (attributes in any order), then its content
    tag = F.regexp_extract(html, r"(?is)<meta[^>]*property=[\"']og:title[\"'][^>]*>", 0)
    og = F.regexp_extract(tag, r"(?is)content=[\"']([^\"']*)[\"']", 1)
    tt = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    og = F.trim(unescape_basic(og))
    tt = F.trim(unescape_basic(tt))
    return F.when(og != "", og).when(tt != "", tt)


# -- S6 ---------------------------------------------------------------------
JSONLD_RE = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
JOBPOSTING_SCHEMA = ("struct<`@type`:string,title:string,name:string,description:string,"
                     "hiringOrganization:struct<name:string>,datePosted:string,"
                     "baseSalary:struct<value:struct<minValue:string,value:string,maxValue:string>>>")


def jsonld_posting(html: Column) -> Column:
    """First JSON-LD JobPosting of a page, NULL where there is none: title or
    name, description, employer, date cut at 'T'/'+', salary minimum (or
    value) and maximum in thousands (0.1).  Row-local: no shuffle."""
    # a block is one object or an array of objects; a type is a name or a list of names
    blocks = F.transform(F.regexp_extract_all(html, F.lit(JSONLD_RE), 1), lambda js: F.coalesce(
        F.from_json(js, f"array<{JOBPOSTING_SCHEMA}>"), F.array(F.from_json(js, JOBPOSTING_SCHEMA))))
    jobs = F.filter(F.flatten(blocks), lambda o: (o["@type"] == "JobPosting") | F.coalesce(
        F.array_contains(F.from_json(o["@type"], "array<string>"), "JobPosting"), F.lit(False)))

    def facts(o: Column) -> Column:
        pay = o["baseSalary"]["value"]
        amount = lambda c: F.nullif(c.try_cast("double"), F.lit(0.0))
        low, high = F.coalesce(amount(pay["minValue"]), amount(pay["value"])), amount(pay["maxValue"])
        thousands = lambda x: F.bround(x / 1000.0, 1)
        return F.struct(F.coalesce(o["title"], o["name"]).alias("title"), o["description"].alias("description"),
                        o["hiringOrganization"]["name"].alias("employer"),
                        F.regexp_extract(o["datePosted"], "^([^T+]*)", 1).alias("published"),
                        thousands(low).alias("salary_from_k"), thousands(high).alias("salary_to_k"))

    return F.get(F.transform(jobs, facts), F.lit(0))


JSONLD_COLUMNS = ["title", "description", "employer", "published", "salary_from_k", "salary_to_k"]


def jsonld_postings(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Pages that state a JobPosting, with its facts."""
    found = pages.select(id_col, jsonld_posting(F.col("html")).alias("o")).where(F.col("o").isNotNull())
    return found.select(id_col, *[F.col(f"o.{c}").alias(c) for c in JSONLD_COLUMNS])


def page_posting(parsed: DataFrame, jsonld: str = "jsonld") -> DataFrame:
    """Posting facts of a page by falling evidence: JSON-LD, then og:title or
    the page's title, then elements marked as employer or description.
    ``parsed``: parsed pages with the JSON-LD facts in a struct column."""
    o, f = F.col(jsonld), F.col("fields")
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    rest = [F.col(c) for c in parsed.columns if c in ("page_id", "url")]
    return parsed.select(
        *rest, F.coalesce(filled(o["title"]), f["og_title"], f["page_title"]).alias("title"),
        F.coalesce(filled(o["employer"]), filled(f["marked_employer"])).alias("employer"),
        F.coalesce(filled(o["description"]), filled(f["marked_description"])).alias("description"),
        filled(o["published"]).alias("published"), o["salary_from_k"].alias("salary_from_k"), o["salary_to_k"].alias("salary_to_k"))


# -- S11 --------------------------------------------------------------------
HREF_RE = r"(?i)href=\"([^\"]*)\""
ABS_RE = r"(https?://[^\s\"'<>]+)"
URLPATH_RE = r"\"urlPath\":\"(/[^\"]+/vakansii/[^\"]+?-\d{6,})\""
JSONURL_RE = r"\"url\":\"(//www\.avito\.ru/[^\"]+)\""


def resolve(href: Column, base: Column) -> Column:
    """urljoin for the common forms: absolute, //host, /path, relative."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    base_dir = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^?#]*/)", 1)
    h = F.trim(href)
    return (F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
             .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
             .when(h.startswith("/"), F.concat(origin, h))
             .when(h.startswith("#") | (h == ""), F.lit(None))
             .otherwise(F.concat(F.when(base_dir != "", base_dir).otherwise(F.concat(origin, F.lit("/"))), h)))


def page_links(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Links harvested from each page (hrefs, absolute URLs in text,
    urlPath / url JSON fragments), resolved, canonicalised, distinct per
    page, with the item-URL flag."""
    hrefs = F.transform(F.regexp_extract_all("html", F.lit(HREF_RE), 1), lambda h: resolve(h, F.col("url")))
    absu = F.regexp_extract_all("html", F.lit(ABS_RE), 1)
    paths = F.transform(F.regexp_extract_all("html", F.lit(URLPATH_RE), 1),
                        lambda p: F.concat(F.lit("https://www.avito.ru"), p))
    jurls = F.transform(F.regexp_extract_all("html", F.lit(JSONURL_RE), 1), lambda p: F.concat(F.lit("https:"), p))
    links = F.array_union(F.array_union(hrefs, absu), F.array_union(paths, jurls))
    out = pages.select(id_col, F.explode(links).alias("raw")).where(
        F.col("raw").isNotNull() & F.col("raw").rlike(r"^https?://"))
    return (out.select(id_col, url_canon(F.col("raw")).alias("link")).distinct()
               .withColumn("is_item", is_item_url(F.col("link"))))


# -- S12 --------------------------------------------------------------------
def link_allowed(u: Column) -> Column:
    """Own board host only with a job token; partner boards always."""
    t = F.lower(F.trim(F.coalesce(u, F.lit(""))))
    token = None
    for tok in lx.LINK_JOB_TOKENS:
        c = t.contains(tok)
        token = c if token is None else (token | c)
    partner = None
    for h in lx.LINK_PARTNER_HOSTS:
        c = t.contains(h)
        partner = c if partner is None else (partner | c)
    return (F.when(t == "", F.lit(False))
             .when(t.contains(lx.LINK_OWN_HOST), token)
             .otherwise(partner))


# -- S17 --------------------------------------------------------------------
DESC_RE = r"(?is)(<div[^>]*data-marker=\"item-description(?:/text)?\"[^>]*>.*?</div>)"


def snapshot_hash(html: Column) -> Column:
    """SHA-256 of the description block when present, else of the page."""
    return F.sha2(F.coalesce(F.regexp_substr(html, F.lit(DESC_RE)), html), 256)
