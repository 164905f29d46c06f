"""Page-corpus queries over the ``pages`` and ``documents`` tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.text import ctrl_clean
from ..operators import marts
from ..session import read_table
from ..sources import pages as PG
from ..sources.postings import postings
from .catalog import register
from .oracle import sql_str, with_postings


def _pages(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", "url", "html")


def _unescape_sql(c: str) -> str:
    out = c
    for ent, ch in PG.ENTITIES:
        out = f"replace({out}, {sql_str(ent)}, {sql_str(ch)})"
    return out


# ------------------------------------------------------------------ S5 ----
@register("pages_scan", "SELECT page_id, url, length(html) AS n_chars FROM pages")
def q_pages_scan(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


# ------------------------------------------------------------------ P4 ----
_PAGE_TEXT_SQL = (
    "trim(regexp_replace(translate(" + _unescape_sql(
        "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script\\s*>', ' ', 'g'),"
        " '(?is)<style[^>]*>.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')")
    + ", '  ', '  '), '\\s+', ' ', 'g'))")


@register("strip_html", f"SELECT page_id, {_PAGE_TEXT_SQL} AS text FROM pages")
def q_strip_html(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", PG.page_text(F.col("html")).alias("text"))


# ------------------------------------------------------------------ S7 ----
@register("page_title",
          "SELECT page_id, CASE WHEN og <> '' THEN og WHEN tt <> '' THEN tt END AS title FROM ("
          " SELECT page_id, trim(" + _unescape_sql(
              "regexp_extract(regexp_extract(html, '(?is)<meta[^>]*property=[\"'']og:title[\"''][^>]*>', 0),"
              " '(?is)content=[\"'']([^\"'']*)[\"'']', 1)")
          + ") AS og, trim(" + _unescape_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + ") AS tt"
          " FROM pages)")
def q_page_title(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", PG.page_title(F.col("html")).alias("title"))


# ------------------------------------------------------------------ S11 ---
def _resolve_sql(h: str) -> str:
    origin = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)"
    scheme = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)"
    base_dir = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^?#]*/)', 1)"
    return (f"(CASE WHEN regexp_matches(trim({h}), '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN trim({h})"
            f" WHEN starts_with(trim({h}), '//') THEN {scheme} || ':' || trim({h})"
            f" WHEN starts_with(trim({h}), '/') THEN {origin} || trim({h})"
            f" WHEN starts_with(trim({h}), '#') OR trim({h}) = '' THEN NULL"
            f" ELSE (CASE WHEN {base_dir} <> '' THEN {base_dir} ELSE {origin} || '/' END) || trim({h}) END)")


def _links_sql() -> str:
    from .q_relational import _canon_sql
    hrefs = f"list_transform(regexp_extract_all(html, {sql_str(PG.HREF_RE)}, 1), lambda h: {_resolve_sql('h')})"
    absu = f"regexp_extract_all(html, {sql_str(PG.ABS_RE)}, 1)"
    paths = f"list_transform(regexp_extract_all(html, {sql_str(PG.URLPATH_RE)}, 1), lambda p: 'https://www.avito.ru' || p)"
    jurls = f"list_transform(regexp_extract_all(html, {sql_str(PG.JSONURL_RE)}, 1), lambda p: 'https:' || p)"
    return (f"SELECT DISTINCT page_id, {_canon_sql('raw')} AS link FROM (SELECT page_id, unnest({hrefs} || {absu} || {paths} || {jurls})"
            " AS raw FROM pages) WHERE raw IS NOT NULL AND regexp_matches(raw, '^https?://')")


@register("page_links", f"SELECT page_id, link, regexp_matches(lower(trim(coalesce(link, ''))), {sql_str(lx.ITEM_URL_RE)})"
                        f" AS is_item FROM ({_links_sql()})")
def q_page_links(spark, sf_dir):
    return PG.page_links(_pages(spark, sf_dir))


@register("page_link_counts", f"SELECT page_id, count(*) AS n_links FROM ({_links_sql()}) GROUP BY page_id")
def q_page_link_counts(spark, sf_dir):
    return PG.page_links(_pages(spark, sf_dir)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))


# ------------------------------------------------------------------ U2 ----
@register("link_union",
          "SELECT link FROM (SELECT unnest(list_transform(regexp_extract_all(html, " + sql_str(PG.HREF_RE)
          + ", 1), lambda h: " + _resolve_sql("h") + ")) AS link FROM pages"
          " UNION SELECT unnest(regexp_extract_all(html, " + sql_str(PG.ABS_RE) + ", 1)) AS link FROM pages)"
          " WHERE link IS NOT NULL ORDER BY link")
def q_link_union(spark, sf_dir):
    from ..operators.relational import link_union
    p = _pages(spark, sf_dir)
    hrefs = p.select(F.explode(F.transform(F.regexp_extract_all("html", F.lit(PG.HREF_RE), 1),
                                           lambda h: PG.resolve(h, F.col("url")))).alias("link"))
    absu = p.select(F.explode(F.regexp_extract_all("html", F.lit(PG.ABS_RE), 1)).alias("link"))
    return link_union(hrefs, absu).where(F.col("link").isNotNull())


# ------------------------------------------------------------------ S12 ---
def _allow_sql(u: str) -> str:
    t = f"lower(trim(coalesce({u}, '')))"
    tok = " OR ".join(f"contains({t}, {sql_str(x)})" for x in lx.LINK_JOB_TOKENS)
    par = " OR ".join(f"contains({t}, {sql_str(x)})" for x in lx.LINK_PARTNER_HOSTS)
    return f"(CASE WHEN {t} = '' THEN false WHEN contains({t}, {sql_str(lx.LINK_OWN_HOST)}) THEN ({tok}) ELSE ({par}) END)"


@register("link_allow", with_postings(
    f"SELECT source, {_allow_sql('url')} AS allowed, count(*) AS n FROM postings GROUP BY 1, 2"))
def q_link_allow(spark, sf_dir):
    p = postings(spark, sf_dir)
    return p.groupBy("source", PG.link_allowed(F.col("url")).alias("allowed")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ S17 ---
@register("page_hash",
          "SELECT page_id, sha256(CASE WHEN d <> '' THEN d ELSE html END) AS snapshot_hash FROM ("
          f" SELECT page_id, html, regexp_extract(html, {sql_str(PG.DESC_RE)}, 1) AS d FROM pages)")
def q_page_hash(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", PG.snapshot_hash(F.col("html")).alias("snapshot_hash"))


# ------------------------------------------------------------------ S16 ---
_PREVIEW_COLS = ["title", "employer", "city", "schedule", "url"]


@register("preview", with_postings(
    "SELECT posting_id, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in _PREVIEW_COLS)
    + " FROM postings ORDER BY seq LIMIT 20"))
def q_preview(spark, sf_dir):
    p = postings(spark, sf_dir)
    return p.orderBy("seq").limit(20).select("posting_id", *_PREVIEW_COLS).na.fill("")


# ------------------------------------------------------------------ P3 ----
@register("ctrl_clean",
          f"SELECT doc_id, regexp_replace(text, {sql_str(lx.CONTROL_CHARS_RE)}, '', 'g') AS text,"
          f" length(text) - length(regexp_replace(text, {sql_str(lx.CONTROL_CHARS_RE)}, '', 'g')) AS n_removed"
          " FROM documents")
def q_ctrl_clean(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    c = ctrl_clean(F.col("text"))
    return d.select("doc_id", c.alias("text"), (F.length("text") - F.length(c)).cast("long").alias("n_removed"))


# ------------------------------------------------------------------ A8 (documents) --
@register("doc_token_freq",
          "SELECT token, n, n * 100.0 / (SELECT count(*) FROM documents) AS pct FROM ("
          " SELECT token, count(*) AS n FROM ("
          "  SELECT trim(unnest(regexp_split_to_array(regexp_replace(lower(text), '\\s+', ' ', 'g'), '[;,]'))) AS token"
          "  FROM documents WHERE text IS NOT NULL) WHERE token <> '' GROUP BY token ORDER BY n DESC, token LIMIT 8)")
def q_doc_token_freq(spark, sf_dir):
    return marts.token_freq(read_table(spark, sf_dir, "documents").select("text"), "text")
