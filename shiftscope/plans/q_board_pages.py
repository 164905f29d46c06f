"""Queries over HTML pages: the derived board pages and the given ``pages``
(S6–S11, S17, T13, T3, J1, F2, F3, A14).  The oracles state what the pages
say from the keys that they were written from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as REC
from ..session import read_table, shared_folder
from ..sources import board_pages as BP
from ..sources import html_parse as H
from ..sources import pages as PG
from ..sources.postings import postings
from .catalog import register
from .oracle import with_postings
from .q_text import AS_OF, _reldate_sql

RANGE = "за 2 недели"


def _given(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", F.lit("given").alias("kind"), "url", F.lit(200).alias("status"), "html")


def _parsed_board(spark, sf_dir):
    """The listing board's pages, each read once: listings with their cards, detail pages with their fields."""
    p = postings(spark, sf_dir)
    return (H.parse(BP.listing_pages(p), facts=H.CARD_FACTS),
            H.parse(BP.detail_pages(p).select(*BP.PAGE_COLUMNS), facts=H.DETAIL_FACTS))


def _keyed(source: str, name: str) -> str:
    return f"""{name} AS (
  SELECT *, l_pk || '_' || l_sk || '_' || q || '_' || CAST(round(seq.l_extendedprice * 100) AS BIGINT) AS context FROM (
    SELECT *, seq.l_orderkey AS ok, seq.l_linenumber AS ln, seq.l_partkey AS pk, seq.l_suppkey AS sk, CAST(seq.l_quantity AS INTEGER) AS q,
           CAST(seq.l_partkey AS VARCHAR) AS l_pk, CAST(seq.l_suppkey AS VARCHAR) AS l_sk
    FROM postings WHERE source = '{source}'))"""


_AV = _keyed("avito.ru", "av0") + """,
av AS (
  SELECT *, '/' || replace(lower(city), ' ', '-') || '/vakansii/' || replace(title, ' ', '_') || '-' || posting_id || '?context=' || context AS path,
         ok * 2 + pk % 2 AS list_id FROM av0
)"""

# ------------------------------------------------------------------ S8 ----
_CARDS = """cards AS (
  SELECT * FROM (
    SELECT list_id AS page_id, 'https://www.avito.ru/rossiya/vakansii?feed=' || ok || '&p=' || (pk % 2 + 1) AS url_listing,
      row_number() OVER (PARTITION BY list_id ORDER BY seq) - 1 AS pos, 'https://www.avito.ru' || path AS url_detail,
      TRY_CAST(nullif(regexp_extract(path, '-(\\d{6,})', 1), '') AS BIGINT) AS external_id, title,
      CASE WHEN pk % 4 <> 0 THEN 'от ' || (q * 100 + 2000) || ' до ' || (q * 120 + 2500) || ' ₽ за смену' ELSE '' END AS salary_text,
      city AS location_text, CASE WHEN sk % 3 = 0 THEN city || ', ул. ' || sk END AS address_raw, posted_raw AS posted_at_raw,
      pk % 8 IN (0, 2) AS is_promoted, pk % 8 IN (1, 2) AS is_featured, description AS snippet_text, pk, sk, ok, ln, q, seq
    FROM av WHERE pk % 23 <> 0) c
  WHERE external_id IS NOT NULL
)"""
CARD_COLUMNS = ["page_id", "pos", "url_listing", "url_detail", "external_id", "title", "salary_text", "location_text", "address_raw",
                "posted_at_raw", "is_promoted", "is_featured", "snippet_text"]


@register("listing_cards", with_postings(f"SELECT {', '.join(CARD_COLUMNS)} FROM cards", _AV, _CARDS))
def q_listing_cards(spark, sf_dir):
    """Cards of all listing pages (the given pages are no listings)."""
    p = BP.listing_pages(postings(spark, sf_dir)).unionByName(_given(spark, sf_dir))
    return H.listing_cards(H.parse(p, facts=H.CARD_FACTS)).select(*CARD_COLUMNS)


# ------------------------------------------------------------------ S9 ----
def _lines(*parts: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


_DETAIL = f"""detail AS (
  SELECT *, CASE WHEN pk % 2 = 0 THEN description ELSE 'Ищем сотрудника в команду' END AS first_line,
    CASE WHEN duties_raw IS NOT NULL THEN {_lines("duties_raw", "'приходить вовремя'", "'помогать'")} END AS duties,
    CASE WHEN ok % 2 = 0 THEN {_lines("'Опыт приветствуется'", "'Пунктуальность'")} END AS requirements,
    CASE WHEN benefits IS NOT NULL THEN {_lines("benefits", "'Питание за счёт компании'", "'Выезды'")} END AS conditions
  FROM av WHERE pk % 29 <> 0
),
det AS (
  SELECT *, 'https://www.avito.ru' || path AS url_page, pk % 13 = 0 AS gone, {_lines(
      "first_line", "CASE WHEN duties IS NOT NULL THEN 'Обязанности' END", "duties",
      "CASE WHEN requirements IS NOT NULL THEN 'Требования к кандидату' END", "requirements",
      "CASE WHEN conditions IS NOT NULL THEN 'Условия' END", "conditions")} AS descr,
    CASE WHEN sk % 2 = 0 THEN schedule END AS p_schedule,
    CASE WHEN pk % 3 = 0 THEN 'от ' || (q * 1000 + 20000) || ' до ' || (q * 1200 + 25000) || ' ₽ в месяц' END AS p_pay
  FROM detail
),
fields AS (
  SELECT *, CASE WHEN pk % 3 <> 0 THEN 'https://www.avito.ru/user/' || sk END AS profile,
    nullif(regexp_extract(coalesce(p_schedule, descr), '(\\d+/\\d+)', 1), '') AS hint, CAST(q * 3 AS BIGINT) AS views,
    CASE WHEN pk % 2 = 1 THEN CAST(ln AS BIGINT) END AS favs, CAST(pk % 4 + 2 * (sk % 3) AS INTEGER) AS photos,
    CASE WHEN sk % 5 = 0 THEN 'г. ' || city END AS p_city, CASE WHEN sk % 4 = 0 THEN 'Р-н ' || sk END AS p_area,
    CASE WHEN sk % 7 = 0 THEN 'м. ' || (pk % 9) END AS p_metro, CASE WHEN sk % 3 = 1 THEN 'ул. Ленина, ' || sk ELSE '' END AS p_address,
    CASE WHEN ok % 3 = 0 THEN 'Контакт: Анна' END AS contact_raw, CASE WHEN sk % 4 = 1 THEN ln || ' дней назад' END AS updated_raw,
    CASE sk % 3 WHEN 0 THEN [strftime(posted_date, '%Y-%m-%d') || 'T10:30:00+03:00'] WHEN 1 THEN ['скоро', posted_raw] ELSE []::VARCHAR[] END AS times
  FROM det WHERE NOT gone
)"""


def _unescaped(c: str) -> str:
    out = c
    for ent, ch in PG.ENTITIES:
        out = "replace({}, '{}', '{}')".format(out, ent, ch.replace("'", "''"))
    return out


@register("detail_fields", with_postings(
    "SELECT url_page AS url, title, employer AS employer_name, profile AS employer_profile_url, descr AS description,"
    " 'Работа > ' || city AS crumbs, views AS views_count, favs AS favorites_count, photos AS photos_count, p_city AS location_city,"
    " p_area AS location_area, p_metro AS metro, hint AS schedule_hint, employment_raw AS employment_type, experience_raw,"
    " duties, requirements, conditions, contact_raw AS contact, array_to_string(times, '|') AS times, updated_raw AS updated_at_raw, 'ru' AS lang"
    " FROM fields UNION ALL SELECT url, trim(" + _unescaped("regexp_extract(html, '<h1>([^<]*)</h1>', 1)") + "), NULL, NULL, '', '', NULL, NULL, 0, NULL, NULL,"
    " NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '', NULL, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) FROM pages", _AV, _DETAIL))
def q_detail_fields(spark, sf_dir):
    """Fields of all detail pages that were answered, and of the given pages."""
    p = BP.detail_pages(postings(spark, sf_dir)).where("status = 200").select(*BP.PAGE_COLUMNS).unionByName(_given(spark, sf_dir))
    d = H.detail_fields(H.parse(p, facts=H.DETAIL_FACTS))
    return d.select("url", "title", "employer_name", "employer_profile_url", "description", F.array_join("category_path", " > ").alias("crumbs"),
                    "views_count", "favorites_count", "photos_count", "location_city", "location_area", "metro", "schedule_hint",
                    "employment_type", "experience_raw", "duties", "requirements", "conditions", F.col("contact.raw").alias("contact"),
                    F.array_join("times", "|").alias("times"), "updated_at_raw", "lang")


# ------------------------------------------------------------------ S10 ---
@register("page_sections", with_postings(
    "SELECT url, rank() OVER (PARTITION BY url ORDER BY n) - 1 AS pos, heading, text FROM ("
    " SELECT url_page AS url, 1 AS n, 'Обязанности' AS heading, duties AS text FROM fields WHERE duties IS NOT NULL"
    " UNION ALL SELECT url_page, 2, 'Требования к кандидату', requirements FROM fields WHERE requirements IS NOT NULL"
    " UNION ALL SELECT url_page, 3, 'Условия', conditions FROM fields WHERE conditions IS NOT NULL)", _AV, _DETAIL))
def q_page_sections(spark, sf_dir):
    """Heading-delimited sections of all pages (the given ones have none)."""
    p = BP.detail_pages(postings(spark, sf_dir)).select(*BP.PAGE_COLUMNS).unionByName(_given(spark, sf_dir))
    return H.sections(H.parse(p, facts=["sections"]), "url")


@register("page_elements",
          "WITH body AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS h FROM pages),"
          " shown AS (SELECT page_id, h, regexp_replace(regexp_replace(h, '(?is)<script[^>]*>.*?</script>', '<x>', 'g'),"
          "  '(?is)<style[^>]*>.*?</style>', '<x>', 'g') AS s FROM body)"
          " SELECT page_id, tag, count(*) AS n FROM ("
          "  SELECT page_id, lower(unnest(regexp_extract_all(s, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM shown"
          "  UNION ALL SELECT page_id, lower(unnest(regexp_extract_all(h, '<(script|style)[ >]', 1))) FROM shown"
          "  UNION ALL SELECT page_id, unnest(list_transform(regexp_extract_all(s, '>[^<]*[^<\\s][^<]*<', 0), lambda x: '#text')) FROM shown)"
          " WHERE tag <> 'x' GROUP BY ALL")
def q_page_elements(spark, sf_dir):
    """Elements and text chunks per page and tag."""
    t = H.parse(_given(spark, sf_dir), facts=["tags"]).select("page_id", F.explode("tags").alias("t"))
    return t.select("page_id", "t.tag", "t.n")


# ------------------------------------------------------------------ T13 ---
_BLOCK = ("CASE WHEN sk % 4 = 0 AND schedule IS NOT NULL THEN 'полная занятость, график ' || schedule"
          " WHEN sk % 4 = 1 THEN 'сменный, ' || (sk % 3 + 2) || ' через ' || (sk % 2 + 1) END")


@register("page_schedule", with_postings(
    "SELECT url, CASE WHEN sk % 4 = 0 AND schedule IS NOT NULL THEN regexp_extract(schedule, '^(\\d+/\\d+)', 1)"
    " WHEN pk % 3 = 0 THEN (CASE WHEN sk % 4 = 1 AND (sk % 3 + 2 <> 2 OR sk % 2 + 1 <> 2) THEN '2/2, ' || (sk % 3 + 2) || '/' || (sk % 2 + 1) ELSE '2/2' END)"
    " WHEN sk % 4 = 1 THEN (sk % 3 + 2) || '/' || (sk % 2 + 1) END AS schedule,"
    " CASE WHEN pk % 3 IN (0, 1) THEN CAST(pk % 5 + 8 AS DOUBLE) END AS shift_hours"
    " FROM (SELECT * EXCLUDE (url), 'https://hh.ru/vacancy/' || posting_id || '?context=' || context AS url FROM hh)"
    f" WHERE ({_BLOCK}) IS NOT NULL OR pk % 3 IN (0, 1)", _keyed("hh.ru", "hh")))
def q_page_schedule(spark, sf_dir):
    """Schedules stated by vacancy pages in blocks or labelled text (pages
    without either, all given ones among them, have no row)."""
    p = BP.vacancy_pages(postings(spark, sf_dir)).select(*BP.PAGE_COLUMNS).unionByName(_given(spark, sf_dir))
    return H.page_schedule(H.parse(p, facts=["schedule_texts"]).where(F.size("schedule_texts") > 0), "url")


# ------------------------------------------------------------------ S6, S7 --
_GR = _keyed("gorodrabot.ru", "gr0") + """,
gr AS (
  SELECT *, 'https://gorodrabot.ru/vacancy/' || posting_id || '?context=' || context AS url_page, pk % 7 <> 0 AS has_ld,
    CASE pk % 4 WHEN 0 THEN round_even((q * 1000 + 20000) / 1000.0, 1) WHEN 1 THEN round_even((q * 1000 + 150) / 1000.0, 1) END AS lo_k,
    CASE WHEN pk % 4 = 0 THEN round_even((q * 1500 + 30000) / 1000.0, 1) END AS hi_k, strftime(posted_date, '%Y-%m-%d') AS published
  FROM gr0
)"""


def _jobposting_pages(spark, sf_dir):
    return BP.jobposting_pages(postings(spark, sf_dir)).select(*BP.PAGE_COLUMNS).unionByName(_given(spark, sf_dir))


@register("jsonld_postings", with_postings(
    "SELECT url_page AS url, title, description, employer, published, lo_k AS salary_from_k, hi_k AS salary_to_k FROM gr WHERE has_ld", _GR))
def q_jsonld_postings(spark, sf_dir):
    """JobPosting facts of all pages that state them."""
    return PG.jsonld_postings(_jobposting_pages(spark, sf_dir), "url")


@register("page_posting", with_postings(
    "SELECT url_page AS url, CASE WHEN has_ld THEN title WHEN pk % 2 = 0 THEN 'Работа: ' || title ELSE title || ' — вакансия' END AS title,"
    " coalesce(CASE WHEN has_ld THEN employer END, CASE WHEN sk % 2 = 0 THEN 'ООО ' || employer END) AS employer,"
    " coalesce(CASE WHEN has_ld THEN description END, CASE WHEN sk % 3 <> 0 THEN description || ' ' || hours_text END) AS description,"
    " CASE WHEN has_ld THEN published END AS published, CASE WHEN has_ld THEN lo_k END AS salary_from_k, CASE WHEN has_ld THEN hi_k END AS salary_to_k"
    " FROM gr", _GR))
def q_page_posting(spark, sf_dir):
    """Posting facts of pages by falling evidence: JSON-LD, titles, marked elements."""
    p = BP.jobposting_pages(postings(spark, sf_dir)).select(*BP.PAGE_COLUMNS)
    return PG.page_posting(H.parse(p.withColumn("jsonld", PG.jsonld_posting(F.col("html"))), facts=["fields"])).drop("page_id")


# ------------------------------------------------------------------ S11, S17 --
@register("board_links", with_postings(
    "SELECT DISTINCT list_id AS page_id, 'https://www.avito.ru' || regexp_extract(path, '^([^?]*)', 1) AS link,"
    " posting_id >= 100000 AS is_item FROM av WHERE pk % 23 <> 0", _AV))
def q_board_links(spark, sf_dir):
    """Links of the listing pages: item URLs among them."""
    return PG.page_links(BP.listing_pages(postings(spark, sf_dir)))


@register("board_hash", with_postings(
    "SELECT url_page AS url, sha256(CASE WHEN gone THEN '' ELSE '<div data-marker=\"' || (CASE WHEN sk % 2 = 0 THEN 'item-description/text' ELSE 'item-description' END)"
    " || '\"><p>' || first_line || '</p>' || coalesce('<h2>Обязанности</h2><p>' || duties_raw || '</p><ul><li>приходить вовремя</li><li>помогать</li></ul>', '')"
    " || (CASE WHEN ok % 2 = 0 THEN '<h3>Требования к кандидату</h3>Опыт приветствуется<br>Пунктуальность' ELSE '' END)"
    " || coalesce('<strong>Условия</strong><ul><li>' || benefits || '</li><li>Питание за счёт компании</li><li>Выезды</li></ul>', '') || '</div>' END)"
    " AS snapshot_hash FROM det", _AV, _DETAIL))
def q_board_hash(spark, sf_dir):
    """Snapshot hashes of the detail pages: of the description block, if there is one."""
    return BP.detail_pages(postings(spark, sf_dir)).select("url", PG.snapshot_hash(F.col("html")).alias("snapshot_hash"))


# ------------------------------------------------------------------ T3 candidates --
_SALARY = """CASE WHEN pk % 3 = 0 THEN 'params' WHEN pk % 4 <> 0 THEN 'card' WHEN pk % 2 = 0 THEN 'first_line' END AS salary_source,
    CAST(CASE WHEN pk % 3 = 0 THEN q * 1000 + 20000 WHEN pk % 4 <> 0 THEN q * 100 + 2000 WHEN pk % 2 = 0 THEN least(q * 10 + 150, sk % 5 + 1) END AS DOUBLE) AS salary_from,
    CAST(CASE WHEN pk % 3 = 0 THEN q * 1200 + 25000 WHEN pk % 4 <> 0 THEN q * 120 + 2500 WHEN pk % 2 = 0 THEN greatest(q * 10 + 150, sk % 5 + 1) END AS DOUBLE) AS salary_to,
    CASE WHEN pk % 3 = 0 THEN 'per_month' WHEN pk % 4 <> 0 THEN 'per_shift' WHEN ln % 2 = 0 THEN 'per_hour' ELSE 'per_shift' END AS salary_period"""


@register("salary_candidates", with_postings(
    "SELECT url, row_number() OVER (PARTITION BY url ORDER BY n) - 1 AS rank, source, text, CAST(lo AS DOUBLE) AS min, CAST(hi AS DOUBLE) AS max,"
    " CASE WHEN lo IS NOT NULL THEN 'RUB' END AS currency, period, lo IS NOT NULL AND n = min(CASE WHEN lo IS NOT NULL THEN n END) OVER (PARTITION BY url) AS chosen"
    " FROM (SELECT url_page AS url, 1 AS n, 'params' AS source, 'по договорённости' AS text, NULL AS lo, NULL AS hi, NULL AS period FROM det_card WHERE pk % 6 = 0"
    " UNION ALL SELECT url_page, 2, 'params', p_pay, q * 1000 + 20000, q * 1200 + 25000, 'per_month' FROM det_card WHERE pk % 3 = 0"
    " UNION ALL SELECT url_page, 3, 'card', salary_text, q * 100 + 2000, q * 120 + 2500, 'per_shift' FROM det_card WHERE salary_text <> ''"
    " UNION ALL SELECT url_page, 4, 'first_line', first_line, CASE WHEN pk % 2 = 0 THEN least(q * 10 + 150, sk % 5 + 1) END,"
    "  CASE WHEN pk % 2 = 0 THEN greatest(q * 10 + 150, sk % 5 + 1) END, CASE WHEN pk % 2 = 0 THEN (CASE WHEN ln % 2 = 0 THEN 'per_hour' ELSE 'per_shift' END) END"
    "  FROM det_card)", _AV, _CARDS, _DETAIL,
    "det_card AS (SELECT f.*, c.salary_text FROM fields f JOIN cards c ON f.url_page = c.url_detail)"))
def q_salary_candidates(spark, sf_dir):
    """Every text of a card and its detail page that may state the salary, in
    order of evidence, with what was read and which one counts."""
    listings, details = _parsed_board(spark, sf_dir)
    cards = H.listing_cards(listings).drop("status", "kind")
    j = REC.card_details(cards, H.detail_fields(details).drop("page_id", "kind")).where("NOT failed")
    found = REC.salary_candidates(F.col("d.salary_params"), F.col("salary_text"), F.col("d.description"))
    return REC.candidate_rows(j.select(F.col("url_detail").alias("url"), found.alias("candidates")), "url")


# ------------------------------------------------------------------ the chain --
_STATE = f"""seen AS (
  SELECT c.external_id, c.page_id, c.pos, c.is_promoted, c.is_featured, c.url_listing, c.url_detail, c.title, c.posted_at_raw, c.location_text, c.address_raw,
    CASE WHEN d.url_page IS NULL THEN NULL WHEN d.gone THEN (CASE WHEN c.pk % 2 = 0 THEN 404 ELSE 429 END) ELSE 200 END AS status, d.url_page IS NULL OR d.gone AS failed,
    f.* EXCLUDE (title, salary_from, salary_to, salary_period),
    {_SALARY.replace('pk %', 'c.pk %').replace('sk %', 'c.sk %').replace('ln %', 'c.ln %').replace('q *', 'c.q *')},
    {_reldate_sql('c.posted_at_raw')} AS card_at
  FROM cards c LEFT JOIN det d ON d.url_page = c.url_detail LEFT JOIN fields f ON f.url_page = c.url_detail
),
kept AS (
  SELECT * FROM seen WHERE (card_at IS NULL OR card_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY) AND (failed OR coalesce(salary_from, salary_to, 0) <> 0)
),
last AS (
  SELECT *, page_id * 100000 + pos AS at,
    max(CASE WHEN failed THEN page_id * 100000 + pos ELSE -1 END) OVER w AS fail_at,
    max(CASE WHEN NOT failed AND is_promoted THEN page_id * 100000 + pos ELSE -1 END) OVER w AS prom_at,
    max(CASE WHEN NOT failed AND is_featured THEN page_id * 100000 + pos ELSE -1 END) OVER w AS feat_at,
    count(*) OVER w AS n, row_number() OVER (PARTITION BY external_id ORDER BY page_id DESC, pos DESC) AS r
  FROM kept WINDOW w AS (PARTITION BY external_id)
)"""
_STATE_DETAIL = {
    "employer_name": "employer", "employer_profile_url": "profile", "location_city": "coalesce(p_city, location_text)", "location_area": "p_area",
    "metro": "p_metro", "address": "coalesce(address_raw, p_address)", "salary_from": "salary_from", "salary_to": "salary_to",
    "salary_currency": "CASE WHEN salary_from IS NOT NULL THEN 'RUB' END", "salary_period": "salary_period", "salary_source": "salary_source",
    "schedule_hint": "hint", "employment_type": "employment_raw", "experience_raw": "experience_raw", "duties": "duties",
    "requirements": "requirements", "conditions": "conditions",
    "benefits": "array_to_string(list_filter([trim(benefits, ' -•'), CASE WHEN conditions IS NOT NULL THEN 'Питание за счёт компании' END],"
                " lambda x: x IS NOT NULL AND regexp_matches(x, '(?i)(питани|обеды|форма|медкниж|страхов|проезд)')), '|')",
    "contact": "contact_raw",
    "posted_at": f"CASE sk % 3 WHEN 0 THEN CAST(posted_date AS TIMESTAMP) + INTERVAL 630 MINUTE WHEN 1 THEN {_reldate_sql('posted_raw')} END",
    "posted_raw": "CASE sk % 3 WHEN 0 THEN times[1] ELSE posted_raw END", "updated_at": _reldate_sql("updated_raw"), "views_count": "views",
    "favorites_count": "favs", "category_path": "'Работа|' || city", "photos_count": "photos", "lang": "'ru'"}


_REPORT = _STATE[:_STATE.index(",\nlast AS")].replace(" AND (failed OR coalesce(salary_from, salary_to, 0) <> 0)", "")
_REPORT = _REPORT + """,
record AS (
  SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY page_id DESC, pos DESC) AS r FROM kept
)"""


@register("collection_coverage", with_postings(
    "SELECT (SELECT count(*) FROM kept) AS sightings, (SELECT count(*) FROM kept WHERE NOT failed) AS details,"
    " (SELECT count(*) FROM kept WHERE failed) AS failures, (SELECT count(*) FROM kept WHERE status IN (403, 429)) AS blocks, count(*) AS records,"
    " count(*) FILTER (NOT failed AND coalesce(salary_from, salary_to, 0) <> 0) * 100.0 / greatest(count(*), 1) AS salary_pct,"
    " count(*) FILTER (NOT failed AND hint IS NOT NULL) * 100.0 / greatest(count(*), 1) AS hours_pct FROM record WHERE r = 1",
    _AV, _CARDS, _DETAIL, _REPORT))
def q_collection_coverage(spark, sf_dir):
    """Report of one collection run over the board pages: records, shares,
    details read, failures and refusals."""
    listings, details = _parsed_board(spark, sf_dir)
    return REC.collection_coverage(listings, F.lit(AS_OF).cast("timestamp_ntz"), shared_folder(spark, "collected"), F.lit(RANGE), details)


@register("board_pages_state", with_postings(
    "SELECT external_id, NOT failed AS is_active, title, url_listing, url_detail, status, "
    + ", ".join(f"CASE WHEN NOT failed THEN {v} END AS {k}" for k, v in _STATE_DETAIL.items())
    + ", NOT failed AND prom_at > fail_at AS is_promoted, NOT failed AND feat_at > fail_at AS is_featured, n - 1 AS repeats FROM last WHERE r = 1",
    _AV, _CARDS, _DETAIL, _STATE))
def q_board_pages_state(spark, sf_dir):
    """The whole chain over HTML pages: parse, cards, freshness, details by
    URL, salary candidates, salary required, current state per posting."""
    listings, details = _parsed_board(spark, sf_dir)
    state = REC.pages_state(listings, F.lit(AS_OF).cast("timestamp_ntz"), F.lit(RANGE), only_with_salary=True, details=details)
    return state.withColumns({"benefits": F.array_join("benefits", "|"), "category_path": F.array_join("category_path", "|")})
