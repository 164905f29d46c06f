"""Relational queries: canonical URLs, union, dedup, anti-join, joins,
merge and upsert, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..operators import extract as X
from ..operators import relational as R
from ..session import cut_lineage, read_table
from ..sources.postings import postings
from .catalog import register
from .oracle import SCHEDULE_OVERRIDES, sched_cfg_sql, sql_str, with_postings
from .q_text import AS_OF, _match_form_sql, _reldate_sql, re2, rx_any


def _canon_sql(u: str) -> str:
    t = f"trim({u})"
    scheme = f"lower(regexp_extract({t}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1))"
    netloc = f"regexp_extract({t}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"
    path = f"regexp_extract({t}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)?([^?#]*)', 1)"
    host0 = f"regexp_replace(lower({netloc}), '^(?:www\\.)+', '')"
    host = f"(CASE WHEN starts_with({host0}, 'm.avito.ru') THEN 'avito.ru' ELSE {host0} END)"
    out_host = f"(CASE WHEN ends_with({host}, 'avito.ru') THEN 'www.avito.ru' ELSE {netloc} END)"
    return (f"(CASE WHEN {u} IS NULL OR {u} = '' THEN {u} ELSE "
            f"(CASE WHEN {scheme} = '' THEN 'https' ELSE {scheme} END) || '://' || {out_host} || {path} END)")


# ------------------------------------------------------------------ P5 ----
@register("url_canon", with_postings(f"SELECT posting_id, {_canon_sql('url')} AS url_canon,"
                                     f" {_canon_sql('url')} AS url_canon2 FROM postings"))
def q_url_canon(spark, sf_dir):
    p = postings(spark, sf_dir)
    c = R.url_canon(F.col("url"))
    # idempotence column: canonicalising twice changes nothing
    return p.select("posting_id", c.alias("url_canon"), R.url_canon(c).alias("url_canon2"))


# ------------------------------------------------------------------ P6 ----
@register("mobile_url", with_postings(
    "SELECT posting_id, 'https://' || (CASE WHEN starts_with(h, 'm.') THEN h ELSE 'm.' || h END) || path AS mobile_url"
    " FROM (SELECT posting_id, replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), 'www.', '') AS h,"
    " regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)?([^?#]*)', 1) AS path FROM postings WHERE url IS NOT NULL)"))
def q_mobile_url(spark, sf_dir):
    p = postings(spark, sf_dir).where(F.col("url").isNotNull())
    return p.select("posting_id", R.mobile_url(F.col("url")).alias("mobile_url"))


# ------------------------------------------------------------------ P7 / P9 -
@register("ext_id", with_postings(
    "SELECT posting_id, TRY_CAST(nullif(regexp_extract(coalesce(url, ''), '-(\\d{6,})', 1), '') AS BIGINT) AS external_id,"
    f" regexp_matches(lower(trim(coalesce(url, ''))), {sql_str(lx.ITEM_URL_RE)}) AS is_item FROM postings"))
def q_ext_id(spark, sf_dir):
    p = postings(spark, sf_dir)
    return p.select("posting_id", R.external_id(F.col("url")).alias("external_id"),
                    R.is_item_url(F.col("url")).alias("is_item"))


@register("export_url", with_postings(
    "SELECT posting_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url,"
    " '^https?://(?:www\\.){2,}', 'https://www.'), '\\?.*$', ''), '^https?://avito\\.ru', 'https://www.avito.ru'),"
    " '^https?://m\\.avito\\.ru', 'https://www.avito.ru') AS url FROM postings"))
def q_export_url(spark, sf_dir):
    return postings(spark, sf_dir).select("posting_id", R.export_url(F.col("url")).alias("url"))


# ------------------------------------------------------------------ U1 ----
@register("union_sources", with_postings(
    "SELECT * FROM ("
    " SELECT posting_id, title, employer, salary_from_k, url, 0 AS source_rank FROM postings WHERE source = 'hh.ru'"
    " UNION ALL BY NAME SELECT posting_id, title, schedule, url, 1 AS source_rank FROM postings WHERE source = 'gorodrabot.ru'"
    " UNION ALL BY NAME SELECT posting_id, title, city, pay_from, url, 2 AS source_rank FROM postings WHERE source = 'avito.ru')"))
def q_union_sources(spark, sf_dir):
    # one written view of the three sources: it is not rebuilt for each of them
    p = cut_lineage(postings(spark, sf_dir).where(F.col("source").isin("hh.ru", "gorodrabot.ru", "avito.ru")).select(
        "source", "posting_id", "title", "employer", "salary_from_k", "schedule", "city", "pay_from", "url"))

    def own(name, *cols):
        return p.where(F.col("source") == name).select("posting_id", "title", *cols, "url")

    return R.union_sources(own("hh.ru", "employer", "salary_from_k"), own("gorodrabot.ru", "schedule"), own("avito.ru", "city", "pay_from"))


# ------------------------------------------------------------------ W1 / O2 -
_DEDUP_CTE = f"""
d0 AS (SELECT posting_id, seq, title, employer, {_canon_sql('url')} AS url FROM postings),
d1 AS (
  SELECT posting_id, seq, title, employer, url FROM (
    SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS rn FROM d0 WHERE url IS NOT NULL) WHERE rn = 1
  UNION ALL SELECT posting_id, seq, title, employer, url FROM d0 WHERE url IS NULL
),
dedup AS (
  SELECT posting_id, seq, title, employer, url FROM (
    SELECT *, row_number() OVER (PARTITION BY title, employer ORDER BY seq) AS rn FROM d1) WHERE rn = 1
)"""


def _dedup_df(spark, sf_dir):
    p = postings(spark, sf_dir).select("posting_id", "seq", "title", "employer", R.url_canon(F.col("url")).alias("url"))
    return R.dedup_first(p)


@register("dedup_first", with_postings("SELECT posting_id, title, employer, url FROM dedup", _DEDUP_CTE))
def q_dedup_first(spark, sf_dir):
    return _dedup_df(spark, sf_dir).select("posting_id", "title", "employer", "url")


@register("fill_to_n", with_postings(
    "SELECT posting_id, title, employer, url FROM dedup ORDER BY seq LIMIT 150", _DEDUP_CTE))
def q_fill_to_n(spark, sf_dir):
    p = postings(spark, sf_dir).select("posting_id", "seq", "title", "employer", R.url_canon(F.col("url")).alias("url"))
    return R.fill_to_n(p, 150).select("posting_id", "title", "employer", "url")


# ------------------------------------------------------------------ J2 ----
@register("no_shift_rates", with_postings(
    "SELECT posting_id, url FROM postings p WHERE NOT EXISTS (SELECT 1 FROM postings r"
    f" WHERE regexp_matches({_match_form_sql('r.full_text')}, {rx_any(lx.SHIFT_MARKERS)})"
    " AND trim(r.url) <> '' AND trim(r.url) = trim(p.url))"))
def q_no_shift_rates(spark, sf_dir):
    # the view is built, and its texts are tested, once: both sides read the narrow result
    p = cut_lineage(postings(spark, sf_dir).select("posting_id", "url", X.is_shift_rate(F.col("full_text")).alias("shift")))
    rates = p.where("shift").select(F.lit("shift").alias("type"), "url")
    return R.drop_shift_rated(p.drop("shift"), rates)


# ------------------------------------------------------------------ A13 ---
_A13_COLS = ["title", "employer", "city", "salary_from_k", "salary_to_k", "hourly", "schedule", "url", "benefits"]


def _filled_sql(cols):
    return " + ".join(f"(CASE WHEN {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '' THEN 1 ELSE 0 END)" for c in cols)


@register("best_record", with_postings(
    "SELECT posting_id, title, employer, salary_from_k, hourly, url FROM ("
    f" SELECT *, row_number() OVER (PARTITION BY coalesce(CAST(posting_id AS VARCHAR), url)"
    f" ORDER BY {_filled_sql(_A13_COLS)} DESC, seq DESC) AS rn FROM postings) WHERE rn = 1"))
def q_best_record(spark, sf_dir):
    p = postings(spark, sf_dir).select("posting_id", "seq", *_A13_COLS)
    key = F.coalesce(F.col("posting_id").cast("string"), F.col("url"))
    return R.best_record(p, key, _A13_COLS).select("posting_id", "title", "employer", "salary_from_k", "hourly", "url")


# ------------------------------------------------------------------ A14 ---
_SIGHT_SQL = """
sight AS (
  SELECT posting_id AS external_id, seq, title, salary_from, url,
         seq.l_partkey % 13 = 0 AS failed, seq.l_suppkey % 4 = 0 AS promo, seq.l_partkey % 6 = 0 AS feat
  FROM postings
),
st AS (
  SELECT external_id, arg_max(struct_pack(failed := failed, title := title, salary_from := salary_from, url := url), seq) AS l,
         max(CASE WHEN failed THEN seq END) AS lf,
         max(CASE WHEN NOT failed AND promo THEN seq END) AS lp,
         max(CASE WHEN NOT failed AND feat THEN seq END) AS lx,
         count(*) AS n
  FROM sight GROUP BY external_id
)"""


def _sightings(spark, sf_dir):
    p = postings(spark, sf_dir)
    return p.select(F.col("posting_id").alias("external_id"), "seq", "title", "salary_from", "url",
                    (F.col("seq.l_partkey") % 13 == 0).alias("failed"),
                    (F.col("seq.l_suppkey") % 4 == 0).alias("is_promoted"),
                    (F.col("seq.l_partkey") % 6 == 0).alias("is_featured"))


@register("posting_state", with_postings(
    "SELECT external_id, NOT l.failed AS is_active,"
    " CASE WHEN NOT l.failed THEN l.title END AS title, CASE WHEN NOT l.failed THEN l.salary_from END AS salary_from,"
    " CASE WHEN NOT l.failed THEN l.url END AS url,"
    " (NOT l.failed AND lp IS NOT NULL AND (lf IS NULL OR lp > lf)) AS is_promoted,"
    " (NOT l.failed AND lx IS NOT NULL AND (lf IS NULL OR lx > lf)) AS is_featured,"
    " n - 1 AS repeats FROM st", _SIGHT_SQL))
def q_posting_state(spark, sf_dir):
    return R.posting_state(_sightings(spark, sf_dir), record_cols=["title", "salary_from", "url"])


# ------------------------------------------------------------------ A15 ---
@register("qa_sample", with_postings(
    "SELECT external_id, l.title AS title, l.url AS url FROM ("
    " SELECT external_id, min(seq) AS f, arg_max(struct_pack(title := title, url := url), seq) AS l FROM sight"
    " GROUP BY external_id) ORDER BY f LIMIT 10", _SIGHT_SQL))
def q_qa_sample(spark, sf_dir):
    s = _sightings(spark, sf_dir).select("external_id", "seq", "title", "url")
    return R.qa_sample(s, "external_id")


# ------------------------------------------------------------------ J1 ----
@register("card_detail", with_postings(
    "SELECT posting_id, url, coalesce(st, 0) < 400 AND st IS NOT NULL AS is_active, st AS detail_status,"
    " CASE WHEN st < 400 THEN o_totalprice END AS detail_price"
    " FROM (SELECT p.posting_id, p.url, o.o_totalprice,"
    "  CASE o.o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 200 WHEN 'P' THEN 404 END AS st"
    "  FROM postings p LEFT JOIN orders o ON p.seq.l_orderkey = o.o_orderkey)"))
def q_card_detail(spark, sf_dir):
    p = postings(spark, sf_dir).select("posting_id", "url", F.col("seq.l_orderkey").alias("ok"))
    o = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ok"), "o_totalprice",
        F.when(F.col("o_orderstatus").isin("F", "O"), 200).when(F.col("o_orderstatus") == "P", 404)
         .alias("detail_status"))
    j = p.join(o, "ok", "left")
    st = F.col("detail_status")
    return j.select("posting_id", "url", (st.isNotNull() & (st < 400)).alias("is_active"), st.alias("detail_status"),
                    F.when(st < 400, F.col("o_totalprice")).alias("detail_price"))


# ------------------------------------------------------------------ J3 / S14 -
@register("sched_lookup", with_postings(
    "SELECT p.posting_id, p.schedule, c.shifts_per_month, c.hours_per_shift FROM postings p"
    " LEFT JOIN cfg c ON p.schedule = c.schedule", sched_cfg_sql()))
def q_sched_lookup(spark, sf_dir):
    dim = R.schedule_config(spark, SCHEDULE_OVERRIDES)
    return R.schedule_lookup(postings(spark, sf_dir).select("posting_id", "schedule"), dim)


# ------------------------------------------------------------------ J4 ----
@register("prefill", with_postings(
    "SELECT url, arg_min(title, seq) AS first_title, arg_max(full_text, seq) AS last_blob FROM postings"
    " WHERE url IS NOT NULL GROUP BY url"))
def q_prefill(spark, sf_dir):
    return R.prefill(postings(spark, sf_dir))


# ------------------------------------------------------------------ J5 ----
@register("item_detail", with_postings(
    "SELECT p.posting_id, coalesce(d.p_type, p.title) AS detail FROM postings p LEFT JOIN"
    " (SELECT p_partkey, p_type FROM part WHERE p_size > 10) d ON p.seq.l_partkey = d.p_partkey"))
def q_item_detail(spark, sf_dir):
    p = postings(spark, sf_dir).select("posting_id", "title", F.col("seq.l_partkey").alias("pk"))
    d = read_table(spark, sf_dir, "part").where(F.col("p_size") > 10).select(F.col("p_partkey").alias("pk"), "p_type")
    return p.join(d, "pk", "left").select("posting_id", F.coalesce("p_type", "title").alias("detail"))


# ------------------------------------------------------------------ J6 ----
FEED_QUERIES = ["ring", "widget", "bolt", "gear", "gizmo", "sprocket"]


@register("coverage_grid", with_postings(
    "SELECT g.r_name, g.n_name, g.query, coalesce(c.n, 0) AS n FROM ("
    " SELECT r_name, n_name, unnest([" + ", ".join(sql_str(q) for q in FEED_QUERIES) + "]) AS query"
    " FROM nation JOIN region ON n_regionkey = r_regionkey) g"
    " LEFT JOIN (SELECT city, split_part(title, ' ', 2) AS noun, count(*) AS n FROM postings GROUP BY 1, 2) c"
    " ON c.city = g.n_name AND c.noun = g.query"))
def q_coverage_grid(spark, sf_dir):
    nat = read_table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    reg = read_table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    places = nat.join(reg, "n_regionkey").select("r_name", "n_name")
    grid = R.feed_grid(places, FEED_QUERIES).drop("category")
    counts = (postings(spark, sf_dir)
              .groupBy(F.col("city").alias("n_name"), F.split(F.col("title"), " ").getItem(1).alias("query"))
              .agg(F.count(F.lit(1)).alias("n")))
    return (grid.join(counts, ["n_name", "query"], "left")
                .select("r_name", "n_name", "query", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


# ------------------------------------------------------------------ F1 ----
def role_cond_sql(t: str, rules) -> str:
    inc = "|".join(re2(p) for p in rules.get("inc", [".*"]))
    exc_plain = [p for p in rules.get("exc", []) if "(?=" not in p]
    cond = f"regexp_matches({t}, {sql_str('(?i)' + inc)})"
    if exc_plain:
        cond += f" AND NOT regexp_matches({t}, {sql_str('(?i)' + '|'.join(re2(p) for p in exc_plain))})"
    for p in rules.get("exc", []):
        if "(?=" in p:  # '^(?=.*A)(?!.*B).*$' == contains A and not contains B
            a = p.split("(?=.*", 1)[1].split(")(?!", 1)[0]
            b = p.split("(?!.*", 1)[1].split(")", 1)[0]
            cond += f" AND NOT (regexp_matches({t}, {sql_str(a)}) AND NOT regexp_matches({t}, {sql_str(b)}))"
    return cond


ROLE_TITLES_SQL = "lower(concat_ws(' ', title, employer))"


@register("role_filter", with_postings(
    "SELECT role, count(*) AS n FROM (SELECT unnest(list_filter(["
    + ", ".join(f"CASE WHEN {role_cond_sql(ROLE_TITLES_SQL, r)} THEN {sql_str(name)} END"
                for name, r in lx.ROLE_FILTERS.items())
    + ", 'any'], lambda x: x IS NOT NULL)) AS role FROM postings) GROUP BY role"))
def q_role_filter(spark, sf_dir):
    """Postings kept per role filter (plus 'any' = an unknown role, which
    keeps everything), evaluated in one scan."""
    from ..operators.filters import role_condition
    p = postings(spark, sf_dir)
    t = F.lower(F.concat_ws(" ", "title", "employer"))
    roles = F.array_compact(F.array(*[F.when(role_condition(t, name), F.lit(name)) for name in lx.ROLE_FILTERS], F.lit("any")))
    return p.select(F.explode(roles).alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ F2 ----
@register("fresh", with_postings(
    f"SELECT posting_id, posted_at FROM (SELECT posting_id, {_reldate_sql('posted_raw')} AS posted_at FROM postings)"
    f" WHERE posted_at IS NULL OR posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY"))
def q_fresh(spark, sf_dir):
    """Freshness: posted within 30 days before as_of, or undated."""
    from ..operators.filters import fresh
    p = postings(spark, sf_dir)
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    posted = X.relative_datetime(F.col("posted_raw"), as_of)
    return fresh(p.withColumn("posted_at", posted), F.col("posted_at"), as_of, 30).select("posting_id", "posted_at")


# ------------------------------------------------------------------ F3 ----
@register("with_salary", with_postings(
    "SELECT posting_id, pay_from, pay_to FROM postings WHERE coalesce(pay_from, 0) <> 0 OR coalesce(pay_to, 0) <> 0"))
def q_with_salary(spark, sf_dir):
    p = postings(spark, sf_dir)
    return p.where((F.coalesce("pay_from", F.lit(0.0)) != 0) | (F.coalesce("pay_to", F.lit(0.0)) != 0)).select(
        "posting_id", "pay_from", "pay_to")


# ------------------------------------------------------------------ F4 ----
SALARY_BAND = (40.0, 120.0)


@register("salary_band", with_postings(
    f"SELECT posting_id, salary_from_k, salary_to_k FROM postings WHERE coalesce(salary_from_k, salary_to_k) >= {SALARY_BAND[0]}"
    f" AND coalesce(salary_to_k, salary_from_k) <= {SALARY_BAND[1]}"))
def q_salary_band(spark, sf_dir):
    from ..operators.filters import salary_band
    return salary_band(postings(spark, sf_dir), *SALARY_BAND).select("posting_id", "salary_from_k", "salary_to_k")


# ------------------------------------------------------------------ E1 export chain --
@register("export_rows", with_postings(
    "SELECT posting_id, title, employer, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url,"
    " '^https?://(?:www\\.){2,}', 'https://www.'), '\\?.*$', ''), '^https?://avito\\.ru', 'https://www.avito.ru'),"
    " '^https?://m\\.avito\\.ru', 'https://www.avito.ru') AS url FROM dedup",
    "unrated AS (SELECT * FROM postings p WHERE NOT EXISTS (SELECT 1 FROM postings r WHERE r.seq.l_linenumber % 2 <> 0"
    " AND trim(r.url) <> '' AND trim(r.url) = trim(p.url)))", _DEDUP_CTE.replace("FROM postings", "FROM unrated")))
def q_export_rows(spark, sf_dir):
    """Export chain: role filter -> rate mentions -> drop shift-rated URLs
    -> keep-first dedup -> URL clean-up."""
    from ..operators.filters import role_filter
    from .q_text import rate_blob
    p = role_filter(postings(spark, sf_dir), "unknown-role")  # unknown role keeps all rows
    # only which URLs have a rate of which type is read: no clause is carried through the shuffle
    rates = X.rate_mentions(p.select("url", "seq", rate_blob(None).alias("text")), "url", "text", order="seq", columns=())
    kept = R.drop_shift_rated(p.select("posting_id", "seq", "title", "employer", "url"), rates)
    d = R.dedup_first(kept.withColumn("url", R.url_canon(F.col("url"))))
    return d.select("posting_id", "title", "employer", R.export_url(F.col("url")).alias("url"))
