"""Queries of the notice engine and their SQL.

Each entry is a function of (spark, sf_dir); ``SQL`` holds DuckDB's text of the same rows. Counts
are BIGINT, ties are broken by a unique column, and days are literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, dates, extract, reading, records, text, udfs
from ..functions import routes as R
from ..functions import wordlists as W
from ..operators import blocks, dedupe, dictionary, keys, lifecycle, links, merge, postings, projections, route, search, similarity, store, summary
from ..sources import adapters, connectors, dealt, scan, sitemap, table
from ..storage import shared_dir
from . import notices as N

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


# Links of pages.

ANCHORS_SQL = r"""
SELECT page_id, url AS page_url, i - 1 AS pos,
  list_extract(hrefs, i) AS href,
  trim(regexp_replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(list_extract(bodies, i), '<[^>]*>', ' ', 'gs'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS title
FROM (
  SELECT page_id, url,
    regexp_extract_all(plain, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS hrefs,
    regexp_extract_all(plain, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2) AS bodies
  FROM (SELECT page_id, url, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g') AS plain FROM pages)
), unnest(range(1, len(hrefs) + 1)) AS u(i)
"""
RESOLVE_SQL = r"""
SELECT page_id, pos, title, page_url, nullif(rtrim(split_part(CASE
    WHEN href = '' THEN ''
    WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href
    WHEN starts_with(href, '//') THEN regexp_extract(page_url, '^([a-z]+:)', 1) || href
    WHEN starts_with(href, '/') THEN regexp_extract(page_url, '^([a-z]+://[^/?#]+)', 1) || href
    ELSE regexp_replace(regexp_extract(page_url, '^([a-z]+://[^/?#]+(?:/[^?#]*)?)', 1), '(://[^/]+(?:/.*)?)/[^/]*$', '\1') || '/' || href
  END, '#', 1), '/'), '') AS link
FROM (SELECT page_id, pos, title, page_url, trim(href) AS href FROM (""" + ANCHORS_SQL + """))"""


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url"), "html")
    return links.anchors(pages)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _anchors(spark, sf_dir)
    return rows.select("page_id", "pos", "title", "page_url", links.resolve(F.col("page_url"), F.col("href")).alias("link"))


@query("q_anchor_extract", "SELECT page_id, CAST(pos AS BIGINT) AS pos, href, title FROM (" + ANCHORS_SQL + ")")
def anchor_extract(spark, sf_dir):
    """Links of all pages with their texts."""
    return _anchors(spark, sf_dir).select("page_id", F.col("pos").cast("bigint").alias("pos"), "href", "title")


@query("q_anchor_labels", "SELECT regexp_extract(page_url, '^[a-z]+://([^/?#]+)', 1) AS host, lower(title) AS label, count(*) AS n, count(DISTINCT link) AS links FROM (" + RESOLVE_SQL + ") GROUP BY 1, 2")
def anchor_labels(spark, sf_dir):
    """Flagship: link labels of each host with their counts and distinct addresses."""
    rows = _links(spark, sf_dir).select(text.host("page_url").alias("host"), F.lower("title").alias("label"), "link")
    return rows.groupBy("host", "label").agg(F.count("*").alias("n"), F.countDistinct("link").alias("links"))


@query("q_anchor_dedupe", """
SELECT title, link, page_id, CAST(pos AS BIGINT) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(title), lower(link) ORDER BY page_id, pos) AS r FROM (""" + RESOLVE_SQL + """) WHERE link IS NOT NULL AND title <> ''
) WHERE r = 1""")
def anchor_dedupe(spark, sf_dir):
    """First link of each title and address, whatever the case."""
    rows = _links(spark, sf_dir).where("link IS NOT NULL AND title <> ''").withColumn("ord", F.struct("page_id", "pos"))
    return dedupe.first_per_key(rows, keys.title_url("title", "link")).select("title", "link", "page_id", F.col("pos").cast("bigint").alias("pos"))


SCORE_SQL = " + ".join(f"CASE WHEN contains(lower(title || ' ' || link), {N.quoted(k)}) THEN 10 ELSE 0 END" for k in W.LINK_KEYWORDS) + " + CASE WHEN ends_with(link, '.pdf') THEN 5 ELSE 0 END"


@query("q_link_score", f"SELECT page_id, CAST(pos AS BIGINT) AS pos, link, CAST({SCORE_SQL} AS INT) AS score FROM ({RESOLVE_SQL}) WHERE link IS NOT NULL")
def link_score(spark, sf_dir):
    """Keyword score of every link."""
    rows = _links(spark, sf_dir).where("link IS NOT NULL")
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"), "link", links.link_score("title", "link").cast("int").alias("score"))


ACTION = ("the", "and", "of")
ACTION_SQL = " + ".join(f"CASE WHEN contains(lower(title || ' ' || link), '{k}') THEN 10 ELSE 0 END" for k in ACTION) + " + CASE WHEN ends_with(lower(link), '.pdf') THEN -2 ELSE 0 END"


@query("q_best_link", f"""
SELECT page_id, link AS url, title, CAST(score AS INT) AS score, CAST(pos AS BIGINT) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS r FROM (SELECT *, {ACTION_SQL} AS score FROM ({RESOLVE_SQL}) WHERE link IS NOT NULL) WHERE score > 0
) WHERE r = 1""")
def best_link(spark, sf_dir):
    """Best action link of each page, for keywords that the synthetic links have."""
    rows = _links(spark, sf_dir).where("link IS NOT NULL").withColumnRenamed("link", "url")
    best = links.best_link(rows, "page_id", links.action_score("title", "url", ACTION))
    return best.select("page_id", "url", "title", F.col("score").cast("int").alias("score"), F.col("pos").cast("bigint").alias("pos"))


@query("q_page_text", r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(coalesce(nullif(regexp_extract(bare, '(?is)<article\b[^>]*>(.*?)</article>', 1), ''), nullif(regexp_extract(bare, '(?is)<main\b[^>]*>(.*?)</main>', 1), ''),
    nullif(regexp_extract(bare, '(?is)<div\b[^>]*class\s*=\s*["''][^"'']*(?:content|entry|post)[^"'']*["''][^>]*>(.*?)</div>', 1), ''),
    nullif(regexp_extract(bare, '(?is)<body\b[^>]*>(.*?)</body>', 1), ''), bare), '<[^>]*>', ' ', 'gs'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS body
FROM (SELECT page_id, regexp_replace(html, '(?is)""" + "|".join(rf"<{t}\b.*?</{t}>" for t in "script style header footer nav aside noscript form".split()) + r"""|<!--.*?-->', ' ', 'g') AS bare FROM pages)""")
def page_text(spark, sf_dir):
    """Visible text of every page."""
    return table(spark, sf_dir, "pages").select("page_id", links.page_text("html").alias("body"))


@query("q_url_filter", f"SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), '^https?://') AND NOT {N.any_of('lower(url)', W.BAD_DOMAINS)} AND NOT {N.any_of('lower(url)', W.BAD_URL_PARTS)}")
def url_filter(spark, sf_dir):
    """Pages whose address passes the filter."""
    return table(spark, sf_dir, "pages").where(~classify.is_bad_url("url")).select("page_id", "url")


@query("q_url_clean", r"SELECT page_id, rtrim(split_part(trim(url), '#', 1), '/') AS clean, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1) AS host FROM pages")
def url_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_url("url").alias("clean"), text.host("url").alias("host"))


@query("q_dup_urls", r"""
SELECT page_id, host FROM (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS r
  FROM (SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1) AS host FROM pages)) WHERE r > 1""")
def dup_urls(spark, sf_dir):
    """Every page after the first of its host."""
    rows = table(spark, sf_dir, "pages").select("page_id", text.host("url").alias("host"))
    return dedupe.repeats(rows, "host", ord="page_id")


@query("q_sitemap_urls", r"SELECT DISTINCT rtrim(split_part(trim(url), '#', 1), '/') AS url, '<url><loc>' || replace(rtrim(split_part(trim(url), '#', 1), '/'), '&', '&amp;') || '</loc></url>' AS entry FROM pages")
def sitemap_urls(spark, sf_dir):
    return sitemap(table(spark, sf_dir, "pages").select(text.clean_url("url").alias("url")))


@query("q_html_valid", r"SELECT page_id, regexp_matches(html, '(?i)<html\b') AND regexp_matches(html, '(?i)<body\b') AS valid, CAST(length(html) AS BIGINT) AS size FROM pages")
def html_valid(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", links.is_html("html").alias("valid"), F.length("html").cast("bigint").alias("size"))


# Identity and classification.

@query("q_job_id", f"""
SELECT ord, md5(regexp_replace({N.clean_sql('title')}, '[^a-z0-9 ]', '', 'g') || '|' || regexp_replace({N.clean_sql('url')}, '[^a-z0-9 ]', '', 'g')) AS job_id,
  sha256(lower(url) || '|||' || lower(title) || '|') AS processed
FROM ({N.SQL})""")
def job_id(spark, sf_dir):
    """Merge key and processed-set key of every notice."""
    rows = N.notices(spark, sf_dir)
    return rows.select("ord", keys.job_id("title", "url").alias("job_id"), keys.processed(["url", "title"]).alias("processed"))


YEAR_SQL = r"regexp_matches(t, '\b20\d{2}\b')"
SPECIFIC_SQL = r"(regexp_matches(t, '\b(?:post|posts|vacanc(?:y|ies)|advt?\.?\s*no\.?|notification\s*no\.?|no\.\s*\d{1,5})\b') OR " + f"{N.any_of('t', W.ROLE_TERMS)} OR {YEAR_SQL} OR {N.any_of('t', W.SPECIFIC_PHRASES)})"
CLASSIFY_SQL = f"""CASE
  WHEN length(t) < 8 OR NOT regexp_matches(u, '^https?://') OR {N.any_of('u', W.BAD_DOMAINS)} OR {N.any_of('u', W.BAD_URL_PARTS)} OR {N.one_of('t', W.BAD_EXACT_TITLES)} OR {N.any_of('t', W.BAD_PHRASES)} THEN NULL
  WHEN {N.any_of('t', W.ADMIT_TERMS)} AND {SPECIFIC_SQL} THEN 'Admit Card'
  WHEN {N.any_of('t', W.ANSWER_TERMS)} AND {SPECIFIC_SQL} THEN 'Answer Key'
  WHEN {N.any_of('t', W.RESULT_TERMS)} AND t NOT IN ('result', 'results', 'old result', 'old results', 'latest result') AND NOT {N.any_of('t', W.NOT_A_RESULT)} AND ({YEAR_SQL} OR {N.any_of('t', W.SPECIFIC_RESULT_PHRASES)}) THEN 'Result'
  WHEN {N.any_of('t', W.SYLLABUS_TERMS)} AND {SPECIFIC_SQL} THEN 'Syllabus'
  WHEN {N.any_of('t', W.SCHOLARSHIP_TERMS)} AND {SPECIFIC_SQL} THEN 'Scholarship'
  WHEN {N.any_of('t', W.RECRUITMENT_TERMS)} AND ({N.any_of('t', W.ROLE_TERMS)} OR regexp_matches(t, '\\b(?:post|posts|vacanc(?:y|ies))\\b') OR {N.any_of('t', W.CONCRETE_PHRASES)}) AND NOT {N.any_of('t', W.NOT_A_JOB)} THEN 'Recruitment'
  WHEN {N.any_of('t', W.ROLE_TERMS)} AND {N.any_of('u', W.GOOD_URL_PARTS)} AND ({N.any_of('d', W.RECRUITMENT_TERMS)} OR {N.any_of('t', W.RESCUE_PHRASES)}) THEN 'Recruitment'
  WHEN t NOT IN ('exam', 'examination', 'today''s exam', 'todays exam') AND ({N.any_of('t', W.EXAM_TERMS)} OR (regexp_matches(t, '\\b(?:exam|examination)\\b') AND {YEAR_SQL})) THEN 'Exam'
END"""
TUD_SQL = f"SELECT *, {N.clean_sql('title')} AS t, {N.clean_sql('url')} AS u, {N.clean_sql('description')} AS d FROM ({N.SQL})"


@query("q_classify", f"SELECT ord, title, {CLASSIFY_SQL} AS kind FROM ({TUD_SQL})")
def classify_notices(spark, sf_dir):
    """Kind of every notice, null for the rejected."""
    return N.notices(spark, sf_dir).select("ord", "title", classify.classify_post("title", "url", "description").alias("kind"))


@query("q_kind_counts", f"SELECT coalesce({CLASSIFY_SQL}, 'rejected') AS kind, count(*) AS n FROM ({TUD_SQL}) GROUP BY 1")
def kind_counts(spark, sf_dir):
    kind = F.coalesce(classify.classify_post("title", "url", "description"), F.lit("rejected"))
    return N.notices(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("q_post_type", f"""
SELECT ord, CASE WHEN {N.any_of('t', W.TYPE_ADMIT)} THEN 'admit-card' WHEN {N.any_of('t', W.TYPE_ANSWER)} THEN 'answer-key'
  WHEN regexp_matches(t, '\\b(result|merit list|score ?card|final result)\\b') THEN 'result' WHEN {N.any_of('t', W.TYPE_SYLLABUS)} THEN 'syllabus'
  WHEN {N.any_of('t', W.TYPE_SCHOLARSHIP)} THEN 'scholarship' WHEN {N.any_of('t', W.TYPE_RECRUITMENT)} THEN 'recruitment'
  WHEN c IN ('admit card', 'admit-card') THEN 'admit-card' WHEN c IN ('answer key', 'answer-key') THEN 'answer-key' WHEN c IN ('result', 'results') THEN 'result'
  WHEN c IN ('syllabus', 'scholarship') THEN c WHEN c IN ('recruitment', 'latest jobs', 'latest job', 'jobs', 'job') THEN 'recruitment' ELSE 'other' END AS post_type
FROM (SELECT ord, {N.clean_sql('title')} AS t, {N.clean_sql('category')} AS c FROM ({N.SQL}))""")
def post_type(spark, sf_dir):
    return N.notices(spark, sf_dir).select("ord", classify.post_type("title", "category").alias("post_type"))


def _department_sql() -> str:
    tests = [f"WHEN s = {N.quoted(k)} THEN {N.quoted(v)}" for k, v in W.SOURCE_DEPARTMENTS.items()]
    tests += [f"WHEN {N.whole_word('b', words)} THEN {N.quoted(label)}" for rules in (W.ORGANISATION_RULES, W.DEPARTMENT_RULES) for label, words in rules.items()]
    return "CASE " + " ".join(tests) + f" WHEN e <> '' AND NOT {N.one_of('lower(e)', W.GENERIC_DEPARTMENTS)} THEN e ELSE '' END"


@query("q_department", f"SELECT ord, {_department_sql()} AS department FROM (SELECT ord, lower(trim(source)) AS s, lower(title || ' ' || description || ' ' || url) AS b, trim(category) AS e FROM ({N.SQL}))")
def department(spark, sf_dir):
    """Department rules; the raw category stands in for an existing department."""
    body = F.concat_ws(" ", "title", "description", "url")
    return N.notices(spark, sf_dir).select("ord", classify.department("source", body, "category").alias("department"))


@query("q_home_category", f"""
SELECT ord, CASE WHEN {N.any_of('b', W.HOME_UK)} THEN 'Uttarakhand Jobs' WHEN {N.any_of('b', W.HOME_RAILWAY)} THEN 'Railway Jobs' WHEN {N.any_of('b', W.HOME_BANKING)} THEN 'Banking Jobs'
  WHEN {N.one_of('lower(g)', W.HOME_EXPLICIT)} THEN g WHEN contains(n, 'admit card') OR contains(n, 'admit-card') OR contains(n, 'hall ticket') THEN 'Admit Card'
  WHEN contains(n, 'answer key') OR contains(n, 'answer-key') THEN 'Answer Key' WHEN contains(n, 'result') THEN 'Result' WHEN contains(n, 'scholarship') THEN 'Scholarship'
  WHEN contains(n, 'syllabus') THEN 'Syllabus' ELSE g END AS category
FROM (SELECT ord, lower(title || ' ' || description || ' ' || url || ' ' || source) AS b, lower(title || ' ' || description) AS n, CASE WHEN category = '' THEN 'Latest Jobs' ELSE category END AS g FROM ({N.SQL}))""")
def home_category(spark, sf_dir):
    body, narrow = F.concat_ws(" ", "title", "description", "url", "source"), F.concat_ws(" ", "title", "description")
    return N.notices(spark, sf_dir).select("ord", classify.home_category("category", body, narrow).alias("category"))


@query("q_noise", f"SELECT ord, title FROM ({N.SQL}) WHERE trim(title) = '' OR regexp_matches(lower(trim(title)), '{W.NOISE_PATTERN}') OR {N.one_of('lower(trim(title))', W.NOISE_TITLES)}")
def noise(spark, sf_dir):
    return N.notices(spark, sf_dir).where(classify.is_noise("title")).select("ord", "title")


@query("q_publishable", f"""
SELECT ord, CASE WHEN length(t) < 20 OR NOT regexp_matches(lower(url), '^https?:') THEN false WHEN {N.any_of('t', W.GATE_BLOCKED)} THEN false
  WHEN NOT (contains(lower(category), 'recruit') OR {N.any_of('t', W.GATE_RECRUITMENT)}) THEN true ELSE {N.any_of('t', W.GATE_RECRUITMENT)} END AS publishable
FROM (SELECT *, {N.clean_sql('title')} AS t FROM ({N.SQL}))""")
def publishable(spark, sf_dir):
    """Publication gate of notices that no model wrote."""
    row = {k: F.col(k) for k in ("title", "url", "category", "description")}
    return N.notices(spark, sf_dir).select("ord", classify.is_publishable(row).alias("publishable"))


# Routing.

def _route_sql() -> str:
    first = lambda pages, col: "CASE " + " ".join(f"WHEN {N.signals(col, v)} THEN '{k}'" for k, v in pages.items()) + " END"
    body = "lower(title || ' ' || description || ' ' || url || ' ' || source)"
    for domain, more in R.DOMAIN_SIGNALS.items():
        body = f"({body} || CASE WHEN contains(lower(url), '{domain}') THEN ' {more}' ELSE '' END)"
    mapped = "CASE raw " + " ".join(f"WHEN {N.quoted(k)} THEN '{v}'" for k, v in R.RAW_CATEGORY.items()) + " END"
    kind = f"""CASE WHEN {N.any_of('title_l', R.EXPLICIT_TYPES['admit-card'])} THEN 'admit-card' WHEN {N.any_of('title_l', R.EXPLICIT_TYPES['answer-key'])} THEN 'answer-key'
      WHEN regexp_matches(title_l, '\\b(result|merit list|score ?card)\\b') THEN 'result' WHEN {N.any_of('title_l', R.EXPLICIT_TYPES['syllabus'])} THEN 'syllabus'
      WHEN {N.any_of('title_l', R.EXPLICIT_TYPES['scholarship'])} THEN 'scholarship' WHEN {N.any_of('title_l', R.EXPLICIT_TYPES['recruitment'])} THEN 'recruitment' END"""
    typed = "[" + ", ".join(f"'{p}'" for p in R.TYPED) + "]"
    direct = []
    for page, terms in R.CONTENT.items():
        test = N.signals("banking" if page == "banking" else "prim", terms)
        test += " AND NOT (uk OR psc)" if page in ("ssc", "upsc") else ""
        test += " AND upsc" if page == "upsc" else ""
        test += f" AND (kind IS NULL OR kind = '{page}')" if page in R.TYPED else ""
        direct.append(f"CASE WHEN {test} THEN ['{page}'] ELSE [] END")
    all_terms = R.CONTENT | R.FALLBACK
    last = "CASE " + " ".join(f"WHEN {N.signals('banking' if p == 'banking' else 'prim', all_terms[p])}{' AND upsc AND NOT psc' if p == 'upsc' else ''} THEN '{p}'" for p in R.FALLBACK_ORDER) + " END"
    content = "[" + ", ".join(f"'{p}'" for p in R.CONTENT_PAGES) + "]"
    return f"""
WITH a AS (SELECT ord, lower(trim(category)) AS raw, lower(trim(title)) AS title_l, {body} AS body,
    lower(title || ' ' || description || ' ' || source) AS banking, lower(title || ' ' || description) AS prim,
    lower(title || ' ' || description || ' ' || source || ' ' || url) AS ident FROM ({N.SQL})),
b AS (SELECT *, {N.any_of('ident', R.STATE_PSC)} AS psc, regexp_matches(ident, '\\bupsc\\b') OR contains(ident, 'union public service commission') AS upsc,
    {N.signals('body', R.UK)} AS uk, {N.signals('body', R.CENTRAL)} AS cen, {first(R.UK_PAGES, 'body')} AS uk_page, {first(R.STATE_PAGES, 'body')} AS st_page, {mapped} AS mapped, {kind} AS kind FROM a),
c AS (SELECT *, list_concat(CASE WHEN uk THEN ['uttarakhand-jobs', uk_page] WHEN cen AND NOT psc THEN ['central-government-jobs']
      WHEN st_page IS NOT NULL THEN ['other-state-jobs', st_page] WHEN raw IN ('other state jobs', 'other state job') THEN ['other-state-jobs'] ELSE [] END,
    CASE WHEN mapped IS NULL OR ((uk OR psc) AND mapped IN ('ssc', 'upsc', 'central-government-jobs')) OR (mapped = 'upsc' AND NOT upsc) THEN [] ELSE [mapped] END) AS p1 FROM b),
d AS (SELECT *, CASE WHEN kind = 'recruitment' THEN list_filter(list_concat(p1, ['latest-jobs']), lambda x: NOT coalesce(list_contains({typed}, x), false))
      WHEN kind IS NOT NULL THEN list_filter(list_concat(p1, [kind]), lambda x: x = kind OR NOT coalesce(list_contains(list_concat({typed}, ['latest-jobs']), x), false)) ELSE p1 END AS p2 FROM c),
e AS (SELECT *, list_filter(list_concat(p2, {', '.join(direct)}), lambda x: x IS NOT NULL) AS p3 FROM d),
f AS (SELECT *, CASE WHEN list_has_any(p3, {content}) THEN p3 ELSE list_filter(list_concat(p3, [{last}]), lambda x: x IS NOT NULL) END AS p4 FROM e)
SELECT ord, array_to_string(list_sort(list_distinct(CASE WHEN len(p4) = 0 THEN ['latest-jobs'] ELSE p4 END)), ',') AS pages FROM f"""


@query("q_multi_label_route", _route_sql())
def multi_label_route(spark, sf_dir):
    """Pages of every notice, in alphabetical order."""
    return route.route(N.notices(spark, sf_dir)).select("ord", F.array_join(F.array_sort("pages"), ",").alias("pages"))


@query("q_page_counts", f"SELECT page, count(*) AS n FROM (SELECT unnest(string_split(pages, ',')) AS page FROM ({_route_sql()})) GROUP BY ROLLUP (page)")
def page_counts(spark, sf_dir):
    return summary.page_counts(route.route(N.notices(spark, sf_dir)))


@query("q_category_top50", f"""
SELECT page, ord, CAST(r AS INT) AS rank FROM (SELECT page, ord, row_number() OVER (PARTITION BY page ORDER BY size DESC, ord) AS r
  FROM (SELECT unnest(string_split(pages, ',')) AS page, ord, size FROM ({_route_sql()}) JOIN (SELECT ord, size FROM ({N.SQL})) USING (ord))) WHERE r <= 50""")
def category_top50(spark, sf_dir):
    """The fifty largest notices of each page."""
    rows = route.route(N.notices(spark, sf_dir)).select(F.explode_outer("pages").alias("page"), "ord", "size")
    return dedupe.top_per_group(rows, "page", [F.desc("size"), F.col("ord")], 50).select("page", "ord", "rank")


# Merging batches.

BATCH_OLD = "SELECT o_orderkey AS job_id, 'Order ' || o_orderkey AS title, o_orderstatus AS category, CASE WHEN o_orderkey % 5 = 0 THEN 'not mentioned' ELSE o_orderpriority END AS vacancy, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%d-%m-%Y') END AS last_date, 'https://a.example/' || o_orderkey AS apply_link FROM orders WHERE o_orderkey % 3 <> 0"
BATCH_NEW = "SELECT o_orderkey AS job_id, 'Order ' || o_orderkey AS title, o_orderstatus AS category, CASE WHEN o_orderkey % 4 = 0 THEN 'N/A' WHEN o_orderkey % 11 = 0 THEN '7' ELSE o_orderpriority END AS vacancy, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE strftime(o_orderdate, '%d-%m-%Y') END AS last_date, CASE WHEN o_orderkey % 13 = 0 THEN 'javascript:void(0)' ELSE 'https://a.example/' || o_orderkey END AS apply_link FROM orders WHERE o_orderkey % 3 <> 1"
FIELDS = ("title", "category", "vacancy", "last_date", "apply_link")


def _batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.date_format("o_orderdate", "dd-MM-yyyy")
    link = F.concat(F.lit("https://a.example/"), k)

    def batch(rows, vacancy, last, apply):
        return rows.select(k.alias("job_id"), F.concat(F.lit("Order "), k).alias("title"), F.col("o_orderstatus").alias("category"), vacancy.alias("vacancy"), last.alias("last_date"), apply.alias("apply_link"))

    old = batch(orders.where(k % 3 != 0), F.when(k % 5 == 0, "not mentioned").otherwise(F.col("o_orderpriority")), F.when(k % 7 == 0, "").otherwise(day), link)
    new = batch(
        orders.where(k % 3 != 1),
        F.when(k % 4 == 0, "N/A").when(k % 11 == 0, "7").otherwise(F.col("o_orderpriority")),
        F.when(k % 2 == 0, "").otherwise(day),
        F.when(k % 13 == 0, "javascript:void(0)").otherwise(link),
    )
    return old, new


def _merge_sql() -> str:
    holes = N.one_of("lower(trim(%s))", W.PLACEHOLDERS)
    pick = lambda k: f"CASE WHEN NOT {holes % ('n.' + k)} THEN n.{k} WHEN NOT {holes % ('o.' + k)} THEN o.{k} ELSE coalesce(n.{k}, o.{k}) END"
    return f"""
WITH o AS ({BATCH_OLD}), n AS ({BATCH_NEW}),
j AS (SELECT o.job_id AS oid, n.job_id AS nid, coalesce(n.title, o.title) AS title, coalesce(n.category, o.category) AS category, {pick('vacancy')} AS vacancy, {pick('last_date')} AS last_date,
    CASE WHEN starts_with(lower({pick('apply_link')}), 'javascript:') THEN '' ELSE {pick('apply_link')} END AS apply_link,
    o.title AS ot, o.category AS oc, o.vacancy AS ov, o.last_date AS ol, o.apply_link AS oa, n.title AS nt, n.category AS nc, n.vacancy AS nv, n.last_date AS nl, n.apply_link AS na
  FROM o FULL JOIN n ON o.job_id = n.job_id),
s AS (SELECT *, CASE WHEN oid IS NULL THEN 'added' WHEN nid IS NULL OR (title = ot AND category = oc AND vacancy = ov AND last_date = ol AND apply_link = oa) THEN 'kept' ELSE 'updated' END AS change FROM j)
SELECT coalesce(oid, nid) AS job_id, CASE change WHEN 'added' THEN nt WHEN 'kept' THEN ot ELSE title END AS title, CASE change WHEN 'added' THEN nc WHEN 'kept' THEN oc ELSE category END AS category,
  CASE change WHEN 'added' THEN nv WHEN 'kept' THEN ov ELSE vacancy END AS vacancy, CASE change WHEN 'added' THEN nl WHEN 'kept' THEN ol ELSE last_date END AS last_date,
  CASE change WHEN 'added' THEN na WHEN 'kept' THEN oa ELSE apply_link END AS apply_link, change FROM s"""


@query("q_merge_upsert", _merge_sql())
def merge_upsert(spark, sf_dir):
    """Merge of two overlapping batches of orders, with placeholders and pseudo-links."""
    return merge.upsert(*_batches(spark, sf_dir), "job_id", FIELDS)


@query("q_changed_rows", f"""
WITH o AS ({BATCH_OLD}), n AS ({BATCH_NEW})
SELECT n.* FROM n LEFT JOIN o ON o.job_id = n.job_id WHERE o.job_id IS NULL OR """ + " OR ".join(f"coalesce(o.{k}, '') <> coalesce(n.{k}, '')" for k in FIELDS))
def changed_rows(spark, sf_dir):
    return merge.new_or_changed(*_batches(spark, sf_dir), "job_id", FIELDS)


@query("q_new_only", "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
def new_only(spark, sf_dir):
    """Customers without a large order."""
    known = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return merge.new_only(table(spark, sf_dir, "customer"), known, "c_custkey").select("c_custkey", "c_name")


@query("q_processed_anti", "SELECT c_custkey, sha256('|||' || lower(c_name) || '|') AS key FROM customer WHERE sha256('|||' || lower(c_name) || '|') NOT IN (SELECT sha256('|||' || lower(c_name) || '|') FROM customer WHERE c_custkey % 3 = 0)")
def processed_anti(spark, sf_dir):
    """Customers whose hash is not in the processed set."""
    rows = table(spark, sf_dir, "customer").withColumn("title", F.col("c_name")).withColumn("key", keys.processed(["title"]))
    return merge.new_only(rows, rows.where("c_custkey % 3 = 0"), "key").select("c_custkey", "key")


@query("q_semi_existing", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def semi_existing(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return merge.existing(table(spark, sf_dir, "part").select("p_partkey", "p_name"), have, "p_partkey")


@query("q_stale_slugs", "SELECT DISTINCT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def stale_slugs(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return merge.stale(table(spark, sf_dir, "part"), have, "p_partkey")


@query("q_best_per_key", """
SELECT l_partkey, l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def best_per_key(spark, sf_dir):
    """The largest line of each part, the first of equals."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    rows = rows.withColumn("ord", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return dedupe.best_per_key(rows, "l_partkey", by="l_quantity").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")


@query("q_union_distinct", "SELECT DISTINCT n_name AS name FROM (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT c_mktsegment FROM customer)")
def union_distinct(spark, sf_dir):
    """Union of three relations, first of each key."""
    names = [table(spark, sf_dir, t).select(F.col(c).alias("name")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment"))]
    return names[0].unionByName(names[1]).unionByName(names[2]).distinct()


@query("q_sort_latest", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey) AS place FROM orders")
def sort_latest(spark, sf_dir):
    """The place of every order by price, date and key."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    ranked = dedupe.rank_decay(orders, [F.desc("o_totalprice"), F.desc("o_orderdate"), F.col("o_orderkey")])
    return ranked.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("rank").alias("place"))


@query("q_top50_per_category", """
SELECT p_type, l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber, CAST(r AS INT) AS rank FROM (SELECT p_type, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY p_type ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r
  FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE r <= 50""")
def top50_per_category(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select("p_type", "l_orderkey", "l_linenumber", "l_extendedprice")
    top = dedupe.top_per_group(rows, "p_type", [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 50)
    return top.select("p_type", "l_orderkey", "l_linenumber", "rank")


CAPS = {"1-URGENT": 24, "2-HIGH": 12, "3-MEDIUM": 15, "5-LOW": 10}


@query("q_section_caps", f"""
SELECT o_orderpriority, o_orderkey, CAST(r AS INT) AS rank FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders)
WHERE r <= CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN {v}" for k, v in CAPS.items())} ELSE 0 END""")
def section_caps(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_orderdate")
    return dedupe.capped_sections(rows, "o_orderpriority", CAPS, [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_orderpriority", "o_orderkey", "rank")


@query("q_rank_decay", "SELECT p_partkey, r AS rank, greatest(100 - 2 * (r - 1), 1) AS score FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part)")
def rank_decay(spark, sf_dir):
    """Rank and falling score of every part by price."""
    ranked = dedupe.rank_decay(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")])
    return ranked.select("p_partkey", "rank", "score")


# Counts.

@query("q_summary_grouping_sets", """
SELECT CASE WHEN grouping(c) = 0 THEN 'category' WHEN grouping(d) = 0 THEN 'department' ELSE 'total' END AS kind, coalesce(c, d, '') AS value, count(*) AS n
FROM (SELECT c_mktsegment AS c, n_name AS d FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY GROUPING SETS ((c), (d), ())""")
def summary_grouping_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return summary.counts(rows, "c_mktsegment", "n_name")


@query("q_category_rollup", """
SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def category_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("q_conditional_counts", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS valid, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS stale, count(*) AS total FROM orders")
def conditional_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return summary.conditional(rows, valid=F.col("o_orderstatus") == "F", stale=F.col("o_orderdate") < "1998-01-01", total=F.lit(True))


@query("q_index_health", "SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(html, '') = '') AS no_title, count(*) FILTER (WHERE NOT regexp_matches(coalesce(url, ''), '^https?://')) AS bad_url, count(url) - count(DISTINCT url) AS repeated_urls FROM pages")
def index_health(spark, sf_dir):
    return summary.index_health(table(spark, sf_dir, "pages").select(F.col("html").alias("title"), "url"))


@query("q_language_counts", "SELECT 'hi' AS script, lang, count(*) AS n FROM documents GROUP BY lang")
def language_counts(spark, sf_dir):
    """Script of the text by language column; the driver's texts have no Indic script."""
    rows = table(spark, sf_dir, "documents")
    return rows.groupBy(text.language("text").alias("script"), "lang").agg(F.count("*").alias("n"))


@query("q_script_ratio", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z\x{0900}-\x{097F}]{2,}')) AS BIGINT) AS words, length(text) >= 80 AS long_enough FROM documents")
def script_ratio(spark, sf_dir):
    """Counts behind the text quality score."""
    words = F.size(F.regexp_extract_all("text", F.lit(r"[A-Za-zऀ-ॿ]{2,}"), 0)).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("words"), (text.text_quality("text") > 0).alias("long_enough"))


@query("q_garble", r"""
SELECT doc_id, hits >= 2 AND hits / greatest(1, length(text)) > 0.015 OR text = '' AS garbled FROM (SELECT doc_id, text, len(regexp_extract_all(text, 'à¤|Ã|Â|â€|ðŸ')) AS hits FROM documents)""")
def garble(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.is_garbled("text").alias("garbled"))


@query("q_line_counts")
def line_counts(spark, sf_dir):
    """Lines that the text cleaner keeps, by document; a brute-force version is in the tests."""
    lines = text.clean_lines("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("bigint").alias("n"), F.sha1(F.array_join(lines, "\n")).alias("digest"))


# Dates.

MIXED_SQL = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%d %B %Y') ELSE '31-02-1999' END AS d, CAST(o_orderdate AS DATE) AS day FROM orders"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    shown = F.when(k == 0, F.date_format(d, "dd-MM-yyyy")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.when(k == 3, F.date_format(d, "dd MMMM yyyy")).otherwise("31-02-1999").alias("d"), F.to_date(d).alias("day"))


@query("q_date_parse_mixed", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(day, '%Y-%m-%d') END AS strict, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(day, '%Y-%m-%d') END AS anywhere,
  CASE WHEN o_orderkey % 5 IN (2, 4) THEN NULL ELSE strftime(day, '%Y-%m-%d') END AS adapter, CASE WHEN o_orderkey % 5 >= 3 OR year(day) < 2000 THEN NULL ELSE strftime(day, '%Y-%m-%d') END AS anchored,
  CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE strftime(day, '%d-%m-%Y') END AS display FROM ({MIXED_SQL})""")
def date_parse_mixed(spark, sf_dir):
    """All date readers over five written forms, one of them no date."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    return _mixed(spark, sf_dir).select(
        "o_orderkey", iso(dates.strict("d")).alias("strict"), iso(dates.anywhere("d")).alias("anywhere"), iso(dates.adapter("d")).alias("adapter"),
        iso(dates.anchored("d")).alias("anchored"), dates.display("d").alias("display"),
    )


@query("q_expired", f"SELECT o_orderkey, o_orderkey % 5 <> 4 AND day < DATE '1998-06-01' AS expired FROM ({MIXED_SQL})")
def expired(spark, sf_dir):
    return _mixed(spark, sf_dir).select("o_orderkey", dates.is_expired(dates.strict("d"), "1998-06-01").alias("expired"))


@query("q_deadline_status", f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 AND year(day) >= 2000 AND day < DATE '2000-07-01' THEN 'Application Closed' ELSE 'Active' END AS status FROM ({MIXED_SQL})")
def deadline_status(spark, sf_dir):
    rows = _mixed(spark, sf_dir).withColumnRenamed("d", "last_date")
    return lifecycle.with_status(rows, "2000-07-01").select("o_orderkey", "status")


@query("q_freshness", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN day >= DATE '1998-06-01' ELSE day >= DATE '1998-06-01' - 120 END AS fresh FROM ({MIXED_SQL})""")
def freshness(spark, sf_dir):
    """Deadline where readable, else publication within 120 days."""
    none = F.lit(None).cast("date")
    rows = _mixed(spark, sf_dir)
    return rows.select("o_orderkey", dates.is_fresh(dates.strict("d"), F.lit(""), none, F.col("day"), "1998-06-01").alias("fresh"))


@query("q_lifecycle_split", """
SELECT CASE WHEN o_totalprice < 50000 THEN 'hidden' WHEN o_orderdate < TIMESTAMP '1998-06-01' THEN 'archive' ELSE 'live' END AS part, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1""")
def lifecycle_split(spark, sf_dir):
    """Sizes of the three complementary parts."""
    rows = table(spark, sf_dir, "orders")
    parts = lifecycle.split(rows, F.col("o_orderdate") < "1998-06-01", F.col("o_totalprice") >= 50000)
    named = [p.select(F.lit(n).alias("part"), "o_orderkey") for n, p in zip(("live", "hidden", "archive"), parts)]
    return named[0].unionByName(named[1]).unionByName(named[2]).groupBy("part").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("q_candidate_rank", f"""
SELECT ord, CAST({' + '.join(f"CASE WHEN contains(lower(title), {N.quoted(p)}) THEN 4 ELSE 0 END" for p in W.RANK_PHRASES)} + CASE WHEN ends_with(url, '.pdf') THEN 2 ELSE 0 END AS INT) AS score FROM ({N.SQL})""")
def candidate_rank(spark, sf_dir):
    pdf = F.when(F.col("url").endswith(".pdf"), F.col("url")).otherwise("")
    return N.notices(spark, sf_dir).select("ord", lifecycle.rank_score("title", pdf, F.lit(""), F.lit("")).cast("int").alias("score"))


@query("q_extract_details", """
SELECT o_orderkey, CAST(o_orderkey % 30 + 20 AS VARCHAR) AS vacancy, 'Bachelor degree in science.' AS qualification, 'Rs ' || (o_orderkey * 10 + 1000) || ' - 90000' AS salary,
  '18 to ' || (o_orderkey % 30 + 20) || ' years' AS age_limit, 'Rs 100' AS application_fee, 'Written test' AS selection_process, strftime(o_orderdate, '%d-%m-%Y') AS last_date,
  '' AS application_start_date, '' AS exam_date FROM orders""")
def extract_details(spark, sf_dir):
    """Labelled facts from synthetic notice bodies built from orders.

    The vacancy is the last plain number within 180 characters of the total, here the age: a number
    before a full stop is not plain.
    """
    k = F.col("o_orderkey")
    body = F.concat(
        F.lit("Total posts: "), (k % 900 + 1).cast("string"), F.lit(". Educational qualification: Bachelor degree in science. Pay scale: Rs "), (k * 10 + 1000).cast("string"),
        F.lit(" - 90000. Age limit: 18 to "), (k % 30 + 20).cast("string"), F.lit(" years. Application fee: Rs 100. Selection process: Written test. Last date to apply "),
        F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit("."),
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))
    return rows.select("o_orderkey", *(c.alias(n) for n, c in extract.details("body").items()))


@query("q_trusted_details", SQL["q_extract_details"].replace("'18 to ' || (o_orderkey % 30 + 20) || ' years' AS age_limit", "CASE WHEN o_orderkey % 2 = 0 THEN '21 years' ELSE '18 to ' || (o_orderkey % 30 + 20) || ' years' END AS age_limit"))
def trusted_details(spark, sf_dir):
    """Stored details stay where they can stand in their field, the others are read from the body: one scan of it."""
    k = F.col("o_orderkey")
    body = F.concat(
        F.lit("Total posts: "), (k % 900 + 1).cast("string"), F.lit(". Educational qualification: Bachelor degree in science. Pay scale: Rs "), (k * 10 + 1000).cast("string"),
        F.lit(" - 90000. Age limit: 18 to "), (k % 30 + 20).cast("string"), F.lit(" years. Application fee: Rs 100. Selection process: Written test. Last date to apply "),
        F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit("."),
    )
    stored = F.when(k % 2 == 0, "21 years").when(k % 3 == 0, "Not Mentioned").otherwise("years")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"), stored.alias("age_limit"), F.lit("as on date").alias("vacancy"))
    return extract.with_details(rows, "body", trusted=records.is_detail).select("o_orderkey", *extract.READERS)


@query("q_document_lines")
def document_lines(spark, sf_dir):
    """The clean lines of every whole document: held against a plain version in the tests."""
    documents = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    lines = documents.select("doc_id", reading.document_lines("text").alias("lines"))
    return lines.select("doc_id", F.size("lines").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("digest"))


@query("q_link_contexts")
def link_contexts(spark, sf_dir):
    """Every link of every page with the text of the smallest block around it; held against a parser's tree in the tests."""
    return blocks.link_contexts(table(spark, sf_dir, "pages"))


@query("q_crawl")
def crawl(spark, sf_dir):
    """From each customer a bounded search over links that orders make; held against a plain queue in the tests."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    to = F.when(F.col("o_orderkey") % 13 == 0, F.concat(F.lit("f"), "o_orderkey", F.lit(".pdf"))).otherwise(F.concat(F.lit("c"), F.col("o_orderkey") % 149))
    edges = o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), to.alias("dst"), (F.col("o_orderkey") % 50).alias("score"))
    return blocks.crawl(edges, table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src")))


@query("q_store_runs", "SELECT 'c' || c_custkey AS job_id, CASE WHEN c_custkey % 50 = 0 THEN c_name || ' new' ELSE c_name END AS title FROM customer")
def store_runs(spark, sf_dir):
    """Two runs into a copy-on-write store: all customers, then all again with every fiftieth changed."""
    kept = store.Store(shared_dir(spark), "job_id")
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("job_id"), F.col("c_name").alias("title"), F.lit("").alias("publish_date"), F.lit(True).alias("is_valid_post"), F.col("c_custkey").alias("ord")
    )
    put = lambda old, new: merge.upsert(old, new, "job_id", ("title",))
    kept.run(rows, put)
    kept.run(rows.withColumn("title", F.when(F.col("ord") % 50 == 0, F.concat("title", F.lit(" new"))).otherwise(F.col("title"))), put)
    return kept.read(spark).select("job_id", "title")


@query("q_source_scan", """
SELECT 'pages' AS source, count(*) AS pages, CAST(sum(length(coalesce(html, ''))) AS BIGINT) AS chars, 'ok' AS status FROM pages HAVING count(*) > 0
UNION ALL SELECT 'documents', 0, 0, 'failed' FROM documents HAVING count(*) > 0 UNION ALL SELECT 'absent', 0, 0, 'failed'""")
def source_scan(spark, sf_dir):
    """All pages through the data source of sources, beside a table without pages and a path that is not there."""
    named = [(k, f"{sf_dir}/{k}.parquet") for k in ("pages", "documents", "absent")]
    found = connectors.scan_outcome(connectors.source_pages(spark, named))
    return found.select("source", "pages", "chars", "status")


@query("q_page_sink", """
SELECT 'page-' || page_id || '.html' AS name, sha256(CASE WHEN contains(url, '7') THEN html || '<!-- again -->' ELSE html END) AS digest,
  CAST(count(*) FILTER (contains(url, '7')) OVER () AS BIGINT) AS written FROM (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages)""")
def page_sink(spark, sf_dir):
    """All pages written to a folder, then all once more with some changed: what stands there, and how many the second run wrote."""
    path, html = shared_dir(spark), text.text("html")
    rows = table(spark, sf_dir, "pages").withColumn("page", F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")))
    connectors.write_changed(rows.select("page", html.alias("html")), path)
    again = F.when(text.text("url").contains("7"), F.concat(html, F.lit("<!-- again -->"))).otherwise(html)
    done = connectors.write_changed(rows.select("page", again.alias("html")), path)
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("digest"), F.lit(done["written"]).cast("bigint").alias("written"))


HOME_JOBS = "CASE WHEN p_size % 3 = 0 THEN 'AUTO_UK_JOBS' WHEN p_size % 3 = 1 THEN 'AUTO_CENTRAL_JOBS' ELSE 'AUTO_STATE_JOBS' END"


@query("q_homepage", f"""
WITH caps AS (SELECT unnest({list(W.SECTION_CAPS)}) AS section, unnest({list(W.SECTION_CAPS.values())}) AS cap),
placed AS (SELECT p_partkey AS ord, unnest(['AUTO_LATEST_GRID', 'AUTO_LATEST_POSTS', 'AUTO_MARQUEE', 'AUTO_BREAKING', {HOME_JOBS}]) AS section FROM part)
SELECT section, ord, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY ord DESC) AS rank FROM placed) JOIN caps USING (section) WHERE rank <= cap""")
def homepage(spark, sf_dir):
    """The homepage's sections with their caps, newest first."""
    part = table(spark, sf_dir, "part")
    size = F.col("p_size") % 3
    kind = F.when(size == 0, "Uttarakhand Jobs").when(size == 1, "SSC").otherwise("Recruitment")
    title = F.concat_ws(" ", "p_name", F.lit("post"), F.col("p_partkey").cast("string"))
    rows = part.select(F.col("p_partkey").alias("ord"), title.alias("title"), kind.alias("category"), F.lit("Police").alias("department"))
    return route.homepage(rows, [F.desc("ord")]).select("section", "ord", F.col("rank").cast("int").alias("rank"))


@query("q_homepage_legacy", """
WITH first AS (SELECT p_partkey AS ord, p_size AS page, CASE p_size % 4 WHEN 0 THEN 'uk_jobs' WHEN 3 THEN 'state_jobs' ELSE 'central_jobs' END AS job,
  row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part QUALIFY place <= 30),
placed AS (SELECT *, unnest(['latest_cards', 'latest_posts', job]) AS section FROM first WHERE page IN (SELECT n_nationkey FROM nation)),
kept AS (SELECT section, arg_min(ord, place) AS ord, min(place) AS place FROM placed GROUP BY section, page)
SELECT section, ord, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY place) AS r FROM kept)
WHERE r <= CASE section WHEN 'latest_posts' THEN 30 ELSE 10 END""")
def homepage_legacy(spark, sf_dir):
    """The older homepage of parts by price; the pages there are go by nations' numbers, so some parts share a page and some have none."""
    size = F.col("p_size")
    kind = F.when(size % 4 == 0, "Uttarakhand Jobs").when(size % 4 == 1, "Railway Jobs").when(size % 4 == 2, "SSC").otherwise("Other State Jobs")
    html = lambda n: F.concat(F.lit("p"), n.cast("string"), F.lit(".html"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"), kind.alias("category"), html(size).alias("html_file"), "p_retailprice")
    files = table(spark, sf_dir, "nation").select(html(F.col("n_nationkey")).alias("name"))
    return route.legacy_homepage(rows, [F.desc("p_retailprice"), F.col("ord")], files).select("section", "ord", F.col("rank").cast("int").alias("rank"))


@query("q_entry_pages", """
WITH s AS (SELECT s_suppkey AS id, CASE s_nationkey % 4 WHEN 0 THEN 'UKPSC' WHEN 1 THEN 'uksssc' ELSE s_name END AS name, CASE WHEN s_nationkey % 4 < 3 THEN 'uk' ELSE '' END AS adapter FROM supplier),
p AS (SELECT unnest([0, 1]) AS k, unnest(['UKPSC', 'UKSSSC']) AS department, unnest(['https://psc.uk.gov.in/candidate-corner/recruitment', 'https://sssc.uk.gov.in/recruitment-notification/']) AS page_url)
SELECT name, adapter, page_url, department, count(*) AS sources FROM (
  SELECT name, adapter, page_url, department FROM s, p WHERE adapter = 'uk' AND (upper(name) = department OR upper(name) NOT IN ('UKPSC', 'UKSSSC'))
  UNION ALL SELECT name, 'generic', 'https://example.in/' || id, 'Board' FROM s WHERE adapter = '') GROUP BY ALL""")
def entry_pages(spark, sf_dir):
    """Where the scans of suppliers as sources begin, and for how many each time."""
    kind = F.col("s_nationkey") % 4
    rows = table(spark, sf_dir, "supplier").select(
        F.when(kind == 0, "UKPSC").when(kind == 1, "uksssc").otherwise(F.col("s_name")).alias("name"), F.concat(F.lit("https://example.in/"), F.col("s_suppkey").cast("string")).alias("url"),
        F.when(kind < 3, "uk").otherwise("").alias("adapter"), F.lit("Board").alias("department"),
    )
    return adapters.entry_pages(rows).groupBy("name", "adapter", "page_url", "department").agg(F.count("*").alias("sources"))


@query("q_dictionary_hits", """
WITH keys AS (SELECT w AS key, min(item_id) AS item FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM benchmark) GROUP BY 1),
hits AS (SELECT doc_id, w, item FROM (SELECT doc_id, unnest(regexp_extract_all(lower(regexp_replace(text, '[^ -~]', 'é', 'g')), '[a-z0-9_é]+')) AS w FROM documents) JOIN keys ON w = key)
SELECT d.doc_id, CAST(count(h.w) AS INT) AS hits, CAST(count(DISTINCT h.w) AS INT) AS keys, min(CAST(h.item AS VARCHAR)) AS least FROM documents d LEFT JOIN hits h USING (doc_id) GROUP BY 1""")
def dictionary_hits(spark, sf_dir):
    """Every document against a dictionary of some thousand words: those of the benchmark, each with its first item."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("key")
    words = table(spark, sf_dir, "benchmark").select("item_id", word).groupBy("key").agg(F.min("item_id").alias("value"))
    docs = table(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", "[^ -~]", "é"))
    found = dictionary.annotate(docs, "text", words)
    least = F.array_min(F.transform("found", lambda x: x["value"]))
    return found.select("doc_id", F.size("found").alias("hits"), F.size(F.array_distinct(F.transform("found", lambda x: x["key"]))).alias("keys"), least.alias("least"))


# Search.

ITEMS_SQL = "SELECT p_partkey AS ord, p_name AS title, p_type AS category, p_brand AS department, '' AS state, p_name || ' ' || p_type AS description, 'https://parts.example/' || (p_partkey % 1500) AS url FROM part"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand"), "p_partkey")
    return part.select(
        F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.col("p_brand").alias("department"), F.lit("").alias("state"),
        F.concat_ws(" ", "p_name", "p_type").alias("description"), F.concat(F.lit("https://parts.example/"), F.col("p_partkey") % 1500).alias("url"),
    )


def _score3_sql(q: str) -> str:
    tokens = q.split()
    case = lambda col, term, n: f"CASE WHEN contains(lower({col}), '{term}') THEN {n} ELSE 0 END"
    parts = [f"CASE WHEN lower(title) = '{q}' THEN 200 WHEN starts_with(lower(title), '{q}') THEN 120 WHEN contains(lower(title), '{q}') THEN 90 ELSE 0 END"]
    parts += [case(k, q, n) for k, n in (("category", 45), ("department", 35), ("state", 25), ("description", 15))]
    parts += [case(k, t, n) for t in tokens for k, n in (("title", 20), ("category", 10), ("description", 5))]
    return " + ".join(parts)


SEARCH = "small ring"


@query("q_search_v3", f"""
SELECT ord, title, url, CAST(score AS INT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, ord) AS r FROM (SELECT *, {_score3_sql(SEARCH)} AS score FROM ({ITEMS_SQL})) WHERE score > 0) WHERE r = 1
ORDER BY score DESC, ord LIMIT 30""")
def search_v3(spark, sf_dir):
    """Top-thirty report of a two-word query."""
    return search.search(_items(spark, sf_dir), SEARCH).select("ord", "title", "url", F.col("score").cast("int").alias("score"))


@query("q_search_scores", f"SELECT ord, CAST({_score3_sql(SEARCH)} AS INT) AS score FROM ({ITEMS_SQL})")
def search_scores(spark, sf_dir):
    """Score of every item, without the limit."""
    items = _items(spark, sf_dir)
    return items.select("ord", search.score(items, SEARCH).cast("int").alias("score"))


@query("q_search_v1")
def search_v1(spark, sf_dir):
    """With title similarity: held against difflib in the tests."""
    return search.search(_items(spark, sf_dir), SEARCH, version=1).select("ord", "title", "score")


@query("q_search_v2")
def search_v2(spark, sf_dir):
    return search.search(_items(spark, sf_dir), SEARCH, version=2).select("ord", "title", "score")


@query("q_search_stored", f"SELECT ord, title, CAST(score AS INT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, ord) AS r FROM (SELECT *, {_score3_sql('anvil rod')} AS score FROM ({ITEMS_SQL})) WHERE score > 0) WHERE r = 1 ORDER BY score DESC, ord LIMIT 30")
def search_stored(spark, sf_dir):
    """The third scorer over a stored index of all items, built first."""
    path = shared_dir(spark)
    postings.build(_items(spark, sf_dir), path)
    return postings.find(spark, path, "anvil rod").select("ord", "title", "score")


@query("q_search_facets", f"SELECT ord, title FROM ({ITEMS_SQL}) WHERE contains(lower(category), 'prom') AND contains(lower(department), '1')")
def search_facets(spark, sf_dir):
    return search.facet(search.facet(_items(spark, sf_dir), "category", "Prom"), "department", "1").select("ord", "title")


@query("q_suggest", f"SELECT title, min(ord) AS ord FROM ({ITEMS_SQL}) WHERE contains(lower(title), 'b') GROUP BY title ORDER BY 2 LIMIT 8")
def suggest(spark, sf_dir):
    return search.suggest(_items(spark, sf_dir), "b")


@query("q_trending_categories", f"SELECT category, min(ord) AS ord FROM ({ITEMS_SQL}) GROUP BY category ORDER BY 2 LIMIT 10")
def trending_categories(spark, sf_dir):
    return search.trending(_items(spark, sf_dir))


@query("q_did_you_mean")
def did_you_mean(spark, sf_dir):
    return search.did_you_mean(_items(spark, sf_dir), "smal rng")


@query("q_related")
def related(spark, sf_dir):
    return search.related(_items(spark, sf_dir), SEARCH)


def _headlines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Beginnings of documents as titles, and those of every hundredth document as queries, mistyped."""
    start = F.regexp_extract("text", r"^(?:\s++|\S){0,48}+", 0)  # 48 characters when each run of white space is one; the rest of the text is not read
    head = F.regexp_replace(F.regexp_replace(start, r"\s+", " "), "[^a-zA-Z0-9 ]", "")
    titles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), head.alias("title"))
    wrong = F.concat(F.substring("title", 2, 20), F.lit("x"), F.expr("substring(title, 23)"))
    return titles.where("ord % 100 = 0").select(F.col("ord").alias("qid"), wrong.alias("query")), titles


@query("q_did_you_mean_all")
def did_you_mean_all(spark, sf_dir):
    """The most similar of all headlines for each mistyped one; held against difflib over all pairs in the tests."""
    return similarity.best_titles(*_headlines(spark, sf_dir)).select("qid", "query", "title", "ord", "ratio")


@query("q_related_all")
def related_all(spark, sf_dir):
    """The first ten related headlines of each."""
    return similarity.related_titles(*_headlines(spark, sf_dir), least=0.6).select("qid", "title", "ord", "ratio", "rank")


@query("q_smart_search")
def smart_search(spark, sf_dir):
    return search.smart_search(N.notices(spark, sf_dir), "railwey teacherjob").select("ord", "title", "score")


@query("q_slugs", f"""
SELECT ord, rtrim(left(rtrim(left(trim(regexp_replace(lower(replace(title, '&', ' and ')), '[^a-z0-9]+', '-', 'g'), '-'), 130), '-') || '-' || right(md5(regexp_replace({N.clean_sql('title')}, '[^a-z0-9 ]', '', 'g') || '|' || regexp_replace({N.clean_sql('url')}, '[^a-z0-9 ]', '', 'g')), 10), 150), '-') AS slug
FROM ({N.SQL})""")
def slugs(spark, sf_dir):
    rows = N.notices(spark, sf_dir)
    return rows.select("ord", udfs.slug(F.col("title"), keys.job_id("title", "url")).alias("slug"))


@query("q_simple_slugs", f"SELECT ord, trim(regexp_replace(lower(trim(title)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM ({N.SQL})")
def simple_slugs(spark, sf_dir):
    return N.notices(spark, sf_dir).select("ord", text.simple_slug("title").alias("slug"))


@query("q_tags_keywords", f"""
SELECT ord, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(title || ' ' || category || ' ' || source || ' ' || regexp_extract(title, '(20\\d{{2}})', 1), ' '), lambda x: regexp_replace(lower(x), '[^a-z0-9 ]', '', 'g')), lambda x: length(x) >= 3))), ',') AS tags,
  title || '|' || title || ' Recruitment|' || title || ' Notification|' || title || ' Apply Online|' || title || ' Vacancy|' || title || ' Jobs|' || title || ' Last Date|' || title || ' Official Notification' AS keywords FROM ({N.SQL})""")
def tags_keywords(spark, sf_dir):
    """Sorted distinct tags, and keywords in order."""
    rows = N.notices(spark, sf_dir)
    return rows.select("ord", F.array_join(records.tags(rows.columns), ",").alias("tags"), F.array_join(records.keywords("title"), "|").alias("keywords"))


@query("q_top_searches", "SELECT event_type AS query, count(*) AS n, min(event_id) AS first FROM events GROUP BY event_type ORDER BY n DESC, first LIMIT 10")
def top_searches(spark, sf_dir):
    """Most frequent queries, with event types as the query log."""
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("query"), F.col("event_id").alias("ord"))
    return search.top_queries(log)


@query("q_search_dashboard", "SELECT count(*) AS searches, count(DISTINCT event_type) AS distinct_queries, count(*) FILTER (WHERE r = 0) AS zero_results, CAST(sum(r) AS BIGINT) AS results FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS r FROM events)")
def search_dashboard(spark, sf_dir):
    n = F.get_json_object("props", "$.k").cast("bigint") % 3
    return search.dashboard(table(spark, sf_dir, "events").select(F.col("event_type").alias("query"), n.alias("n_results")))


@query("q_recent_history", "SELECT event_type AS query, min(event_id) AS ord FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 100) GROUP BY 1 ORDER BY 2 DESC LIMIT 10")
def recent_history(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("query"), F.col("event_id").alias("ord"))
    return search.recent_queries(log)


# Adapters, editor rules and projections.

ADAPTER_OF = tuple(adapters.RULES)


def _adapter_sql() -> str:
    parts = []
    for name, (must, never, sites, least) in adapters.RULES.items():
        t, blob = N.clean_sql("title"), f"({N.clean_sql('title')} || ' ' || lower(url))"
        test = f"length({t}) >= {max(least, 1)} AND {N.any_of(blob if name == 'generic' else t, must)} AND NOT {N.any_of(blob if name == 'generic' else t, never)}"
        if name == "generic":
            test += f" AND len(string_split({t}, ' ')) > 2 AND NOT regexp_matches(lower(url), '\\.pdf$|^javascript|^mailto:')"
            test += f" AND NOT regexp_matches({t}, 'view|support|student|academic|event|more')"
        label = N.quoted(next(iter(sites.values()), "Government"))
        parts.append(f"SELECT min(ord) AS ord, {label} AS department, lower(title) AS title FROM n WHERE ord % {len(ADAPTER_OF)} = {ADAPTER_OF.index(name)} AND {test} GROUP BY lower(title), lower(url)")
    return f"WITH n AS ({N.SQL}) " + " UNION ALL ".join(parts)


@query("q_adapter_scan", _adapter_sql())
def adapter_scan(spark, sf_dir):
    """Union of all adapters over notices dealt to them in turn."""
    name = F.element_at(F.array(*map(F.lit, ADAPTER_OF)), (F.col("ord") % len(ADAPTER_OF) + 1).cast("int"))
    rows = N.notices(spark, sf_dir).select("ord", "title", "url", F.lit("").alias("page_url"), name.alias("adapter"))
    return scan(rows).select("ord", "department", F.lower("title").alias("title"))


@query("q_generic_category", f"""
SELECT ord, CASE WHEN {N.any_of('t', W.GENERIC_ADMIT)} THEN 'Admit Card' WHEN {N.any_of('t', W.GENERIC_RESULT)} THEN 'Results' WHEN {N.any_of('t', W.GENERIC_ANSWER)} THEN 'Answer Key'
  WHEN {N.any_of('t', W.GENERIC_SYLLABUS)} THEN 'Syllabus' WHEN {N.any_of('t', W.GENERIC_SCHOLARSHIP)} THEN 'Scholarship' WHEN {N.any_of('t', W.GENERIC_SCHEME)} THEN 'Government Schemes' ELSE 'Latest Jobs' END AS category
FROM (SELECT ord, {N.clean_sql('title')} AS t FROM ({N.SQL}))""")
def generic_category(spark, sf_dir):
    return N.notices(spark, sf_dir).select("ord", classify.generic_category("title").alias("category"))


@query("q_editor_type", f"""
SELECT ord, CASE WHEN {N.any_of('t', W.EDITOR_ADMIT)} THEN 'admit-card' WHEN {N.any_of('t', W.TYPE_ANSWER)} THEN 'answer-key' WHEN regexp_matches(t, '\\b(result|results|merit list|score card|scorecard)\\b') THEN 'result'
  WHEN contains(t, 'syllabus') THEN 'syllabus' WHEN {N.any_of('t', W.SCHOLARSHIP_TERMS)} THEN 'scholarship' WHEN {N.any_of('t', W.EDITOR_ENTRANCE)} THEN 'entrance' WHEN {N.any_of('t', W.EDITOR_INTERVIEW)} THEN 'interview'
  WHEN {N.any_of('t', W.EDITOR_NOTICE)} AND NOT {N.any_of('t', W.EDITOR_APPLY)} THEN 'notice' WHEN {N.any_of('t', W.EDITOR_RECRUITMENT)} THEN 'recruitment' ELSE 'notice' END AS kind
FROM (SELECT ord, {N.clean_sql('title')} AS t FROM ({N.SQL}))""")
def editor_type(spark, sf_dir):
    return N.notices(spark, sf_dir).select("ord", classify.editor_type("title").alias("kind"))


@query("q_category_noise", f"SELECT ord FROM (SELECT ord, {N.clean_sql('title')} AS t FROM ({N.SQL})) WHERE {N.one_of('t', W.CATEGORY_NOISE)} OR length(t) < 12 OR {N.any_of('t', W.CHROME)}")
def category_noise(spark, sf_dir):
    return N.notices(spark, sf_dir).where(classify.category_noise("title", "description")).select("ord")


@query("q_latest_eligible", f"SELECT ord FROM ({N.SQL}) WHERE lower(category) IN ('recruitment', 'latest jobs', 'latest job') AND NOT {N.any_of('lower(title)', W.NOT_LATEST)} AND NOT (size % 2 = 0 AND size < 25)")
def latest_eligible(spark, sf_dir):
    """Latest Jobs eligibility; a deadline in 1998 is made of the part's size."""
    last = F.when(F.col("size") % 2 == 0, F.date_add(F.lit("1998-01-01").cast("date"), F.col("size").cast("int")))
    test = classify.latest_eligible("title", F.lit("notice"), "category", last, "1998-01-26")
    return N.notices(spark, sf_dir).where(test).select("ord")


@query("q_search_items", f"""
SELECT ord, trim(title) AS title, coalesce(nullif(trim(regexp_replace(lower(trim(title)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'post') AS slug, url, category, '' AS department, '' AS state, '' AS publish_date, '' AS last_date,
  'images/default.jpg' AS image, left(description, 250) AS description, '' AS keywords FROM ({N.SQL})""")
def search_items(spark, sf_dir):
    return projections.search_items(N.notices(spark, sf_dir)).withColumn("keywords", F.array_join("keywords", " "))


@query("q_page_cards", f"""
SELECT page, sha1(h) AS digest, CAST(length(h) AS INT) AS size FROM (SELECT page, string_agg('<article class="card"><h3><a href="' || {N.escaped('url')} || '">' || {N.escaped('title')} || '</a></h3><p>' || {N.escaped('left(description, 420)')}
  || '</p><div>Posted:  | Last Date: </div></article>', chr(10) ORDER BY rank) AS h FROM ({{TOP50}}) JOIN ({N.SQL}) USING (ord) GROUP BY page)""".replace("{TOP50}", SQL["q_category_top50"]))
def page_cards(spark, sf_dir):
    """HTML cards of the top fifty of each page."""
    rows = route.route(N.notices(spark, sf_dir)).select(F.explode_outer("pages").alias("page"), "ord", "title", "url", "description", "size")
    top = dedupe.top_per_group(rows, "page", [F.desc("size"), F.col("ord")], 50)
    html = projections.card(F.col("title"), F.col("url"), F.col("description"), F.lit(""), F.lit(""))
    return projections.page_cards(top, html).select("page", F.sha1("html").alias("digest"), F.length("html").alias("size"))


@query("q_structured_data", f"""
SELECT ord, '{{"@context":"https://schema.org","@type":"JobPosting","title":"' || title || '","url":"' || url || '","hiringOrganization":{{"@type":"Organization","name":"' || source || '"}}}}' AS json FROM ({N.SQL})""")
def structured_data(spark, sf_dir):
    none = F.lit("")
    return N.notices(spark, sf_dir).select("ord", projections.structured_data(F.col("title"), F.col("url"), F.col("source"), none, none).alias("json"))


from . import golden  # noqa: E402, F401  registers its queries
