"""Queries whose rows are cases with known outcomes, and queries of records, orders and the publisher run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, dates, records, text, udfs
from ..functions import wordlists as W
from ..operators import dedupe, keys, lifecycle, links, lookup, merge, orders, projections, route
from ..operators.store import Store
from ..sources import adapters, table
from ..storage import shared_dir
from . import cases as C
from . import notices as N
from . import pipeline
from .queries import CLASSIFY_SQL, SQL, TUD_SQL, query

TODAY = "2026-06-01"


def case_query(name: str, cases: C.Cases, doc: str):
    """Register a query of ``ord`` and the columns that the function makes of the inputs of all cases."""

    def register(make):
        def run(spark, sf_dir):
            rows = cases.frame(spark, sf_dir)
            return rows.select("ord", *(c.alias(n) for n, c in make(rows.columns).items()))

        run.__doc__ = doc
        return query(name, cases.sql)(run)

    return register


case_query("q_title_cleaners", C.TITLES, "Four title cleaners.")(
    lambda have: {"page": text.page_title("title"), "parsed": text.parsed_title("title"), "reader": text.reader_title("title"), "plain": text.plain_title("title")}
)
case_query("q_mojibake", C.MOJIBAKE, "Wrongly decoded text put right.")(lambda have: {"repaired": text.repair_mojibake("x")})
case_query("q_values", C.VALUES, "Three value cleaners.")(
    lambda have: {"reader": text.reader_value("x"), "detail": records.clean_detail("x"), "structured": text.structured_value("x")}
)
case_query("q_detail_valid", C.DETAILS, "Which detail fields a value can stand in.")(lambda have: {k: records.is_detail("x", k) for k in C.DETAILS.outputs.split()})
case_query("q_detail_sanitise", C.Cases("x", "kept", [(r[0], " ".join(r[0].split()) if r[3] else "-") for r in C.DETAILS.rows], C.DETAILS.fill), "A salary, or the fallback.")(
    lambda have: {"kept": records.sanitise("x", "salary", "-")}
)
case_query("q_detail_usable", C.USABLE, "The adapters' test of extracted values.")(lambda have: {k: records.is_usable("x", k) for k in C.USABLE.outputs.split()})
case_query("q_detail_better", C.Cases("x", "now other", [(r[0], r[0] if r[1] else "old", "old") for r in C.USABLE.rows], C.USABLE.fill), "A vacancy of a document replaces a recruitment's.")(
    lambda have: {"now": records.better(F.lit("old"), "x", "vacancy", F.lit("Recruitment")), "other": records.better(F.lit("old"), "x", "vacancy", F.lit("result"))}
)
case_query("q_corrupt", C.CORRUPT, "Values spoilt by character recognition.")(lambda have: {"corrupt": records.is_corrupt("x")})
case_query("q_candidates", C.CANDIDATES, "Fresh openings.")(lambda have: {"candidate": lifecycle.recent_candidate("title", TODAY)})
case_query("q_activity", C.ACTIVITY, "Closed and active notices.")(lambda have: {"closed": records.is_closed(have, TODAY), "active": records.is_active(have, TODAY)})
case_query("q_fresh_records", C.FRESHNESS, "The whole freshness cascade.")(lambda have: {"fresh": records.is_fresh(have, TODAY)})
case_query("q_published_day", C.PUBLISHED, "Publication days.")(lambda have: {"day": dates.published_day(have)})
case_query("q_written_dates", C.WRITTEN, "First labelled date, archive form and years.")(
    lambda have: {"first": dates.first_date("x"), "archive": dates.archive_day("x"), "newest": dates.newest_year("x"), "last": dates.last_year("x")}
)
case_query("q_page_type", C.PAGE_TYPES, "Types of rendered pages.")(lambda have: {"kind": classify.page_type("title", "category", "post_type")})
case_query("q_strict_active", C.STRICT, "Strict activity of recruitments.")(lambda have: {"active": lifecycle.active_recruitment(have, TODAY)})
case_query("q_generic_links", C.GENERIC, "Links that the generic scan takes.")(lambda have: {"taken": adapters.wanted("generic", "title", "url")})
case_query("q_published_meta", C.METAS, "Publication dates of pages.")(lambda have: {"day": links.published("html")})
case_query("q_card_score", C.CARDS, "Scores of a card's links.")(lambda have: {"score": links.card_score("title", "label", "context", "url", "root")})
case_query("q_reader_summary", C.SUMMARIES, "Reader summaries.")(lambda have: {"summary": records.reader_summary(have)})
case_query("q_placeholders", C.HOLES, "Seven sets of placeholders.")(lambda have: {k: text.placeholder("x", v) for k, v in W.PLACEHOLDER_SETS.items()})
case_query("q_script_detect", C.SCRIPTS, "The script of a text.")(lambda have: {"script": text.language("x")})
case_query("q_glyph_spacing", C.GLYPHS, "Devanagari words joined.")(lambda have: {"joined": udfs.glyphs("x")})
case_query("q_source_text", C.TEXTS, "Texts of a record by module.")(lambda have: {k: records.source_text(have, k) for k in ("reader", "structured", "page")})


@query("q_public", C.PUBLIC.sql)
def public(spark, sf_dir):
    """Notices that readers may see."""
    rows = C.PUBLIC.frame(spark, sf_dir).withColumn("is_valid_post", F.col("is_valid_post").cast("boolean"))
    return rows.select("ord", records.is_public(rows.columns).alias("public"))


def _pairs(rows: DataFrame) -> DataFrame:
    one = lambda i: F.struct(F.lit(i).alias("pos"), F.col(f"t{i + 1}").alias("title"), F.lit("").alias("around"), F.col(f"u{i + 1}").alias("url"))
    return rows.select("ord", F.explode(F.array(one(0), one(1))).alias("l")).select("ord", "l.*")


@query("q_page_links", C.PDFS.sql)
def page_links(spark, sf_dir):
    """Best PDF, first PDF and first apply link of pages with two links each; the better apply link where both have one."""
    rows = C.PDFS.frame(spark, sf_dir)
    found = _pairs(rows)
    parts = {"best": links.best_pdf(found, "ord"), "first": links.first_pdf(found, "ord"), "apply": links.apply_link(found, "ord")}
    out = rows.select("ord")
    for name, part in parts.items():
        out = out.join(part.select("ord", F.col("url").alias(name)), "ord", "left")
    return out


@query("q_official_pdf", f"SELECT * FROM ({C.OFFICIAL.sql}) WHERE pdf IS NOT NULL")
def official_pdf(spark, sf_dir):
    """Official documents, each organisation's page being that of one case."""
    rows = C.OFFICIAL.frame(spark, sf_dir)
    mine = F.concat("organisation", F.lit(" no"), "ord", F.lit("x"))
    found = rows.select(mine.alias("organisation"), F.col("label").alias("title"), F.lit("").alias("around"), "url")
    asked = rows.select("ord", F.replace(F.lower("title"), F.col("organisation"), mine).alias("title"))
    return lookup.official_pdf(asked, found)


@query("q_home_sections", f"SELECT ord, unnest([section, strict]) AS section, unnest(['plain', 'strict']) AS rule FROM ({C.SECTIONS.sql})")
def home_sections(spark, sf_dir):
    """The job section of each notice by both rules."""
    rows = C.SECTIONS.frame(spark, sf_dir)
    out = None
    for rule, day in (("plain", None), ("strict", TODAY)):
        placed = route.home_sections(rows, day).where(~F.col("section").isin("AUTO_LATEST_GRID", "AUTO_LATEST_POSTS", "AUTO_MARQUEE", "AUTO_BREAKING"))
        part = rows.select("ord").join(placed.select("ord", "section"), "ord", "left").withColumn("rule", F.lit(rule))
        out = part if out is None else out.unionByName(part)
    return out.select("ord", "section", "rule")


@query("q_merge_rules", C.MERGES.sql)
def merge_rules(spark, sf_dir):
    """Merges of two batches, field by field."""
    rows = C.MERGES.frame(spark, sf_dir)

    def side(p: str, notified, valid):
        return rows.where(f"has_{'old' if p == 'o' else 'new'} = '1'").select(
            F.col("ord").cast("string").alias("job_id"), F.col("ord"), F.col(f"{p}_title").alias("title"), F.col(f"{p}_vacancy").alias("vacancy"),
            F.col(f"{p}_publish").alias("publish_date"), notified.alias("notification_date"), F.col(f"{p}_year").alias("year"), valid.alias("is_valid_post"),
        )

    old, new = side("o", F.lit(""), F.lit(True)), side("n", F.col("n_notified"), F.col("n_valid") == "true")
    twice = new.unionByName(new.withColumn("ord", F.col("ord") + 1_000_000_000).withColumn("vacancy", F.lit("77")))  # a repeat in the batch
    done = merge.upsert(old, twice, "job_id", ("title", "vacancy", "notification_date"))
    return done.select(F.col("job_id").cast("bigint").alias("ord"), "change", "title", "vacancy", F.col("publish_date").alias("publish"), "year")


# Records.

DEPARTMENT = SQL["q_department"]


@query("q_optimise", f"""
SELECT ord, kind AS category, kind IS NOT NULL AS valid, CASE WHEN kind IS NULL THEN NULL ELSE md5(regexp_replace(t, '[^a-z0-9 ]', '', 'g') || '|' || regexp_replace(u, '[^a-z0-9 ]', '', 'g')) END AS job_id,
  CASE WHEN kind IS NULL THEN NULL ELSE regexp_extract(title, '(20\\d{{2}})', 1) END AS year,
  CASE WHEN kind IS NULL THEN NULL WHEN ord % 3 = 0 THEN '01-02-2026' WHEN ord % 3 = 1 THEN '05-05-2025' ELSE '' END AS publish_date,
  CASE WHEN kind IS NULL THEN NULL ELSE title || '|' || title || ' Recruitment|' || title || ' Notification|' || title || ' Apply Online|' || title || ' Vacancy|' || title || ' Jobs|' || title || ' Last Date|' || title || ' Official Notification' END AS keywords
FROM (SELECT *, {CLASSIFY_SQL} AS kind FROM ({TUD_SQL}))""")
def optimise(spark, sf_dir):
    """Derived fields of every notice."""
    k = F.col("ord") % 3
    rows = N.notices(spark, sf_dir).withColumns({"posted_date": F.when(k == 0, "01-02-2026").otherwise(""), "publish_date": F.when(k == 2, "").otherwise("05-05-2025")})
    made = records.optimise(rows.drop("category").withColumn("category", F.lit(None).cast("string")).drop("job_id"))
    none = F.col("is_valid_post")
    return made.select("ord", "category", F.col("is_valid_post").alias("valid"), "job_id", "year", F.when(none, F.col("publish_date")).alias("publish_date"), F.when(none, F.array_join("keywords", "|")).alias("keywords"))


@query("q_revalidate", f"""
SELECT ord, kind AS category, trim(title) AS title, CASE WHEN ord % 2 = 0 THEN '2026-01-05' ELSE '01-01-2026' END AS publish_date FROM (SELECT *, {CLASSIFY_SQL} AS kind FROM ({TUD_SQL})) WHERE kind IS NOT NULL""")
def revalidate(spark, sf_dir):
    """Stored rows judged anew, with stale flags and categories."""
    rows = N.notices(spark, sf_dir).withColumns({
        "category": F.lit("Latest Jobs"), "is_valid_post": F.lit(True), "job_id": F.lit("old"), "title": F.concat(F.lit("  "), "title"),
        "publish_date": F.when(F.col("ord") % 2 == 0, "").otherwise("01-01-2026"), "scraped_at": F.lit("2026-01-05T10:00:00"),
    })
    return records.revalidate(rows).select("ord", "category", "title", "publish_date")


@query("q_validate", f"SELECT ord FROM (SELECT *, {CLASSIFY_SQL} AS kind FROM ({TUD_SQL})) WHERE kind IS NOT NULL AND ord % 4 <> 1 AND ord % 5 <> 2")
def validate(spark, sf_dir):
    """Complete records that have not expired: every fourth has, every fifth has no address."""
    rows = records.optimise(N.notices(spark, sf_dir))
    last = F.when(F.col("ord") % 4 == 1, "31-05-2026").when(F.col("ord") % 4 == 2, "1 June 2026").otherwise("soon")
    rows = rows.withColumns({"last_date": last, "url": F.when(F.col("ord") % 5 == 2, "").otherwise(F.col("url"))})
    return records.validate(rows, TODAY).select("ord")


VARIANTS = f"SELECT ord, title, url, description, 0 AS priority, ord * 2 AS place FROM ({N.SQL}) UNION ALL SELECT ord, title || ' !', url, description, CASE WHEN ord % 2 = 0 THEN 1 ELSE 0 END, ord * 2 + 1 FROM ({N.SQL})"


PUBLISH_SQL = f"""
WITH v AS ({VARIANTS}), k AS (SELECT *, {CLASSIFY_SQL} AS kind FROM (SELECT *, {N.clean_sql('title')} AS t, {N.clean_sql('url')} AS u, {N.clean_sql('description')} AS d FROM v)),
i AS (SELECT *, md5(trim(regexp_replace(t, '[^a-z0-9 ]', '', 'g')) || '|' || regexp_replace(u, '[^a-z0-9 ]', '', 'g')) AS same FROM k WHERE kind IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY md5(regexp_replace(t, '[^a-z0-9 ]', '', 'g') || '|' || regexp_replace(u, '[^a-z0-9 ]', '', 'g')) ORDER BY priority DESC, place) AS r FROM i)
SELECT md5(regexp_replace(t, '[^a-z0-9 ]', '', 'g') || '|' || regexp_replace(u, '[^a-z0-9 ]', '', 'g')) AS job_id, title, kind AS category,
  CASE WHEN length(t) < 20 OR {N.any_of('t', W.GATE_BLOCKED)} OR (lower(kind) = 'recruitment' AND NOT {N.any_of('t', W.GATE_RECRUITMENT)}) THEN 'hidden' ELSE 'live' END AS part FROM b WHERE r = 1"""


def _variants(spark, sf_dir):
    rows = N.notices(spark, sf_dir).select("ord", "title", "url", "description")
    one = rows.withColumn("priority", F.lit(0)).withColumn("ord", F.col("ord") * 2)
    two = rows.withColumns({"title": F.concat("title", F.lit(" !")), "priority": F.when(F.col("ord") % 2 == 0, 1).otherwise(0), "ord": F.col("ord") * 2 + 1})
    return one.unionByName(two)


def _parts(out):
    parts = [out[p].select("job_id", "title", "category", F.lit(p).alias("part")) for p in ("live", "hidden", "archive")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("q_publish", PUBLISH_SQL)
def publish(spark, sf_dir):
    """A batch with repeats published twice: the second run finds its own rows and changes nothing."""
    fresh = _variants(spark, sf_dir)
    first = pipeline.publish(fresh.limit(0), fresh, TODAY)
    stored = first["live"].unionByName(first["hidden"]).unionByName(first["archive"])
    return _parts(pipeline.publish(stored, fresh, TODAY))


@query("q_publish_stored", PUBLISH_SQL)
def publish_stored(spark, sf_dir):
    """The same batch published twice into a stored live table."""
    live, fresh = Store(shared_dir(spark), "job_id"), _variants(spark, sf_dir)
    pipeline.publish_into(live, fresh, TODAY)
    pipeline.publish_into(live, fresh, TODAY)
    return _parts(pipeline.published(live, spark, TODAY))


# Orders, over notices made of parts.

ORDER_ROWS = """SELECT p_partkey AS ord, p_size % 5 AS priority, p_name AS title, CASE WHEN p_size % 4 = 0 THEN '' ELSE strftime(DATE '2026-01-01' + CAST(p_size AS INT), '%Y-%m-%d') END AS scraped_at,
  CASE WHEN p_size % 3 = 0 THEN '' ELSE strftime(DATE '2026-01-01' + CAST((p_size * 7) % 60 AS INT), '%d-%m-%Y') END AS publish_date, strftime(DATE '2026-03-01' + CAST(p_size AS INT), '%Y-%m-%d') AS date,
  CASE WHEN p_size % 4 = 0 THEN NULL ELSE DATE '2026-01-01' + CAST(p_size AS INT) END AS seen,
  CASE WHEN p_size % 3 = 0 THEN DATE '2026-03-01' + CAST(p_size AS INT) ELSE DATE '2026-01-01' + CAST((p_size * 7) % 60 AS INT) END AS published FROM part"""
ORDER_SQL = {
    "priority": "priority DESC, title DESC", "discovery": "seen DESC NULLS LAST, published DESC NULLS LAST, lower(title) DESC", "category": "publish_date DESC",
    "index": "coalesce(nullif(publish_date, ''), date) DESC", "legacy": "date DESC", "archive": "publish_date DESC",
}


def _order_rows(spark, sf_dir) -> DataFrame:
    size, day = F.col("p_size").cast("int"), lambda start, n: F.date_add(F.lit(start).cast("date"), n)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"), (size % 5).alias("priority"), F.col("p_name").alias("title"),
        F.when(size % 4 == 0, "").otherwise(F.date_format(day("2026-01-01", size), "yyyy-MM-dd")).alias("scraped_at"),
        F.when(size % 3 == 0, "").otherwise(F.date_format(day("2026-01-01", size * 7 % 60), "dd-MM-yyyy")).alias("publish_date"),
        F.date_format(day("2026-03-01", size), "yyyy-MM-dd").alias("date"),
    )


def _order_query(name: str, by_date: bool = False):
    told = ORDER_SQL["discovery" if by_date else name]
    title = f"q_order_{name}" + ("_by_date" if by_date else "")

    def run(spark, sf_dir):
        return orders.placed(_order_rows(spark, sf_dir), name, by_date).select("ord", "rank")

    run.__doc__ = f"The place of every notice in the {name} order."
    query(title, f"SELECT ord, row_number() OVER (ORDER BY {told}, ord) AS rank FROM ({ORDER_ROWS})")(run)


for _name in ORDER_SQL:
    _order_query(_name)
_order_query("category", by_date=True)


# Sets, lists and pages.

@query("q_union_known", "SELECT DISTINCT ON (lower(c_name)) lower(c_name) AS title, side FROM (SELECT c_name, 0 AS side, c_custkey AS ord FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT upper(c_name), 1, c_custkey FROM customer WHERE c_custkey % 3 <> 1) ORDER BY lower(c_name), side, ord")
def union_known(spark, sf_dir):
    """Live and archive customers as one set, whatever the case of their names; the live row stays."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("title"))
    live = rows.where("ord % 3 <> 0").withColumn("side", F.lit(0))
    archive = rows.where("ord % 3 <> 1").withColumn("title", F.upper("title")).withColumn("side", F.lit(1))
    return merge.union_known(live, archive).select(F.lower("title").alias("title"), "side")


@query("q_new_once", "SELECT o_custkey AS customer, min(o_orderkey) AS ord FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) GROUP BY 1")
def new_once(spark, sf_dir):
    """Customers without a very large order, each once, by the first of their orders."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("customer"), "o_totalprice")
    return merge.new_only(rows, rows.where("o_totalprice > 400000"), "customer").select("customer", "ord")


@query("q_changed_outputs", "SELECT p_partkey AS page FROM part WHERE p_partkey % 3 <> 0")
def changed_outputs(spark, sf_dir):
    """Pages to write: every third is stored as it is, every third as it was, the others are new."""
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.col("p_name").alias("html"))
    same = pages.where("page % 3 = 0").select("page", F.sha2("html", 256).alias("digest"))
    old = pages.where("page % 3 = 1").select("page", F.sha2(F.concat("html", F.lit("x")), 256).alias("digest"))
    return merge.changed_outputs(pages, same.unionByName(old)).select("page")


@query("q_index_filter", f"SELECT min(ord) AS ord FROM (SELECT ord, trim(regexp_replace(lower(replace(title, '&', ' and ')), '[^a-z0-9]+', '-', 'g'), '-') AS slug, trim(title) AS t FROM ({N.SQL})) WHERE length(t) >= 5 GROUP BY slug")
def index_filter(spark, sf_dir):
    """Rows of the search index, one of each page."""
    return projections.indexed(N.notices(spark, sf_dir)).select("ord")


@query("q_lean_items", f"""
SELECT ord, trim(title) AS title, slug || '.html' AS url, category FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY ord) AS r FROM (
  SELECT ord, title, rtrim(left(trim(regexp_replace(lower(replace(title, '&', ' and ')), '[^a-z0-9]+', '-', 'g'), '-'), 130), '-') AS slug, category FROM ({N.SQL}) JOIN (SELECT ord, category AS shown FROM ({SQL['q_home_category']})) USING (ord)
  WHERE trim(title) <> '' AND NOT regexp_matches(lower(trim(title)), '{W.NOISE_PATTERN}'))) WHERE r = 1""".replace("AS slug, category FROM", "AS slug, shown AS category FROM"))
def lean_items(spark, sf_dir):
    """Items of the homepage's search."""
    return projections.lean_items(N.notices(spark, sf_dir)).select("ord", "title", "url", "category")


@query("q_new_candidates", f"""
SELECT min(ord) AS ord, lower(trim(url)) AS key FROM ({N.SQL}) WHERE length(title) >= 12 AND contains(lower(title), 'recruitment') AND contains(title, '2027') GROUP BY 2""")
def new_candidates(spark, sf_dir):
    """Candidates of one template that the known set lacks, the first of each address."""
    rows = N.notices(spark, sf_dir).where("title LIKE '%2027%'").select("ord", "title", "url")
    known = N.notices(spark, sf_dir).where("title NOT LIKE '%2027%'").select("title", "url")
    return lifecycle.new_candidates(rows, known, TODAY).select("ord", F.lower("url").alias("key"))


@query("q_first_long_text", "SELECT p_partkey AS ord, CASE WHEN p_size >= 30 THEN 'a' WHEN p_size >= 10 THEN 'b' ELSE 'c' END AS which FROM part")
def first_long_text(spark, sf_dir):
    """The first text of 300 characters: of a PDF, a page, else what there is."""
    size = F.col("p_size").cast("int")
    a, b = F.repeat(F.lit("a"), size * 10), F.repeat(F.lit("b"), size * 30)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), a.alias("a"), b.alias("b"))
    return rows.select("ord", F.substring(records.first_long_text([F.col("a"), F.col("b")], fallback=F.lit("c")), 1, 1).alias("which"))


@query("q_card_links", "SELECT p_partkey AS ord, 'https://x.in/f' || n || '.pdf' AS url, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY length('https://x.in/f' || n || '.pdf') DESC, 'https://x.in/f' || n || '.pdf') AS INT) AS rank FROM part, unnest(range(CASE WHEN p_size > 24 THEN 24 ELSE p_size END)) AS u(n)")
def card_links(spark, sf_dir):
    """Up to 24 links of cards whose links score alike: longer addresses first, one of each but for its fragment."""
    top = F.least(F.col("p_size").cast("int"), F.lit(24))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.explode(F.sequence(F.lit(0), top * 2 - 1)).alias("n"), top.alias("top"))
    url = F.concat(F.lit("https://x.in/f"), (F.col("n") % F.col("top")).cast("string"), F.lit(".pdf"), F.when(F.col("n") >= F.col("top"), "").otherwise("#p"))
    rows = rows.select("ord", F.lit("Law Officer").alias("title"), F.lit("advertisement").alias("label"), F.lit("").alias("context"), url.alias("url"), F.lit("https://x.in/").alias("root"))
    return links.card_links(rows).select("ord", F.split_part("url", F.lit("#"), F.lit(1)).alias("url"), "rank")


@query("q_build_categories", f"""
WITH n AS (SELECT * FROM ({N.SQL})), d AS (SELECT min(ord) AS ord FROM (SELECT *, {N.clean_sql('title')} AS t FROM n) WHERE ord NOT IN (SELECT ord FROM ({SQL['q_category_noise']})) GROUP BY trim(regexp_replace(t, '[^a-z0-9]+', '-', 'g'), '-')),
r AS (SELECT unnest(string_split(pages, ',')) AS page, ord, size FROM ({SQL['q_multi_label_route']}) JOIN n USING (ord) WHERE ord IN (SELECT ord FROM d))
SELECT page, ord, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY size DESC, ord) AS k FROM r) WHERE k <= 50""")
def build_categories(spark, sf_dir):
    """Category pages: noise out, one of each title, routed, fifty a page."""
    return route.categories(N.notices(spark, sf_dir), [F.desc("size"), F.col("ord")]).select("page", "ord", "rank")


@query("q_slug_keys", f"SELECT slug, min(ord) AS ord FROM (SELECT ord, trim(regexp_replace(lower(trim(title)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM ({N.SQL})) GROUP BY slug")
def slug_keys(spark, sf_dir):
    """The first notice of each title slug."""
    rows = N.notices(spark, sf_dir).withColumn("slug", keys.page_slug("title"))
    return dedupe.first_per_key(rows, "slug").select("slug", "ord")
