"""Projections of notices: search items, file names, structured data and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, dates, records
from ..functions import wordlists as W
from ..functions.records import field, first_given
from ..functions.text import escape_html, simple_slug, squeeze, strip, text
from ..functions.udfs import slug
from .dedupe import first_per_key

DEFAULT_IMAGE = "images/default.jpg"


def file_name(df: DataFrame) -> Column:
    """A stored file name, else one from the slug of title and id."""
    stored, get = field(df.columns, "html_file"), lambda k: field(df.columns, k)
    made = F.concat(slug(get("title"), get("job_id"), get("category"), get("year")), F.lit(".html"))
    return F.when(stored != "", F.regexp_extract(stored, "([^/]+)$", 1)).otherwise(made)


def search_items(df: DataFrame) -> DataFrame:
    """Items of the search index: slug, address, facets, dates, image and 250 characters of description."""
    get = lambda k: squeeze(k) if k in df.columns else F.lit("")
    first = lambda *ks: F.coalesce(*(F.nullif(get(k), F.lit("")) for k in ks), F.lit(""))
    image = F.coalesce(*(F.nullif(get(k), F.lit("")) for k in ("image", "thumbnail", "featured_image")), F.lit(DEFAULT_IMAGE))
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>")) if "tags" in df.columns else F.array().cast("array<string>")
    return df.select(
        "ord", get("title").alias("title"), simple_slug(get("title")).alias("slug"), get("url").alias("url"), get("category").alias("category"),
        get("department").alias("department"), get("state").alias("state"), first("publish_date", "date").alias("publish_date"),
        first("last_date", "deadline").alias("last_date"), image.alias("image"), F.left(get("description"), F.lit(250)).alias("description"), tags.alias("keywords"),
    )


def lean_items(df: DataFrame) -> DataFrame:
    """Items of the homepage's search: no noise, the first of each page address, tags as keywords."""
    have = df.columns
    narrow = F.concat_ws(" ", field(have, "title"), field(have, "description"))
    body = F.concat_ws(" ", narrow, field(have, "url"), field(have, "source"))
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>")) if "tags" in have else F.array().cast("array<string>")
    rows = df.where((strip(field(have, "title")) != "") & ~classify.is_noise(field(have, "title"))).select(
        "ord", strip(field(have, "title")).alias("title"), file_name(df).alias("url"), classify.home_category(field(have, "category"), body, narrow).alias("category"),
        *(strip(field(have, k)).alias(k) for k in ("department", "state", "description")), tags.alias("keywords"),
    )
    return first_per_key(rows, "url")


def indexed(df: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Rows of the search index: a title that is no navigation, five characters or more, a page that exists, one of each address.

    ``files(name)`` lists the pages there are; without it all do.
    """
    title = strip(field(df.columns, "title"))
    rows = df.where(~F.lower(title).isin(*W.INDEX_NOISE) & (F.length(title) >= 5)).withColumn("page_url", file_name(df))
    rows = rows.where((F.col("page_url") != "") & ~F.col("page_url").rlike(r"^\.html$|/\.html$"))
    if files is not None:
        rows = rows.join(files.select(F.col("name").alias("page_url")).distinct(), "page_url", "left_semi")
    return first_per_key(rows, "page_url")


def post_page(df: DataFrame, as_of: str) -> DataFrame:
    """``ord, name, html``: a page for each notice that readers may see, with its details, links and status.

    Values that are no details, or are spoilt, are left out.
    """
    have = df.columns
    e, get = escape_html, lambda k: field(have, k)
    show = lambda k: records.is_detail(get(k), k) & ~records.is_corrupt(get(k))
    row = lambda k, name: F.when(show(k), F.concat(F.lit(f"<tr><th>{name}</th><td>"), e(records.clean_detail(get(k))), F.lit("</td></tr>"))).otherwise("")
    link = lambda k, name: F.when(get(k).rlike("(?i)^https?://"), F.concat(F.lit('<a href="'), e(get(k)), F.lit(f'">{name}</a>'))).otherwise("")
    names = {"vacancy": "Vacancies", "qualification": "Qualification", "salary": "Salary", "age_limit": "Age limit", "application_fee": "Fee", "selection_process": "Selection", "last_date": "Last date"}
    links = {"apply_link": "Apply", "notification_pdf": "Notification", "official_website": "Official website", "admit_card_url": "Admit card", "result_url": "Result", "answer_key_url": "Answer key", "syllabus_url": "Syllabus"}
    status = F.when(dates.is_expired(dates.deadline(have), as_of), "Application Closed").otherwise("Active")
    kind = classify.page_type(get("title"), get("category"), get("post_type"))
    html = F.concat(
        F.lit("<!doctype html><html><head><meta charset=\"utf-8\"><title>"), e(get("title")), F.lit("</title></head><body class=\""), kind, F.lit("\"><h1>"), e(get("title")),
        F.lit("</h1><p>Published: "), e(dates.published_day(have)), F.lit(" | "), status, F.lit("</p><p>"), e(get("description")), F.lit("</p><table>"),
        *(row(k, v) for k, v in names.items()), F.lit("</table><nav>"), *(link(k, v) for k, v in links.items()), F.lit("</nav></body></html>"),
    )
    return df.where(records.is_public(have)).select("ord", file_name(df).alias("name"), html.alias("html"))


def archive_card(columns: list[str]) -> Column:
    """HTML card of a closed notice."""
    e, get = escape_html, lambda k: field(columns, k)
    published = dates.archive_day(first_given(columns, ("notification_date", "publish_date", "site_published_at")))
    last = dates.archive_day(get("last_date"))
    return F.concat(
        F.lit('<article class="card"><span>'), e(F.coalesce(F.nullif(get("category"), F.lit("")), F.lit("Archive"))), F.lit("</span><h2>"),
        e(F.coalesce(F.nullif(get("title"), F.lit("")), F.lit("Update"))), F.lit("</h2><div>Published: "), e(F.coalesce(F.nullif(published, F.lit("")), F.lit("उपलब्ध नहीं"))),
        F.when(last != "", F.concat(F.lit(" | Last Date: "), e(last))).otherwise(""), F.lit("</div><b>Application Closed</b><p>"),
        e(F.left(first_given(columns, ("summary", "description")), F.lit(500))), F.lit("</p></article>"),
    )


def structured_data(title: Column, url: Column, organisation: Column, posted: Column, last: Column) -> Column:
    """schema.org JSON of a notice; empty dates are left out."""
    none = lambda c: F.nullif(c, F.lit(""))
    return F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"), F.lit("JobPosting").alias("@type"), title.alias("title"), url.alias("url"),
            F.struct(F.lit("Organization").alias("@type"), organisation.alias("name")).alias("hiringOrganization"),
            none(posted).alias("datePosted"), none(last).alias("validThrough"),
        )
    )


def breadcrumb(category: Column, page: Column, title: Column) -> Column:
    item = lambda i, name, link: F.struct(F.lit("ListItem").alias("@type"), F.lit(i).alias("position"), name.alias("name"), link.alias("item"))
    rows = F.array(item(1, F.lit("Home"), F.lit("/")), item(2, category, page), item(3, title, F.lit("")))
    return F.to_json(F.struct(F.lit("BreadcrumbList").alias("@type"), rows.alias("itemListElement")))


def card(title: Column, link: Column, description: Column, posted: Column, last: Column) -> Column:
    """HTML card of a notice on a category page."""
    e = escape_html
    return F.concat(
        F.lit('<article class="card"><h3><a href="'), e(link), F.lit('">'), e(title), F.lit("</a></h3><p>"), e(F.left(description, F.lit(420))),
        F.lit("</p><div>Posted: "), e(posted), F.lit(" | Last Date: "), e(last), F.lit("</div></article>"),
    )


def page_cards(df: DataFrame, html: Column, page: str = "page", order: str = "rank") -> DataFrame:
    """One row a page with its cards in order; pages hold a capped number of notices, so groups are bounded."""
    rows = df.withColumn("_card", F.struct(F.col(order).alias("o"), html.alias("html")))
    return rows.groupBy(page).agg(F.array_join(F.transform(F.sort_array(F.collect_list("_card")), lambda x: x["html"]), "\n").alias("html"))
