"""Pages to rows: anchors, visible text and link choice, from HTML by regular expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import wordlists as W
from ..functions.text import clean_url, has_any, squeeze, text
from . import dedupe

ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
HIDDEN = r"(?is)<(script|style|header|footer|nav|aside|noscript|form)\b.*?</\1>|<!--.*?-->"


def unescape(x: Column) -> Column:
    out = x
    for old, new in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def inner_text(x: Column) -> Column:
    return squeeze(unescape(F.regexp_replace(x, r"(?s)<[^>]*>", " ")))


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row for each link of each page: ``pos`` (from 0), ``href`` as written, ``title``, and the page's other columns.

    Scripts, styles and comments are cut out first. Whole anchors are searched once; address and text
    are read from each. Pages without links or HTML give no rows.
    """
    plain = F.regexp_replace(text(html), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    rest = [c for c in pages.columns if c != html]
    rows = pages.select(*rest, F.posexplode(F.regexp_extract_all(plain, F.lit(ANCHOR), 0)).alias("pos", "_a"))
    href, body = (F.regexp_extract("_a", ANCHOR, i) for i in (1, 2))
    return rows.select(*rest, "pos", href.alias("href"), inner_text(body).alias("title"))


def resolve(base: Column, href: Column) -> Column:
    """Absolute address of a link: full, protocol-relative, rooted or relative; pseudo-schemes give null."""
    h = F.trim(href)
    root = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^([a-z]+://[^/?#]+(?:/[^?#]*)?)", 1), r"(://[^/]+(?:/.*)?)/[^/]*$", "$1")
    full = (
        F.when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-z]+:)", 1), h))
        .when(h.startswith("/"), F.concat(root, h))
        .otherwise(F.concat(folder, F.lit("/"), h))
    )
    return clean_url(F.when(h == "", "").otherwise(full))


def page_text(html: Column | str) -> Column:
    """Visible text of the article, else main, else a content division, else the body, else the page."""
    bare = F.regexp_replace(text(html), HIDDEN, " ")
    part = lambda p: F.nullif(F.regexp_extract(bare, p, 1), F.lit(""))
    region = F.coalesce(
        part(r"(?is)<article\b[^>]*>(.*?)</article>"),
        part(r"(?is)<main\b[^>]*>(.*?)</main>"),
        part(r"""(?is)<div\b[^>]*class\s*=\s*["'][^"']*(?:content|entry|post)[^"']*["'][^>]*>(.*?)</div>"""),
        part(r"(?is)<body\b[^>]*>(.*?)</body>"),
        bare,
    )
    return inner_text(region)


def is_html(html: Column | str) -> Column:
    return text(html).rlike(r"(?i)<html\b") & text(html).rlike(r"(?i)<body\b")


def link_score(title: Column | str, url: Column | str) -> Column:
    """Ten for each keyword of title and address, five for a PDF."""
    blob = F.lower(F.concat_ws(" ", text(title), text(url)))
    return sum((F.when(blob.contains(k), 10).otherwise(0) for k in W.LINK_KEYWORDS), F.when(text(url).endswith(".pdf"), 5).otherwise(0))


def action_score(title: Column | str, url: Column | str, keywords: Sequence[str]) -> Column:
    blob = F.lower(F.concat_ws(" ", text(title), text(url)))
    return sum((F.when(blob.contains(k), 10).otherwise(0) for k in keywords), F.when(F.lower(text(url)).endswith(".pdf"), -2).otherwise(0))


def apply_score(title: Column | str) -> Column:
    t = F.lower(text(title))
    return F.when(has_any(t, W.APPLY_TEXTS), 10).when(t.contains("apply"), 5).otherwise(0)


def is_advertisement(blob: Column) -> Column:
    return ~has_any(blob, W.NOT_ADVERTISEMENT) & has_any(blob, W.ADVERTISEMENT)


def pdf_score(title: Column | str, around: Column | str, url: Column | str) -> Column:
    t, u = F.lower(text(title)), F.lower(text(url))
    blob = F.concat_ws(" ", t, F.lower(text(around)), u)
    add = lambda test, n: F.when(test, n).otherwise(0)
    return (
        add(F.split_part(u, F.lit("#"), F.lit(1)).endswith(".pdf"), 10)
        + add(u.contains("loadpdf.php"), 6)
        + add(is_advertisement(blob), 18)
        + add(has_any(blob, W.PDF_STRONG), 10)
        + add(has_any(blob, W.PDF_WEAK), -25)
        + add(has_any(t, ("download", "view", "click here")), 2)
    )


def best_link(links: DataFrame, page: str, score: Column, least: int = 1) -> DataFrame:
    """The highest-scored link of each page, the first of equals: an aggregate, combined before the shuffle."""
    scored = links.withColumn("score", score).where(F.col("score") >= least)
    best = scored.groupBy(page).agg(F.max_by(F.struct("url", "title", "score", "pos"), F.struct("score", -F.col("pos"))).alias("b"))
    return best.select(page, "b.*")


def best_pdf(links: DataFrame, page: str, least: int = 8) -> DataFrame:
    """``page, url, score``: each page's likeliest advertisement of ``links(page, pos, title, around, url)``.

    Of equal scores the link with more text around it, then the earlier one.
    """
    size = F.length(F.concat_ws(" ", F.lower(text("title")), F.lower(text("around")), F.lower(text("url"))))
    scored = links.where(text("url") != "").withColumns({"score": pdf_score("title", "around", "url"), "_size": size}).where(F.col("score") >= least)
    best = scored.groupBy(page).agg(F.max_by(F.struct("url", "score"), F.struct("score", "_size", -F.col("pos"))).alias("b"))
    return best.select(page, "b.*")


def first_link(links: DataFrame, page: str, test: Column) -> DataFrame:
    """The address of each page's first link that passes the test: ``page, url``."""
    return links.where(test).groupBy(page).agg(F.min_by("url", "pos").alias("url"))


def first_pdf(links: DataFrame, page: str) -> DataFrame:
    return first_link(links, page, F.lower(text("url")).endswith(".pdf"))


def apply_link(links: DataFrame, page: str) -> DataFrame:
    """The best apply link of each page, the first of equals: ten for its phrases, five for "apply"."""
    return best_link(links, page, apply_score("title")).select(page, "url")


def first_apply_link(links: DataFrame, page: str) -> DataFrame:
    """The older rule: the first link whose text has an apply word."""
    return first_link(links, page, has_any(F.lower(text("title")), ("apply", "registration", "online application")))


def page_details(pages: DataFrame) -> DataFrame:
    """``page_id, description`` (300 characters) and the page's first links by kind, empty where there is none.

    A page that is itself a PDF is its own notification and is not read.
    """
    pdf = F.lower(text("url")).endswith(".pdf")
    rows = anchors(pages.where(~pdf).select("page_id", F.col("url").alias("page_url"), "html"))
    rows = rows.withColumn("url", resolve(F.col("page_url"), F.col("href"))).where("url IS NOT NULL")
    hay, t = F.lower(F.concat_ws(" ", "title", "url")), F.lower(text("title"))
    tests = {"notification_pdf": F.lower("url").endswith(".pdf"), "apply_link": has_any(t, ("apply", "registration", "online application"))}
    tests |= {name: has_any(hay, terms) for name, terms in W.ACTION_LINKS.items()}
    found = rows.groupBy("page_id").agg(*(F.min_by(F.when(test, F.col("url")), F.when(test, F.col("pos"))).alias(name) for name, test in tests.items()))
    told = F.when(pdf, "Official recruitment notification is available in PDF.").otherwise(F.left(page_text("html"), F.lit(300)))
    out = pages.select("page_id", told.alias("description"), F.when(pdf, F.col("url")).alias("_own")).join(found, "page_id", "left")
    links = {name: F.coalesce(F.col("_own") if name == "notification_pdf" else F.lit(None), F.col(name), F.lit("")) for name in tests}
    return out.select("page_id", "description", *(c.alias(name) for name, c in links.items()))


META = r"(?is)<meta\b[^>]*>"
META_KEY = r"(?is)(?:property|name|itemprop)\s*=\s*[\"'][^\"']*(?:article:published_time|datepublished|publish[-_]?date)[^\"']*[\"']"


def published(html: Column | str, title: Column | str = "") -> Column:
    """Publication date as written: a labelled advertisement date of title and text, a time element, a meta tag; else empty.

    The attributes of a meta tag may stand in either order.
    """
    h = text(html)
    said = F.concat_ws(" ", F.lit(title) if isinstance(title, str) and not title else text(title), page_text(html))
    metas = F.filter(F.regexp_extract_all(h, F.lit(META), 0), lambda m: m.rlike(META_KEY) & m.rlike(r"(?is)content\s*=\s*[\"'][^\"']+[\"']"))
    tries = (
        F.regexp_extract(said, dates.ADVERTISED, 1),
        F.left(F.regexp_extract(h, r"""(?is)<time\b[^>]*datetime\s*=\s*["']([^"']*\d{4}[^"']*)["']""", 1), F.lit(30)),
        F.regexp_extract(F.coalesce(F.get(metas, F.lit(0)), F.lit("")), r"""(?is)content\s*=\s*["']([^"']+)["']""", 1),
    )
    return F.coalesce(*(F.nullif(F.trim(x), F.lit("")) for x in tries), F.lit(""))


def domain(url: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(text(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1)), r"^www\.", "")


def card_tokens(title: Column | str) -> Column:
    """Words of a title that tell which notice a link belongs to: three letters or more, no common word."""
    words = F.regexp_extract_all(F.lower(text(title)), F.lit("[a-z0-9]{3,}|[\u0900-\u097F]{3,}"), 0)
    return F.filter(words, lambda w: ~w.isin(*W.CARD_STOPWORDS))


def _card_blob(label: Column | str, context: Column | str, url: Column | str) -> Column:
    return F.lower(F.concat_ws(" ", text(label), text(context), text(url)))


def _card_points(words: Column, blob: Column, url: Column, same_site: Column) -> Column:
    """A card link's score; terms are searched as they are, which takes a fraction of an alternation's time on short texts."""
    has = lambda x, terms: reduce(or_, (F.contains(x, F.lit(t)) for t in terms))
    hits = F.size(F.filter(words, lambda w: F.contains(blob, w)))
    add = lambda test, n: F.when(test, n).otherwise(0)
    return (
        8 * F.least(hits, F.lit(6)) + 4 * F.least(hits, F.lit(8)) + add(same_site, 8) + add(F.split_part(url, F.lit("#"), F.lit(1)).endswith(".pdf"), 45)
        + add(has(blob, W.CARD_ADVERTISEMENT), 24) + add(has(blob, W.CARD_DOCUMENT), 8) + add(has(blob, W.CARD_OTHER), -30) + add(has(blob, W.CARD_CHROME), -40)
        + add(has(url, W.CARD_PATHS), 18) + add(has(blob, W.CARD_STRONG), 22) + add(has(blob, W.CARD_APPLY), 5) + add(has(blob, W.CARD_WRONG), -35)
    )


def card_score(title: Column | str, label: Column | str, context: Column | str, url: Column | str, root: Column | str) -> Column:
    """How likely a link of a card leads to the notice of the title."""
    return _card_points(card_tokens(title), _card_blob(label, context, url), F.lower(text(url)), domain(url) == domain(root))


def card_links(rows: DataFrame, most: int = 24) -> DataFrame:
    """``ord, url, label, score, rank``: each notice's ``most`` likeliest links of ``rows(ord, title, label, context, url, root)``.

    A link counts once whatever its fragment, by its best score, then its longer address; scores under 8 go.
    """
    given = rows.where((text("url") != "") & ~F.lower(text("url")).rlike("^(?:javascript:|mailto:|tel:|#)"))
    told = given.select("ord", "url", "label", card_tokens("title").alias("_words"), _card_blob("label", "context", "url").alias("_blob"), F.lower(text("url")).alias("_low"), (domain("url") == domain("root")).alias("_same"))
    scored = told.select("ord", "url", "label", _card_points(F.col("_words"), F.col("_blob"), F.col("_low"), F.col("_same")).alias("score"))
    enough = F.col("score") >= 8  # in the aggregate: a filter would tell the score once more
    best = F.max_by(F.struct("url", "label", "score"), F.when(enough, F.struct("score", F.length("url"), "url")))
    kept = scored.groupBy("ord", F.split_part("url", F.lit("#"), F.lit(1)).alias("_bare")).agg(best.alias("b")).where("b IS NOT NULL").select("ord", "b.*")
    return dedupe.top_per_group(kept, "ord", [F.desc("score"), F.desc(F.length("url")), F.col("url")], most)


def verified_pdfs(links: DataFrame, start: DataFrame, depth: int = 3, pages: int = 8) -> DataFrame:
    """``src, pdf, hops``: of each start the nearest PDF, then the likeliest; ``links(src, dst, score)``, ``start(src)``.

    A start follows at most ``pages`` pages a hop, those of its best links, ``depth`` hops deep.
    """
    edges = links.groupBy(F.col("src").alias("at"), "dst").agg(F.max("score").alias("score"))
    frontier = start.select("src", F.col("src").alias("at")).distinct()
    seen, found = frontier, None
    is_pdf = F.lower(F.split_part("dst", F.lit("#"), F.lit(1))).rlike(r"\.pdf($|\?)")
    for hop in range(1, depth + 1):
        met = frontier.join(edges, "at").groupBy("src", "dst").agg(F.max("score").alias("score"))
        pdfs = met.where(is_pdf).groupBy("src").agg(F.max_by("dst", F.struct("score", "dst")).alias("pdf"), F.lit(hop).alias("hops"))
        found = pdfs if found is None else found.unionByName(pdfs)
        ahead = met.where(~is_pdf).select("src", F.col("dst").alias("at"), "score").join(seen, ["src", "at"], "left_anti")
        frontier = dedupe.top_per_group(ahead, "src", [F.desc("score"), F.col("at")], pages).select("src", "at")
        seen = seen.unionByName(frontier)
    return found.groupBy("src").agg(F.min_by("pdf", "hops").alias("pdf"), F.min("hops").alias("hops"))


def reachable(links: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """``src, dst, hops``: addresses at most ``depth`` links away; ``links(src, dst)``, ``start(src)``."""
    frontier = start.select("src", F.col("src").alias("dst"), F.lit(0).alias("hops"))
    seen = frontier
    edges = links.select(F.col("src").alias("dst"), F.col("dst").alias("next")).distinct()
    for hop in range(1, depth + 1):
        frontier = frontier.join(edges, "dst").select("src", F.col("next").alias("dst"), F.lit(hop).alias("hops")).distinct()
        frontier = frontier.join(seen.select("src", "dst"), ["src", "dst"], "left_anti")
        seen = seen.unionByName(frontier)
    return seen
