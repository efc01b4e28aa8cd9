"""Elements of pages as nested intervals, and what surrounds a link or a mark: cards with their links, contexts of links."""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import has_any, text
from . import links

# Elements without an end, elements whose content is no markup, elements that end when one like them or their list's next begins.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
RAW = ("script", "style")
BLOCKS = ("li", "tr", "td", "p", "div", "section", "article", "dd", "blockquote")
CARD_WORDS = ("recruitment", "engagement", "apprentice", "vacancy")
DOCUMENT_WORDS, APPLY_WORDS = ("advertisement",), ("apply online", "apply now", "online registration")
TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
#: An element counts as a card's block up to this many characters of text, within so many ancestors.
MOST, LEVELS = 4500, 8
#: Pages whose elements a worker holds as Python's at once.
AT_ONCE = 50


def intervals(html: str) -> list[dict]:
    """``tag, start, stop`` of all elements, in order of their starts: one pass with a stack of open tags.

    An end tag closes the nearest open element of its name and all inside it; one without such an element is left out.
    Elements that are still open end with the page. Offsets count characters; ``stop`` is behind the end tag.
    """
    out, stack, at = [], [], 0
    open_of: dict[str, int] = {}
    while m := TAG.search(html, at):
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if not open_of.get(tag):
                continue
            while True:
                i = stack.pop()
                open_of[out[i]["tag"]] -= 1
                if out[i]["tag"] == tag:
                    out[i]["stop"] = m.end()
                    break
                out[i]["stop"] = m.start()
        else:
            out.append({"tag": tag, "start": m.start(), "stop": m.end()})
            if tag in VOID or m[3].rstrip().endswith("/"):
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = out[-1]["stop"] = end.end() if end else len(html)
                continue
            stack.append(len(out) - 1)
            open_of[tag] = open_of.get(tag, 0) + 1
    for i in stack:
        out[i]["stop"] = len(html)
    return out


@cache
def _intervals():
    kind = pa.list_(pa.struct([("tag", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def told(pages: pa.Array) -> pa.Array:
        """Elements are Python's for a few pages at a time, whatever the batch."""
        done = [pa.array([intervals(h or "") for h in pages.slice(at, AT_ONCE).to_pylist()], kind) for at in range(0, len(pages), AT_ONCE)]
        return pa.concat_arrays(done) if done else pa.array([], kind)

    kinds = StructType([StructField("tag", StringType()), StructField("start", IntegerType()), StructField("stop", IntegerType())])
    return F.arrow_udf(told, ArrayType(kinds))


def elements(html: Column | str) -> Column:
    return _intervals()(text(html))


def around(found: Column, at: Column, tags: tuple[str, ...] | None = None) -> Column:
    """The elements around a place, the innermost first; elements nest, so those that start later lie inside."""
    holds = lambda e: (e["start"] <= at) & (at < e["stop"])
    kept = F.filter(found, holds if tags is None else lambda e: holds(e) & e["tag"].isin(*tags))
    return F.reverse(kept)


def part(html: Column, element: Column) -> Column:
    return F.substr(html, element["start"] + 1, element["stop"] - element["start"])


def bare_text(html: Column) -> Column:
    return links.inner_text(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "))


def link_contexts(pages: DataFrame, most: int = MOST) -> DataFrame:
    """``page_id, pos, tag, href, label, context``: each link with the text of the smallest block element around it, cut to ``most``.

    A link outside of any block has no tag and an empty context. Pages without HTML have no links.
    """
    rows = pages.select("page_id", text("html").alias("_h"), elements("html").alias("_e"))
    rows = rows.select("page_id", "_h", "_e", F.posexplode(F.filter("_e", lambda e: e["tag"] == "a")).alias("pos", "_a"))
    rows = rows.withColumn("_b", F.get(around(F.col("_e"), F.col("_a.start"), BLOCKS), F.lit(0)))
    own = part(F.col("_h"), F.col("_a"))
    href = F.regexp_extract(own, r"""(?is)^<a\s[^>]*?href\s*=\s*["']?([^"'\s>]*)""", 1)
    context = F.left(bare_text(part(F.col("_h"), F.col("_b"))), F.lit(most))
    return rows.select("page_id", "pos", F.col("_b.tag").alias("tag"), href.alias("href"), bare_text(own).alias("label"), F.coalesce(context, F.lit("")).alias("context")).where("href <> ''")


def card_blocks(pages: DataFrame, mark: str = r"advertisement\s*no\s*[:.]?\s*[a-z0-9/\-]+") -> DataFrame:
    """``page_id, pos, html, body``: the block of each place where ``mark`` stands in the text, each block once.

    Of the ``LEVELS`` innermost elements around the mark it is the outermost that has at most ``MOST`` characters of text, a word of
    recruitment and a link; larger ones hold several cards. A mark without such a block has none.
    """
    rows = pages.select("page_id", text("html").alias("_h"), elements("html").alias("_e"))
    ahead = F.split("_h", "(?i)(?=" + mark + ")")  # a mark starts where each but the first piece does
    starts = F.aggregate(F.slice(ahead, F.lit(1), F.size(ahead) - 1), F.array().cast("array<int>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1), F.lit(0)) + F.length(p))))
    rows = rows.where(F.size(ahead) > 1).select("page_id", "_h", "_e", F.explode(starts).alias("_at"))
    near = F.slice(F.filter(around(F.col("_e"), F.col("_at")), lambda e: ~e["tag"].isin("html", "body")), 1, LEVELS)
    rows = rows.select("page_id", F.posexplode(F.transform(near, lambda e: F.struct(e["start"].alias("start"), part(F.col("_h"), e).alias("html")))).alias("level", "_b"), "_at")
    rows = rows.select("page_id", "_at", "level", F.col("_b.start").alias("pos"), F.col("_b.html").alias("html"), bare_text(F.col("_b.html")).alias("body"))
    low = F.lower("body")
    fits = (F.length("body") <= MOST) & low.rlike("(?i)" + mark) & has_any(low, CARD_WORDS) & F.col("html").rlike(r"(?is)<a\s[^>]*href")
    best = rows.where(fits).groupBy("page_id", "_at").agg(F.max_by(F.struct("pos", "html", "body"), "level").alias("b")).select("page_id", "b.*")
    return best.dropDuplicates(["page_id", "pos"])


def cards(pages: DataFrame) -> DataFrame:
    """``page_id, pos, advertisement_no, title, start, last, pdf, apply``: the cards of careers pages with their own links.

    The document is the best of the card's: one in English, one to download, a PDF; the first of equals. ``pages`` may have a ``url``, to which links
    are resolved. The first card of each number of a page stays.
    """
    from ..functions import dates
    from ..sources import adapters
    from . import dedupe

    have_url = "url" in pages.columns
    rows = card_blocks(pages)
    base = rows.join(pages.select("page_id", "url"), "page_id") if have_url else rows.withColumn("url", F.lit(""))
    found = F.regexp_extract_all("html", F.lit(links.ANCHOR), 0)

    def link(a: Column) -> Column:
        href = links.resolve(F.col("url"), F.regexp_extract(a, links.ANCHOR, 1))
        low, to = F.lower(links.inner_text(F.regexp_extract(a, links.ANCHOR, 2))), F.lower(href)
        points = F.when(low.contains("english"), 30).otherwise(0) + F.when(low.contains("download advertisement"), 20).otherwise(0) + F.when(to.endswith(".pdf"), 10).otherwise(0)
        return F.struct(points.alias("points"), href.alias("href"), (has_any(low, DOCUMENT_WORDS) | to.endswith(".pdf") | to.contains("loadpdf")).alias("document"), has_any(low, APPLY_WORDS).alias("apply"))

    rows = base.withColumn("_l", F.filter(F.transform(found, link), lambda x: x["href"].isNotNull()))
    documents = F.filter("_l", lambda x: x["document"])
    top = F.array_max(F.transform(documents, lambda x: x["points"]))
    pdf = F.get(F.filter(documents, lambda x: x["points"] == top), F.lit(0))["href"]
    apply = F.get(F.filter("_l", lambda x: x["apply"]), F.lit(0))["href"]
    number = F.regexp_extract("body", adapters.NUMBER, 1)
    before = F.regexp_replace(F.split("body", r"(?i)advertisement\s*no\s*[:.]?", 2)[0], rf"(?i)last\s+date\s+to\s+apply\s*[:\-]?\s*{adapters.DAY}", " ")
    span = rf"(?i)from\s+{adapters.DAY}\s+to\s+{adapters.DAY}"
    last = F.when(F.col("body").rlike(span), F.regexp_extract("body", span, 2)).otherwise(F.regexp_extract("body", rf"(?i)last\s+date\s+to\s+apply\s*[:\-]?\s*{adapters.DAY}", 1))
    out = rows.select(
        "page_id", "pos", number.alias("advertisement_no"), F.left(F.trim(F.regexp_replace(before, r"\s+", " ")), F.lit(500)).alias("title"),
        dates.adapter(F.regexp_extract("body", span, 1)).alias("start"), dates.adapter(last).alias("last"), F.coalesce(pdf, F.lit("")).alias("pdf"), F.coalesce(apply, F.lit("")).alias("apply"),
    )
    kept = dedupe.first_per_key(out.where("advertisement_no <> ''").withColumn("ord", F.struct("page_id", "pos")), "page_id", F.lower("advertisement_no"))
    return kept.select(out.columns)


def crawl(edges: DataFrame, start: DataFrame, depth: int = 3, pages: int = 8, tried: int = 8, least: int = 10) -> DataFrame:
    """``src, page, pdf, hops, visit``: the document that a bounded search from each start finds first; ``edges(src, dst, score)``, ``start(src)``.

    Each start opens at most ``pages`` pages in all, in the order of a queue: by hop, then the page that named them, then the rank of
    the link there (score, longer address, address). An address is opened once. Of an opened page the ``tried`` best links may be its document; links of
    ``least`` points or more are followed, ``depth`` hops deep. A start without a document has no row.
    """
    from . import dedupe

    known = edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy(F.col("src").alias("at"), "dst").agg(F.max("score").alias("score"))
    ranked = dedupe.top_per_group(known, "at", [F.desc("score"), F.desc(F.length("dst")), F.col("dst")], 1 << 30)
    is_pdf = F.lower(F.split_part("dst", F.lit("#"), F.lit(1))).endswith(".pdf")
    opened = start.where("src IS NOT NULL").select("src", F.col("src").alias("at"), F.lit(1).alias("visit"), F.lit(0).alias("hops")).distinct()
    frontier = opened
    for hop in range(1, depth + 1):
        met = frontier.join(ranked.where(~is_pdf & (F.col("score") >= least)), "at").select("src", F.col("dst").alias("at"), F.struct("visit", "rank").alias("turn"))
        new = met.groupBy("src", "at").agg(F.min("turn").alias("turn")).join(opened.select("src", "at"), ["src", "at"], "left_anti")
        used = opened.groupBy("src").agg(F.max("visit").alias("used"))
        new = dedupe.top_per_group(new, "src", [F.col("turn")], pages).join(used, "src")
        frontier = new.select("src", "at", (F.col("used") + F.col("rank")).cast("int").alias("visit"), F.lit(hop).alias("hops")).where(F.col("visit") <= pages)
        opened = opened.unionByName(frontier)
    found = opened.join(ranked.where(is_pdf & (F.col("rank") <= tried)), "at")
    best = F.min_by(F.struct(F.col("at").alias("page"), F.col("dst").alias("pdf"), "hops", "visit"), F.struct("visit", "rank"))
    return found.groupBy("src").agg(best.alias("b")).select("src", "b.*")
