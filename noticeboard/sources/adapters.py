"""Per-site scans: links of a site's pages to notices, by the site's own title rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, dates
from ..functions import wordlists as W
from ..functions.text import clean, has_any, squeeze, text
from ..operators.dedupe import first_per_key

# For each adapter what a title must and must not contain, its departments by site
# (the first where a link has another), and the least title length.
RULES = {
    "ssc": (
        ("recruitment", "selection post", "online application", "application invited", "constable", "stenographer", "junior engineer", "combined graduate", "combined higher", "translator", "phase-xiv", "phase xiv"),
        ("answer key", "result", "admit card", "response sheet", "marks", "allocation", "tentative answer", "exam date", "exam schedule"),
        {"ssc.gov.in": "SSC"}, 0,
    ),
    "upsc": (
        ("posts of", "post of", "recruitment", "assistant", "officer", "scientific", "chemist", "director", "medical", "engineer", "professor", "manager"),
        ("about", "contact", "privacy", "tender", "login", "faq", "site map", "archive"),
        {"www.upsc.gov.in": "UPSC"}, 8,
    ),
    "ibps": (
        ("crp", "recruitment", "registration from", "application for the post", "recruitment of", "officers", "assistant", "manager"),
        ("tender", "privacy", "contact", "faq", "mock test", "calendar"),
        {"www.ibps.in": "IBPS"}, 0,
    ),
    "psc": (
        ("recruitment", "vacancy", "advertisement", "notification", "apply", "online application", "posts", "civil service", "assistant engineer", "lecturer", "officer", "professor"),
        ("result", "answer key", "admit card", "syllabus", "tender", "archive", "old", "question paper"),
        {"rpsc.rajasthan.gov.in": "RPSC", "uppsc.up.nic.in": "UPPSC", "bpsc.bihar.gov.in": "BPSC", "mppsc.mp.gov.in": "MPPSC", "psc.cg.gov.in": "CGPSC", "www.jpsc.gov.in": "JPSC"}, 0,
    ),
    "railway": (
        ("cen", "centralised employment notice", "recruitment", "vacancy", "assistant loco pilot", "technician", "ntpc", "group-d", "group d", "application link", "employment notice"),
        ("answer key", "result", "admit card", "city intimation", "exam responses", "mock test", "status of application", "corrigendum-4", "corrigendum-3"),
        {"www.rrbcdg.gov.in": "Railway", "rrcrail.in": "Railway"}, 0,
    ),
    "uk": (
        ("विज्ञापन", "भर्ती", "रिक्त पद", "सीधी भर्ती", "recruitment", "notification", "advertisement", "vacancy", "online application", "आवेदन"),
        ("answer key", "result", "admit card", "document verification", "cancellation", "exam postponed", "syllabus", "preference", "driving test"),
        {"psc.uk.gov.in": "UKPSC", "sssc.uk.gov.in": "UKSSSC"}, 0,
    ),
    "generic": (
        ("recruitment", "vacancy", "notification", "advertisement", "advt", "apply", "apply online", "online application", "result", "merit list", "selection list", "score card", "answer key", "admit card", "hall ticket", "call letter", "exam", "syllabus", "scholarship", "interview", "walk in", "document verification"),
        ("about", "contact", "privacy", "policy", "feedback", "gallery", "photo", "video", "chairman", "member", "committee", "login", "register", "help", "faq", "tender", "accessibility", "site map", "notification board", "notifications notices", "work recruitments", "watch this video", "image gallery", "photo gallery", "copyright", "translate", "{{", "}}"),
        {}, 6,
    ),
}


def wanted(name: str, title: Column | str, url: Column | str) -> Column:
    """Whether a site's rule takes a link.

    The generic rule reads the address too, and takes no PDF, no pseudo-address, no title of two words or
    less and none that is or has a word of navigation.
    """
    must, never, _, least = RULES[name]
    t, u = clean(title), F.lower(text(url))
    if name == "generic":
        blob = F.concat_ws(" ", t, u)
        words = F.size(F.split(t, " ")) > 2
        chrome = t.isin(*W.GENERIC_EXACT) | has_any(t, W.GENERIC_BAD_WORDS)
        odd = u.rlike(r"^(?:javascript|mailto:|#)|\.pdf$") | (u == "")
        return (F.length(t) >= least) & words & has_any(blob, must) & ~has_any(blob, never) & ~chrome & ~odd
    return (t != "") & (F.length(t) >= least) & has_any(t, must) & ~has_any(t, never)


#: The part of a page whose links the generic scan reads: the first of these that the page has.
REGIONS = (
    r"(?is)<article\b[^>]*>(.*?)</article>", r"(?is)<main\b[^>]*>(.*?)</main>", r"""(?is)<div\b[^>]*class\s*=\s*["'](?:[^"']*\s)?content(?:\s[^"']*)?["'][^>]*>(.*)</div>""",
    r"""(?is)<div\b[^>]*class\s*=\s*["'](?:[^"']*\s)?container(?:\s[^"']*)?["'][^>]*>(.*)</div>""", r"(?is)<body\b[^>]*>(.*)</body>",
)


def main_region(html: Column | str) -> Column:
    """The page's main part, for :func:`links.anchors`; empty without a body."""
    h = text(html)
    return F.coalesce(*(F.nullif(F.regexp_extract(h, p, 1), F.lit("")) for p in REGIONS), F.lit(""))


def by_rule(name: Column, make) -> Column:
    """One CASE over the adapter's name: ``make(rule)`` for each of the rules."""
    out = F.when(F.lit(False), make("generic"))
    for rule in RULES:
        out = out.when(name == rule, make(rule))
    return out


# Sources whose adapter reads pages of its own, whatever their address: by name, then department and page.
ENTRY_PAGES = {
    "uk": {
        "ukpsc": ("UKPSC", "https://psc.uk.gov.in/candidate-corner/recruitment"),
        "uksssc": ("UKSSSC", "https://sssc.uk.gov.in/recruitment-notification/"),
    },
}


def entry_pages(sources: DataFrame) -> DataFrame:
    """``name, adapter, page_url, department`` of the pages where a scan of ``sources(name, url, adapter)`` begins.

    A source of an adapter with pages of its own is routed by its name, in any case: to the page of that name, or to all of them, in
    order, if none has it. Any other source begins at its address. Rows without an adapter are generic; a given ``department`` stays.
    """
    kind, given = F.coalesce(F.nullif(text("adapter"), F.lit("")), F.lit("generic")), text("department") if "department" in sources.columns else F.lit("")
    at = lambda page, label: F.struct(page.alias("page_url"), label.alias("department"))
    starts = F.when(F.lit(False), F.array(at(text("url"), given)))
    for rule, pages in ENTRY_PAGES.items():
        fixed = {name: at(F.lit(page), F.lit(label)) for name, (label, page) in pages.items()}
        for name, start in fixed.items():
            starts = starts.when((kind == rule) & (F.lower(text("name")) == name), F.array(start))
        starts = starts.when(kind == rule, F.array(*fixed.values()))
    rows = sources.select("name", kind.alias("adapter"), F.explode(starts.otherwise(F.array(at(text("url"), given)))).alias("_at"))
    return rows.select("name", "adapter", "_at.*")


def department(rule: str) -> Column:
    """The department of a link's site, by host; the rule's first where a link has another.

    Where an adapter has pages of its own, the department that :func:`entry_pages` gave a link goes first.
    """
    sites = RULES[rule][2]
    if rule in ENTRY_PAGES:
        label = by_host(sites)
        return F.when(text("department").isin(*(d for d, _ in ENTRY_PAGES[rule].values())), F.col("department")).otherwise(label)
    if rule == "generic":
        return F.coalesce(F.nullif(text("department"), F.lit("")), F.lit("Government"))
    return by_host(sites)


def by_host(sites: dict[str, str]) -> Column:
    host = F.regexp_extract(text("page_url"), r"^[a-z]+://([^/?#]+)", 1)
    label = F.lit(next(iter(sites.values())))
    for site, value in sites.items():
        label = F.when(host == site, value).otherwise(label)
    return label


def scan_rules(links: DataFrame) -> DataFrame:
    """``adapter, ord, title, url, department, category, notification_pdf`` of the links that their adapter's rule takes.

    ``links(adapter, ord, page_url, title, url)``, with the source's ``department`` where it is known, are read
    once, whatever the number of adapters. The first of each title and address of an adapter stays. A UK link to a
    document is its own notification.
    """
    if "department" not in links.columns:
        links = links.withColumn("department", F.lit(""))
    rule = F.col("adapter")
    pdf = (rule == "uk") & F.lower("url").rlike(r"\.pdf$|/document/")
    rows = links.where(by_rule(rule, lambda r: wanted(r, "title", "url"))).select(
        "adapter", "ord", squeeze("title").alias("title"), "url", by_rule(rule, department).alias("department"),
        F.when(rule == "generic", classify.generic_category("title")).otherwise("Latest Jobs").alias("category"),
        F.when(pdf, F.col("url")).otherwise("").alias("notification_pdf"),
    )
    return first_per_key(rows, "adapter", F.lower("title"), F.lower("url"))


def notices_of(name: str, links: DataFrame) -> DataFrame:
    """:func:`scan_rules` of one adapter over all links."""
    return scan_rules(links.withColumn("adapter", F.lit(name))).drop("adapter")


NUMBER = r"(?i)advertisement\s*no\s*[:.]?\s*([A-Z0-9][A-Z0-9/\-]{3,60})"
DAY = r"(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})"


def cards(pages: DataFrame, block: str = "div") -> DataFrame:
    """Opening cards of a careers page: ``page_id, advertisement_no, title, start, last``, the first of each number.

    A card is a block of at most 4,500 characters with an advertisement number and a recruitment word.
    """
    parts = F.split(F.regexp_replace(text("html"), r"(?is)<(script|style)\b.*?</\1>", ""), rf"(?i)<{block}\b[^>]*>")
    rows = pages.select("page_id", F.posexplode(parts).alias("pos", "part"))
    rows = rows.withColumn("body", squeeze(F.regexp_replace("part", r"(?s)<[^>]*>", " ")))
    good = (F.length("body") <= 4500) & F.col("body").rlike(NUMBER) & has_any(F.lower("body"), ("recruitment", "engagement", "apprentice", "vacancy"))
    rows = rows.where(good).withColumn("advertisement_no", F.regexp_extract("body", NUMBER, 1))
    before = F.regexp_replace(F.split("body", r"(?i)advertisement\s*no\s*[:.]?", 2)[0], rf"(?i)last\s+date\s+to\s+apply\s*[:\-]?\s*{DAY}", " ")
    span = rf"(?i)from\s+{DAY}\s+to\s+{DAY}"
    last = F.when(F.col("body").rlike(span), F.regexp_extract("body", span, 2)).otherwise(F.regexp_extract("body", rf"(?i)last\s+date\s+to\s+apply\s*[:\-]?\s*{DAY}", 1))
    rows = rows.select("page_id", "pos", "advertisement_no", F.left(squeeze(before), F.lit(500)).alias("title"), F.regexp_extract("body", span, 1).alias("start"), last.alias("last"))
    kept = first_per_key(rows.withColumn("ord", F.struct("page_id", "pos")), "page_id", "advertisement_no")
    return kept.select("page_id", "advertisement_no", "title", dates.adapter("start").alias("start"), dates.adapter("last").alias("last"))


def best_text(columns: list[Column], quality: list[Column], least: int = 120, good: float = 0.72) -> Column:
    """The text of best quality of those long enough, the first of equals, else empty.

    A text that is not good, or whose words are short beyond a quarter of them, gives way to the
    last column, where recognised characters stand.
    """
    ranked = [F.struct(q.alias("q"), F.lit(-i).alias("o"), t.alias("t")) for i, (t, q) in enumerate(zip(columns, quality))]
    top = F.array_max(F.filter(F.array(*ranked), lambda x: F.length(x["t"]) >= least))
    words = F.split(squeeze(top["t"]), " ")
    short = F.size(F.filter(words, lambda w: F.length(w) <= 2)) > 0.25 * F.size(words)
    poor = (top["q"] < good) | short
    last = F.when(F.length(columns[-1]) >= least, columns[-1])
    return F.coalesce(F.when(poor, last), top["t"], F.lit(""))
