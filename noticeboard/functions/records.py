"""Whole notice records: derived fields, re-validation, validity and activity tests.

Columns that a table lacks count as empty. Days come in as arguments.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import classify, dates
from . import wordlists as W
from .text import has_any, key_text, literal, placeholder, spaced, squeeze, strip, text, whole_words


def field(columns: Iterable[str], name: str) -> Column:
    """A text column, empty where the table has none."""
    return text(name) if name in columns else F.lit("")


def words_of(columns: Iterable[str], names: Iterable[str]) -> Column:
    """The fields that are there and not empty, with spaces between; arrays give their members."""
    return F.concat_ws(" ", *(F.nullif(F.concat_ws(" ", F.col(n)), F.lit("")) for n in names if n in columns))


def first_given(columns: Iterable[str], names: Iterable[str]) -> Column:
    """The first field that is not empty, else the empty string."""
    return F.coalesce(*(F.nullif(strip(n), F.lit("")) for n in names if n in columns), F.lit(""))


def tags(columns: Iterable[str]) -> Column:
    """Sorted distinct normalised words of three characters or more, of title, facets and the title's year."""
    parts = [field(columns, k) for k in ("title", "category", "department", "source", "state")]
    words = F.split(F.concat_ws(" ", *parts, dates.year(field(columns, "title"))), r"\s+")
    return F.array_sort(F.array_distinct(F.filter(F.transform(words, key_text), lambda w: F.length(w) >= 3)))


def keywords(title: Column | str) -> Column:
    """The title alone and with each search ending, in order; none without a title."""
    t = strip(title)
    forms = F.array(t, *(F.concat(t, F.lit(" " + ending)) for ending in W.KEYWORD_ENDINGS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.array_distinct(forms))


def _job_id(title: Column, url: Column) -> Column:
    return F.md5(F.concat_ws("|", key_text(title), key_text(url)))


def _derived(df: DataFrame, category: Column, trim: bool) -> dict[str, Column]:
    """Fields that a classified record takes from the rules; the rest keeps what it has."""
    have = df.columns
    title, url = strip("title"), strip("url")
    body = F.concat_ws(" ", *(field(have, k) for k in ("title", "description", "content", "url")))
    out = {
        "category": category, "post_type": category, "is_valid_post": F.lit(True), "job_id": _job_id(title, url),
        "department": classify.department(field(have, "source"), body, field(have, "department")), "year": dates.year(title),
    }
    return out | ({"title": title, "url": url} if trim else {})


def optimise(df: DataFrame) -> DataFrame:
    """Records with category, id, department, year, publication date, tags and keywords; ``is_valid_post`` tells the others.

    The publication date is the source's own where it gives one, else what the record has; it is never the day of the run.
    """
    have = df.columns
    found = classify.classify_post(strip("title"), strip("url"), field(have, "description"))
    rows = df.withColumn("_kind", found)
    valid = F.col("_kind").isNotNull()
    made = _derived(df, F.col("_kind"), trim=False)
    made["publish_date"] = F.coalesce(F.nullif(first_given(have, W.SOURCE_DATES), F.lit("")), field(have, "publish_date"))
    old = lambda k: F.col(k) if k in have else F.lit(None)
    rows = rows.withColumns({k: F.when(valid, v).otherwise(old(k)) for k, v in made.items() if k != "is_valid_post"} | {"is_valid_post": valid})
    more = {"tags": tags(rows.columns), "keywords": keywords("title")}
    return rows.withColumns({k: F.when(valid, v).otherwise(old(k)) for k, v in more.items()}).drop("_kind")


def revalidate(df: DataFrame) -> DataFrame:
    """Stored records judged anew: what the classifier rejects goes, identity, department and year are made again.

    A missing publication date is filled with the first ten characters of another date of the record.
    """
    have = df.columns
    rows = df.withColumn("_kind", classify.classify_post(strip("title"), strip("url"), field(have, "description"))).where("_kind IS NOT NULL")
    made = _derived(df, F.col("_kind"), trim=True)
    other = F.left(first_given(have, ("date", "posted_date", "scraped_at")), F.lit(10))
    made["publish_date"] = F.coalesce(F.nullif(field(have, "publish_date"), F.lit("")), other)
    return rows.withColumns(made).drop("_kind")


def is_complete(columns: Iterable[str]) -> Column:
    """Title, address and id are there and the record is marked valid."""
    given = F.lit(True)
    for k in ("title", "url", "job_id"):
        given = given & (field(columns, k) != "")
    return given & F.coalesce(F.col("is_valid_post"), F.lit(False)) if "is_valid_post" in columns else F.lit(False)


def validate(df: DataFrame, as_of: str) -> DataFrame:
    """Complete records whose last date, if it is readable, has not passed."""
    return df.where(is_complete(df.columns) & ~dates.is_expired(dates.strict(field(df.columns, "last_date")), as_of))


# Activity.

def deadline_of(columns: Iterable[str], texts: Iterable[str] = ("title", "description", "content", "summary", "last_date")) -> Column:
    """The first readable deadline column, else a date right behind a deadline label in the texts."""
    have = list(columns)
    return F.coalesce(dates.deadline(have, read=dates.anywhere), dates.labelled_deadline(words_of(have, texts)))


def is_closed(columns: Iterable[str], as_of: str) -> Column:
    """Expired: a deadline column says so in words, else the deadline has passed."""
    said = words_of(columns, dates.DEADLINES)
    return said.rlike(W.CLOSED_PATTERN) | dates.is_expired(deadline_of(columns), as_of)


def is_active(columns: Iterable[str], as_of: str) -> Column:
    """Neither navigation noise nor expired."""
    return ~classify.is_noise(field(columns, "title")) & ~is_closed(columns, as_of)


def is_fresh(columns: Iterable[str], as_of: str) -> Column:
    """No noise, and by the first that is known: deadline, year, a date of the last 90 days, a publication of the last 120."""
    have = list(columns)
    title = F.lower(squeeze(field(have, "title")))
    noise = (title == "") | title.isin(*W.PAGE_NOISE)
    told = words_of(have, ("title", "year", "tags", "keywords"))
    seen = [dates.anywhere(k) for k in ("scraped_at", *W.PUBLICATION_DATES) if k in have]
    none = F.lit(None).cast("date")
    return ~noise & dates.is_fresh(deadline_of(have), told, F.coalesce(*seen, none), none, as_of)


def is_public(columns: Iterable[str]) -> Column:
    """Shown to readers: a title that is no navigation, a known category, not marked invalid, and the gate for a model's text."""
    have = list(columns)
    title, category = F.lower(strip(field(have, "title"))), F.lower(strip(field(have, "category")))
    marked = F.coalesce(F.col("is_valid_post"), F.lit(True)) if "is_valid_post" in have else F.lit(True)
    written = F.lit(False)
    if "ai_generated" in have:
        written = written | F.coalesce(F.col("ai_generated").cast("boolean"), F.lit(False))
    if "ai_model" in have:
        written = written | (text("ai_model") != "")
    gate = classify.is_publishable({k: F.col(k) for k in have})
    return (title != "") & ~title.isin(*W.PAGE_NOISE) & (category != "unknown") & marked & (~written | F.coalesce(gate, F.lit(False)))


# Details.

def clean_detail(x: Column | str) -> Column:
    """White space squeezed, leading separators and trailing bars gone."""
    out = F.regexp_replace(squeeze(x), r"^[|:;,\-–—\s]+", "")
    return strip(F.regexp_replace(out, r"[|;]+\s*$", ""))


@dataclass(frozen=True)
class Needs:
    """What a detail field asks of a value: its length, traits of which it must hold one of each group, traits that it must lack."""

    least: int = 0
    most: int | None = None
    holds: tuple[tuple[str, ...], ...] = ()
    lacks: tuple[str, ...] = ()


#: Traits of values, as patterns over the lower-case value.
TRAITS = {
    "digit": r"\d",
    "plain number": r"(?<![\d/.-])\d{1,6}(?![\d/.-])",
    "whole number": r"\b\d{1,6}\b",
    "currency": "|".join(map(literal, W.DETAIL_CURRENCIES)),
    "pay level": r"level\s*[-–]?\s*\d",
    "pay range": r"\d[\d,]{2,}\s*[-–]\s*\d",
    "tiny amount": r"^(?:rs\.?|₹|inr)\s*\d{1,2}$",
    "date in numbers": r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b",
    "date in words": r"\b\d{1,2}\s+(?:" + "|".join(W.MONTH_STARTS) + r")[a-z]*\s+20\d{2}\b",
    "no fee": whole_words(W.FREE_WORDS),
    "no fee at all": whole_words(w for w in W.FREE_WORDS if w != "निशुल्क"),
    "link": "|".join(map(literal, W.LINK_MARKS)),
    "social": "|".join(W.SOCIAL_SITES),
    "timeline": whole_words(W.TIMELINE_WORDS),
    "instructions": whole_words(W.INSTRUCTION_WORDS),
    "selection chatter": "|".join(map(literal, W.SELECTION_CHATTER)),
    "fragment": rf"^\(?\s*(?:{spaced(W.FRAGMENT_STARTS)})\b",
    "lone word": rf"^(?:{spaced(W.LONE_WORDS)})$",
    "lone amount": r"^[\W_]*rs\.?\s*\d{1,2}$",
    "only signs": r"^[.:;\-–—]+$",
}
_DATE = Needs(holds=(("date in numbers", "date in words"),))
#: The strict needs of details, and the looser ones of values that an adapter has found.
DETAIL_NEEDS = {
    "vacancy": Needs(holds=(("plain number",),), lacks=("timeline",)),
    "qualification": Needs(5, 900, lacks=("instructions", "link")),
    "salary": Needs(3, 900, (("currency", "pay level", "pay range"),), ("tiny amount",)),
    "age_limit": Needs(0, 900, (("digit",),)),
    "application_fee": Needs(0, 300, (("digit", "no fee"),), ("link", "social")),
    "selection_process": Needs(0, 900, lacks=("link", "selection chatter")),
    "exam_date": _DATE, "application_start_date": _DATE, "last_date": _DATE,
}
FOUND_NEEDS = {
    "vacancy": Needs(holds=(("whole number",),)), "salary": Needs(2), "qualification": Needs(3),
    "application_fee": Needs(0, 240, (("digit", "no fee at all"),), ("link", "social")),
}


def meets(value: Column, needs: Needs) -> Column:
    """Whether a value has what a field asks for."""
    low = F.lower(value)
    has = lambda names: low.rlike("(?U)" + "|".join(f"(?:{TRAITS[n]})" for n in names))
    tests = [has(group) for group in needs.holds] + [F.length(value) >= needs.least]
    if needs.most is not None:
        tests.append(F.length(value) <= needs.most)
    if needs.lacks:
        tests.append(~has(needs.lacks))
    return reduce(lambda a, b: a & b, tests)


def is_detail(x: Column | str, name: str) -> Column:
    """Whether a value can stand in the detail field ``name``: no placeholder, no fragment, and what the field needs."""
    v = clean_detail(x)
    told = (v != "") & ~F.lower(v).isin(*W.DETAIL_PLACEHOLDERS)
    return told & meets(v, Needs(lacks=("fragment", "lone word", "lone amount", "only signs"))) & meets(v, DETAIL_NEEDS.get(name, Needs()))


def sanitise(x: Column | str, name: str, fallback: Column | str = "") -> Column:
    """The cleaned value where it can stand in the field, else the fallback."""
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.when(is_detail(x, name), clean_detail(x)).otherwise(other)


def is_usable(x: Column | str, name: str = "") -> Column:
    """The adapters' looser test of an extracted value."""
    v = squeeze(x)
    low = F.lower(v)
    return (v != "") & ~low.isin(*W.USABLE_NOT) & ~has_any(low, W.SENT_ELSEWHERE) & meets(v, FOUND_NEEDS.get(name, Needs()))


def better(old: Column | str, new: Column | str, name: str, kind: Column | str) -> Column:
    """A detail found in a document replaces the old one only if it is usable and the post is a recruitment."""
    return F.when((F.lower(strip(kind)) == "recruitment") & is_usable(new, name), squeeze(new)).otherwise(text(old))


def is_corrupt(x: Column | str) -> Column:
    """A value spoilt by character recognition: carets, runs of marks, known fragments, or more odd characters than a text of its length has."""
    s = text(x)
    count = lambda kept: F.length(F.regexp_replace(s, kept, ""))
    tests = {
        "two carets": count(r"[^\^]") >= 2,
        "marks in a row": s.rlike(f"[{W.SCAN_MARKS}]{{2,}}"),
        "known fragment": s.rlike("(?i)" + whole_words(W.SCAN_FRAGMENTS)),
        "odd characters": count(rf"[A-Za-z0-9\u0900-\u097F\s{W.USUAL_SIGNS}]") > F.greatest(F.lit(5), F.floor(F.length(s) / 70)),
    }
    return (strip(s) != "") & reduce(lambda a, b: a | b, tests.values())


# Reader's texts.

def source_text(columns: Iterable[str], module: str = "reader") -> Column:
    """The texts of a record in a module's own order, without empty ones."""
    return words_of(columns, W.SOURCE_TEXTS[module])


def first_long_text(columns: list[Column], least: int = 300, fallback: Column | str = "", most: int = 26_000) -> Column:
    """The first of the texts that has ``least`` characters, else the fallback; cut to ``most``."""
    found = [F.when(F.length(squeeze(x)) >= least, squeeze(x)) for x in columns]
    other = F.lit(fallback) if isinstance(fallback, str) else squeeze(fallback)
    return F.left(F.coalesce(*found, other), F.lit(most))


def reader_summary(columns: Iterable[str]) -> Column:
    """The title and the labelled details that are real, joined by full stops."""
    from .text import reader_title

    parts = [F.nullif(reader_title(field(columns, "title")), F.lit(""))]
    for name, label in W.SUMMARY_LABELS.items():
        value = squeeze(field(columns, name))
        parts.append(F.when(~placeholder(value, W.READER_PLACEHOLDERS) & (value != ""), F.concat(F.lit(label + ": "), value)))
    return F.concat_ws(". ", *parts)
