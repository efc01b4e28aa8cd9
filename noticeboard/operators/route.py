"""Multi-label routing of notices to category pages, as ordered array stages."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, records
from ..functions import routes as R
from ..functions import wordlists as W
from ..functions.text import has_any, signal_pattern, squeeze, strip, text
from . import dedupe, keys, lifecycle, projections

PLAIN = re.compile("[a-z0-9]+")


def _any(x: Column, terms) -> Column:
    """One of the terms as a substring: plain searches, for texts that are fields already."""
    return F.exists(F.array(*map(F.lit, terms)), lambda t: x.contains(t))


def _signal(x: Column, terms) -> Column:
    """Routing signal; the pattern runs only on texts that have a term at all."""
    found = _any(x, terms)
    return found & x.rlike(signal_pattern(terms)) if any(map(PLAIN.fullmatch, terms)) else found


def _first(tests: dict[str, Column]) -> Column:
    """The first page whose test holds, or null."""
    out = F.when(F.lit(False), "")
    for page, test in tests.items():
        out = out.when(test, page)
    return out


def _when(test: Column, *pages: str | Column) -> Column:
    """Those pages, or none."""
    return F.when(test, F.array(*(F.lit(p) if isinstance(p, str) else p for p in pages))).otherwise(F.array().cast("array<string>"))


def explicit_type(title: Column, persisted: Column) -> Column:
    """Content type by the persisted type, else by words of the title, else null."""
    result = title.rlike(r"\b(result|merit list|score ?card)\b|परिणाम")
    tests = {k: _any(title, v) for k, v in R.EXPLICIT_TYPES.items()}
    ordered = {"admit-card": tests["admit-card"], "answer-key": tests["answer-key"], "result": result} | {
        k: tests[k] for k in ("syllabus", "scholarship", "recruitment")
    }
    return F.when(persisted.isin(*R.TYPED, "recruitment"), persisted).otherwise(_first(ordered))


def _let(fields: dict[str, Column], use: Callable[[Column], Column]) -> Column:
    """``use`` of a struct that is evaluated once, however often its fields are read or filters are pushed down."""
    value = F.struct(*(v.alias(k) for k, v in fields.items()))
    return F.element_at(F.transform(F.array(value), use), 1)


def _located(s: Column) -> dict[str, Column]:
    """Locations, identities and the content type of a notice's texts."""
    body, identity = s["body"], s["identity"]
    return {
        "psc": _any(identity, R.STATE_PSC),
        "upsc": identity.rlike(r"\bupsc\b") | _any(identity, ("union public service commission", "upsc.gov.in")),
        "uk": _signal(body, R.UK),
        "central": _signal(body, R.CENTRAL),
        "uk_page": _first({k: _signal(body, v) for k, v in R.UK_PAGES.items()}),
        "state_page": _first({k: _signal(body, v) for k, v in R.STATE_PAGES.items()}),
        "mapped": F.create_map(*(F.lit(x) for kv in R.RAW_CATEGORY.items() for x in kv))[s["raw"]],
        "kind": explicit_type(s["title"], s["type"]),
        "raw": s["raw"],
        "banking": s["banking"],
        "primary": s["primary"],
    }


def _by_category(t: Column) -> Column:
    """Pages by location and raw category."""
    central = ~t["uk"] & t["central"] & ~t["psc"]
    elsewhere, state, mapped = ~t["uk"] & ~central, t["state_page"], t["mapped"]
    polluted = ((t["uk"] | t["psc"]) & mapped.isin("ssc", "upsc", "central-government-jobs")) | ((mapped == "upsc") & ~t["upsc"])
    return F.concat(
        _when(t["uk"], "uttarakhand-jobs", t["uk_page"]),
        _when(central, "central-government-jobs"),
        _when(elsewhere & state.isNotNull(), "other-state-jobs", state),
        _when(elsewhere & state.isNull() & t["raw"].isin("other state jobs", "other state job"), "other-state-jobs"),
        _when(mapped.isNotNull() & ~polluted, mapped),
    )


def _by_type(t: Column, pages: Column) -> Column:
    """The explicit type's page added, and the pages that it excludes removed."""
    kind, latest = t["kind"], F.array(F.lit("latest-jobs"))
    typed = F.array(*map(F.lit, R.TYPED))
    as_recruitment = F.array_except(F.concat(pages, latest), typed)
    as_typed = F.array_except(F.concat(pages, F.array(kind)), F.array_except(F.concat(typed, latest), F.array(kind)))
    return F.when(kind == "recruitment", as_recruitment).when(kind.isNotNull(), as_typed).otherwise(pages)


def _by_content(t: Column) -> list[Column]:
    """Pages by words of the title and description; banking reads more fields."""
    out = []
    for page, signals in R.CONTENT.items():
        test = _signal(t["banking"] if page == "banking" else t["primary"], signals)
        if page in ("ssc", "upsc"):
            test = test & ~(t["uk"] | t["psc"])
        if page == "upsc":
            test = test & t["upsc"]
        if page in R.TYPED:
            test = test & (t["kind"].isNull() | (t["kind"] == page))
        out.append(_when(test, page))
    return out


def _fallback(t: Column) -> Column:
    """The first content page whose keywords match, or null."""
    signals = R.CONTENT | R.FALLBACK
    return _first(
        {
            page: _signal(t["banking"] if page == "banking" else t["primary"], signals[page]) & ((t["upsc"] & ~t["psc"]) if page == "upsc" else F.lit(True))
            for page in R.FALLBACK_ORDER
        }
    )


def _complete(t: Column) -> Column:
    """A keyword page where no content page has been found, and Latest Jobs where nothing has."""
    routed = t["routed"]
    found = F.arrays_overlap(routed, F.array(*map(F.lit, R.CONTENT_PAGES)))
    pages = F.array_compact(F.concat(routed, _when(~found, t["last"])))
    return F.array_distinct(F.when(F.size(pages) == 0, F.array(F.lit("latest-jobs"))).otherwise(pages))


def pages(df: DataFrame) -> Column:
    """Array of the pages of a notice, in order of assignment.

    Location first (Uttarakhand, else central, else the first state that matches), then the raw
    category, the explicit type with the removal of pages it excludes, content signals, a
    keyword fallback where no content page has been found, and Latest Jobs where nothing has.
    """
    used = ("title", "description", "url", "source", "official_website", "apply_link", "state", "organization", "content", "category", "post_type")
    fields = {k: F.lower(strip(k)) if k in df.columns else F.lit("") for k in used}

    def join(f: Column) -> Column:
        told = lambda *ks: F.concat_ws(" ", *(f[k] for k in ks))
        texts = {
            "raw": squeeze(f["category"]),
            "title": f["title"],
            "type": f["post_type"],
            "full": told("title", "description", "url", "source", "official_website", "apply_link", "state", "organization", "content"),
            "banking": told("title", "description", "source", "state", "organization", "content"),
            "primary": told("title", "description"),
            "identity": told("title", "description", "organization", "source", "url", "official_website", "state"),
        }
        return _let(texts, imply)

    def imply(s: Column) -> Column:
        implied = [F.when(s["full"].contains(domain), signals) for domain, signals in R.DOMAIN_SIGNALS.items()]
        kept = {k: s[k] for k in ("raw", "title", "type", "banking", "primary", "identity")}
        return _let(kept | {"body": F.concat_ws(" ", s["full"], *implied)}, lambda t: _let(_located(t), locate))

    def finish(t: Column) -> Column:
        routed = F.array_compact(F.concat(_by_type(t, t["located"]), *_by_content(t)))
        return _let({"routed": routed, "last": _fallback(t)}, _complete)

    def locate(t: Column) -> Column:
        kept = ("psc", "upsc", "uk", "kind", "banking", "primary")
        return _let({k: t[k] for k in kept} | {"located": _by_category(t)}, finish)

    return _let(fields, join)


def route(df: DataFrame) -> DataFrame:
    """``df`` with the array ``pages``."""
    return df.withColumn("pages", pages(df))


def home_section(category: Column | str) -> Column:
    """Exclusive homepage section of an effective category."""
    k = F.lower(text(category))
    return (
        F.when(k == "uttarakhand jobs", "uttarakhand")
        .when(k.isin("central jobs", "central government jobs", "railway jobs", "banking jobs"), "central")
        .when(k == "other state jobs", "state")
        .when(k.contains("admit"), "admit")
        .when(k.contains("result"), "result")
        .when(k.contains("answer"), "answer")
        .otherwise("latest")
    )


def home_sections(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """``section`` and the columns of ``df``: each notice in the four sections of latest updates and one of the three of jobs.

    With ``as_of`` the strict rule holds: the job sections take recruitments whose last date has not passed,
    placed by title, department and source.
    """
    have = df.columns
    get = lambda k: F.lower(text(k)) if k in have else F.lit("")
    if as_of is None:
        narrow = F.concat_ws(" ", get("title"), get("description"))
        group = F.lower(classify.home_category(text("category"), F.concat_ws(" ", narrow, get("url"), get("source")), narrow))
        uk = has_any(group, ("uttarakhand", "uk"))
        central = has_any(group, ("central", "upsc", "ssc")) | has_any(get("department"), ("bank", "railway", "defence", "government"))
        jobs = F.lit(True)
    else:
        body = F.concat_ws(" ", *(get(k) for k in ("title", "department", "organization", "source", "url", "category")))
        uk = has_any(body, ("uttarakhand", "उत्तराखंड", "ukpsc", "uksssc"))
        central = has_any(body, ("central", "upsc", "ssc", "ibps", "sbi", "rbi", "bank", "railway", "defence", "government of india"))
        jobs = lifecycle.active_recruitment(have, as_of)
    place = F.when(uk, "AUTO_UK_JOBS").when(central, "AUTO_CENTRAL_JOBS").otherwise("AUTO_STATE_JOBS")
    latest = [F.lit(k) for k in ("AUTO_LATEST_GRID", "AUTO_LATEST_POSTS", "AUTO_MARQUEE", "AUTO_BREAKING")]
    return df.withColumn("section", F.explode(F.array_compact(F.array(*latest, F.when(jobs, place)))))


def homepage(df: DataFrame, order: list[Column], as_of: str | None = None) -> DataFrame:
    """The homepage's sections: the first notice of each page address, placed, and capped by section; ``section, rank`` and all columns."""
    rows = df.where(strip("title") != "").withColumn("_link", projections.file_name(df))
    rows = dedupe.first_per_key(rows, "_link").select(df.columns)
    return dedupe.capped_sections(home_sections(rows, as_of), "section", W.SECTION_CAPS, order)


def legacy_homepage(df: DataFrame, order: list[Column], files: DataFrame | None = None) -> DataFrame:
    """The older homepage: ``section, rank`` and all columns of the first 30 notices by ``order``, which must have no ties.

    Each notice is in both sections of latest updates and in the one of three of jobs that its category names. ``files(name)`` lists the pages there are:
    a notice without one takes a place among the 30, but is shown nowhere. Of a page's notices the first stays, and each section has its cap.
    """
    have = df.columns
    first = df.orderBy(*order).limit(W.LEGACY_MOST).withColumn("_link", projections.file_name(df))
    first = first.withColumn("_at", F.row_number().over(Window.orderBy(*order)))  # of 30 rows
    if files is not None:
        first = first.join(files.select(F.col("name").alias("_link")).distinct(), "_link", "left_semi")
    kind = F.lower(text("category"))
    jobs = F.when(kind.contains("uttarakhand"), "uk_jobs").when(has_any(kind, W.LEGACY_CENTRAL), "central_jobs").otherwise("state_jobs")
    rows = first.withColumn("section", F.explode(F.array(F.lit("latest_cards"), F.lit("latest_posts"), jobs)))
    rows = dedupe.first_per_key(rows, "section", "_link", ord="_at")
    return dedupe.capped_sections(rows, "section", W.LEGACY_CAPS, [F.col("_at")]).select("section", "rank", *have)


def categories(df: DataFrame, order: list[Column], files: DataFrame | None = None, most: int = 50) -> DataFrame:
    """The category pages: no noise, pages that exist, the first of each title slug, routed, and ``most`` a page by ``order``."""
    rows = df.where(~classify.category_noise("title", records.words_of(df.columns, ("description", "content", "raw_text"))))
    if files is not None:
        rows = rows.withColumn("name", projections.file_name(df)).join(files.select("name").distinct(), "name", "left_semi")
    rows = dedupe.first_per_key(rows, keys.page_slug("title")).select(df.columns)
    routed = route(rows).withColumn("page", F.explode("pages")).drop("pages")
    return dedupe.top_per_group(routed, "page", order, most)
