"""Lookups, localisation, storage views and run reports."""

from __future__ import annotations

import platform
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records
from ..functions import wordlists as W
from ..functions.records import field
from ..functions.text import has_any, reader_title, squeeze, strip, text
from .links import is_advertisement

#: Rows of a lookup table up to which it is broadcast.
BROADCAST_ROWS = 100_000


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: str = "") -> DataFrame:
    """``df`` with the table's value of each key, or the default; the first value of a repeated key by order of values.

    The table is counted and broadcast if it is small, else joined by a shuffle.
    """
    names = table.groupBy(key).agg(F.min(value).alias(value))
    small = names.count() <= BROADCAST_ROWS
    joined = df.join(F.broadcast(names) if small else names, key, "left")
    return joined.select(*df.columns, F.coalesce(F.col(value), F.lit(default)).alias(value))


def literal_lookup(x: Column, pairs: Mapping[str, str], default: Column | str = "") -> Column:
    """A fixed map as an expression."""
    table = F.create_map(*(F.lit(v) for kv in pairs.items() for v in kv))
    return F.coalesce(table[x], F.lit(default) if isinstance(default, str) else default)


def localise(x: Column | str, pairs: Mapping[str, str]) -> Column:
    """Whole phrases replaced, whatever their case, the longest first."""
    out = text(x)
    for phrase in sorted(pairs, key=lambda p: (-len(p), p)):
        out = F.regexp_replace(out, rf"(?i)(?<![\p{{L}}\p{{N}}]){phrase}(?![\p{{L}}\p{{N}}])", pairs[phrase])
    return out


def title_tokens(title: Column | str) -> Column:
    """Words of three letters or digits and more that tell something; a repeated word counts again."""
    words = F.regexp_extract_all(F.lower(squeeze(title)), F.lit("[a-z0-9]+"), 0)
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*W.OFFICIAL_STOPWORDS))


def official_score(title: Column | str, label: Column | str, around: Column | str, url: Column | str) -> Column:
    """How likely a link of an organisation's page is the advertisement of the title."""
    t, u = F.lower(squeeze(title)), F.lower(text(url))
    blob = F.concat_ws(" ", F.lower(squeeze(label)), F.lower(squeeze(around)), u)
    add = lambda test, n: F.when(test, n).otherwise(0)
    out = add(F.split_part(u, F.lit("#"), F.lit(1)).endswith(".pdf"), 12) + add(u.contains("loadpdf"), 8) + add(is_advertisement(blob), 20)
    out = out + add(has_any(blob, W.OFFICIAL_STRONG), 14) + add(has_any(blob, W.OFFICIAL_WEAK), -30) + add(has_any(u, W.OFFICIAL_PATHS), 8)
    for role, names in W.OFFICIAL_ROLES.items():
        out = out + add(t.contains(role) & has_any(blob, names), 25)
    return out + 3 * F.size(F.filter(title_tokens(title), lambda w: F.contains(blob, w)))


def official_pdf(notices: DataFrame, links: DataFrame, least: int = 15) -> DataFrame:
    """``ord, pdf, score``: each notice's best link on the pages of the organisations that its title names.

    ``notices(ord, title)``, ``links(organisation, title, around, url)``. A title meets an organisation if it has the first
    word of its name and contains all of it: of a title's pieces, those that are as long as a name with one of its words first, and have that word
    where such a name has it, are joined with the names, so only true meetings leave the join. Of equal scores the link
    with more text around it wins, then the larger address.
    """
    low = F.lower("organisation")
    first = F.regexp_extract(low, r"[\p{L}\p{N}]+", 0)
    names = links.select("organisation", low.alias("_name"), first.alias("_word")).where("_word <> ''").distinct()
    shape = F.struct(F.length("_name").alias("n"), F.instr("_name", F.col("_word")).alias("at"))
    shapes = names.groupBy("_word").agg(F.collect_set(shape).alias("_shapes"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(squeeze("title")), F.lit(r"[\p{L}\p{N}]+"), 0))
    asked = notices.select("ord", F.col("title").alias("_title"), F.lower(squeeze("title")).alias("_low"), F.explode(words).alias("_word")).join(shapes, "_word")

    def pieces(s: Column) -> Column:
        """The title's pieces of a shape: none where the name is longer than the title."""
        starts = F.when(F.length("_low") >= s["n"], F.sequence(F.lit(1), F.length("_low") - s["n"] + 1)).otherwise(F.array().cast("array<int>"))
        fits = F.filter(starts, lambda i: F.substr("_low", i + s["at"] - 1, F.length("_word")) == F.col("_word"))
        return F.transform(fits, lambda i: F.substr("_low", i, s["n"]))

    met = asked.select("ord", "_title", "_word", F.explode(F.array_distinct(F.flatten(F.transform("_shapes", pieces)))).alias("_name"))
    asked = met.join(names, ["_name", "_word"]).select("ord", "_title", "organisation")
    rows = asked.join(links.where((text("url") != "") & ~F.lower(text("url")).startswith("javascript:")), "organisation")
    size = F.length(F.concat_ws(" ", squeeze("title"), squeeze("around"), text("url")))
    scored = rows.select("ord", "url", official_score("_title", "title", "around", "url").alias("score"), size.alias("_size"))
    enough = F.col("score") >= least  # in the aggregate: a filter would tell the score once more
    best = scored.groupBy("ord").agg(F.max_by(F.struct("url", "score"), F.when(enough, F.struct("score", "_size", "url"))).alias("b")).where("b IS NOT NULL")
    return best.select("ord", F.col("b.url").alias("pdf"), F.col("b.score").cast("int").alias("score"))


def reader_view(df: DataFrame) -> DataFrame:
    """Storage form: the reader summary in place of the texts, 5,000 characters of source, links only where they add something."""
    have = df.columns
    pdf = F.lower(F.regexp_replace(strip(field(have, "notification_pdf")), r"\?.*$", ""))
    bare = lambda k: F.rtrim(strip(field(have, k)), F.lit("/"))
    summary = records.reader_summary(have)
    given = F.nullif(field(have, "source_description"), F.lit(""))
    title = reader_title(field(have, "title"))
    return df.withColumns(
        {
            "source_description": F.coalesce(given, F.left(field(have, "description"), F.lit(5000))),
            "title": F.when(title != "", title).otherwise(field(have, "title")),
            "reader_summary": summary, "description": summary, "summary": summary, "content": summary,
            "notification_pdf": F.when(pdf.endswith(".pdf"), field(have, "notification_pdf")).otherwise(""),
            "apply_link": F.when(bare("apply_link") == bare("url"), "").otherwise(field(have, "apply_link")),
            "content_cleaned": F.lit(True),
        }
    )


def execution_report(notices: DataFrame, failed: DataFrame, started: str) -> DataFrame:
    """One row: status, notices, sources that failed and the start of the run."""
    ok = notices.agg(F.count("*").alias("jobs"))
    bad = failed.agg(F.count("*").alias("failed_sources"))
    status = F.when(F.col("jobs") > 0, "success").otherwise("empty")
    return ok.withColumn("k", F.lit(1)).join(bad.withColumn("k", F.lit(1)), "k").select(status.alias("status"), "jobs", "failed_sources", F.lit(started).alias("started"))


def health_report(notices: DataFrame, begun: float, now: float) -> DataFrame:
    """One row on a run: when it ended (UTC), its notices, Python's version and system, and seconds since ``begun``; times in seconds since 1970."""
    when = datetime.fromtimestamp(now, timezone.utc).replace(tzinfo=None).isoformat()
    told = {"generated_at": when, "python_version": platform.python_version(), "platform": platform.system(), "runtime_seconds": round(now - begun, 2)}
    return notices.agg(F.count("*").alias("total_jobs")).withColumns({k: F.lit(v) for k, v in told.items()})


def failed_sources(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """``name, url, errors, error``: sources that gave no page, with the number of their errors and the least of them.

    ``sources(name, url)``, ``pages(source, error)`` as the scan of sources gives them; a source without any row has none of these but has failed too.
    """
    good = F.count_if(F.col("error").isNull())
    seen = pages.groupBy(F.col("source").alias("name")).agg(good.alias("_good"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.min("error").alias("error"))
    rows = sources.select("name", "url").distinct().join(seen, "name", "left").where(F.coalesce("_good", F.lit(0)) == 0)
    return rows.select("name", "url", F.coalesce("errors", F.lit(0)).alias("errors"), text("error").alias("error"))


def rotation(sources: DataFrame, batch: int, size: int) -> DataFrame:
    """The sources of a run: batches of ``size`` in order of ``ord``, from 0, again from the start after the last."""
    n = sources.count()
    batches = max(1, -(-n // size))
    first = (batch % batches) * size
    return sources.where(F.col("ord").between(first, first + size - 1))
