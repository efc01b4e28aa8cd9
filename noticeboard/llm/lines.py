"""Operator 9: line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, copied, documents, heavy_counted, materialise

#: Lines in all lists up to which they are broadcast: 8 MB of hashes.
BROADCAST_LINES = 1 << 20


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float, least_pages: int) -> DataFrame:
    """``_host, _lines``: hashes of the lines that more than ``ratio`` of a host's pages contain.

    The list of a host is bounded: each of its lines takes up over ``ratio`` of the pages, so it
    has at most (mean distinct lines a page) / ratio entries. A line must also be on
    ``least_pages`` pages. Lines that are blank once trimmed never count.
    """
    rows = pages.select(F.coalesce(F.col(host), F.lit("")).alias("_host"), F.col(text).alias("_text"))
    hashes = F.array_distinct(F.transform(F.filter(F.split("_text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(F.trim(x))))
    counts = rows.select("_host", F.explode(hashes).alias("_line")).groupBy("_host", "_line").agg(F.count("*").alias("_n"))
    totals = rows.groupBy("_host").agg(F.count("*").alias("_pages"))
    return (
        counts.where(F.col("_n") >= least_pages)
        .join(totals, "_host")
        .where(F.col("_n") > ratio * F.col("_pages"))
        .groupBy("_host")
        .agg(F.collect_set("_line").alias("_lines"))
    )


def by_place(rows: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """``rows`` with ``_part``: 0, or for a heavy host one of its parts, by the row's place, so that copies of one text part too."""
    if heavy is None:
        return rows.withColumn("_part", F.lit(0))
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    placed = placed.join(F.broadcast(heavy), F.xxhash64("_host") == F.col("_heavy"), "left")
    part = F.coalesce(F.pmod("_at", F.col("_parts")), F.lit(0)).cast("int")
    return placed.withColumn("_part", part).select(*rows.columns, "_part")


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, least_pages: int = 5) -> DataFrame:
    """``pages`` without lines that over ``ratio`` of the pages of their host contain.

    A page counts once for a line however often it has it, and loses all its copies; lines are
    compared without outer spaces. All rows and columns stay, with ``lines_dropped`` more (a
    column of that name is kept as ``lines_dropped_in``); repeated rows are pages of their own. A page may be left with an empty text. Null texts stay null and drop nothing, yet count as
    pages; null hosts are one unnamed host. The lists of all hosts are counted and broadcast if
    they are short (8 bytes a line); else pages are joined to their host's list, and those of a host with more than one in
    1024 pages are dealt to as many copies of its list as it has 1024ths. Each page's lines meet the list once, as
    hashed sets; a line is then looked up among the page's own hits.
    """
    pages = apart(pages, "lines_dropped")
    common = materialise(boilerplate(pages, host, text, ratio, least_pages))
    rows = pages.select(F.struct(*pages.columns).alias("_page"), F.coalesce(F.col(host), F.lit("")).alias("_host"))
    if (common.agg(F.sum(F.size("_lines"))).first()[0] or 0) <= BROADCAST_LINES:
        joined = rows.join(F.broadcast(common), "_host", "left")
    else:
        heavy = heavy_counted(rows.groupBy("_host").agg(F.count("*").alias("_n")), "_host", "_n")
        joined = by_place(rows, heavy).join(copied(common, "_host", heavy), ["_host", "_part"], "left")
    lines = F.split(F.col("_page")[text], "\n")
    joined = joined.withColumn("_hits", F.array_intersect(F.transform(lines, lambda x: F.xxhash64(F.trim(x))), "_lines"))
    kept = F.filter(lines, lambda x: ~F.array_contains("_hits", F.xxhash64(F.trim(x))))
    joined = joined.withColumn("_kept", F.when(F.size("_hits") > 0, kept).otherwise(lines))
    dropped = F.coalesce(F.size(lines) - F.size("_kept"), F.lit(0)).alias("lines_dropped")
    return joined.select(*((F.array_join("_kept", "\n") if c == text else F.col("_page")[c]).alias(c) for c in pages.columns), dropped)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "source", "text", F.col("lines_dropped").cast("bigint").alias("lines_dropped"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS host, i, l
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
       unnest(ls) WITH ORDINALITY AS u(l, i)
), totals AS (
  SELECT coalesce(source, '') AS host, count(*) AS pages FROM documents GROUP BY 1
), common AS (
  SELECT host, trim(l) AS line
  FROM lines JOIN totals USING (host)
  WHERE trim(l) <> ''
  GROUP BY host, trim(l), pages
  HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) > 0.1 * pages
), kept AS (
  SELECT a.doc_id, string_agg(a.l, chr(10) ORDER BY a.i) FILTER (c.line IS NULL) AS text, count(c.line) AS lines_dropped
  FROM lines a LEFT JOIN common c ON a.host = c.host AND trim(a.l) = c.line
  GROUP BY a.doc_id
)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(k.lines_dropped, 0) AS BIGINT) AS lines_dropped
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
