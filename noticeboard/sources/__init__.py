"""Readers and writers. Paths go through Spark, so any store it knows will do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import text
from ..schema import NOTICE, conform

SOURCE = "name string, url string, type string, enabled boolean, adapter string, department string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The same rows dealt by key to two tasks a core, for rules that cost more than the rows: a file is read by no more tasks than it has row groups."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, key)


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    """JSON notices (an array or lines) in the notice schema; a missing path is an empty table."""
    try:
        return conform(spark.read.schema(NOTICE).option("multiLine", True).json(path))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], NOTICE)
        raise


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Enabled sources; kind and adapter have defaults."""
    rows = spark.read.schema(SOURCE).option("multiLine", True).json(path)
    return enabled(rows)


def enabled(sources: DataFrame) -> DataFrame:
    rows = sources.where(F.coalesce(F.col("enabled"), F.lit(True)))
    return rows.withColumn("type", F.coalesce("type", F.lit("html"))).withColumn("adapter", F.coalesce("adapter", F.lit("generic")))


def of_type(sources: DataFrame, kind: str) -> DataFrame:
    return sources.where(F.coalesce("type", F.lit("html")) == kind)


def by_name(sources: DataFrame, name: str) -> DataFrame:
    return sources.where(F.lower(F.trim(text("name"))) == name.strip().lower())


def first_sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The enabled sources of the first of the files that is there and has any; none of them gives an empty table."""
    for path in paths:
        try:
            found = read_sources(spark, path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        if not found.isEmpty():
            return found
    return enabled(spark.createDataFrame([], SOURCE))


def readable(pages: DataFrame) -> DataFrame:
    """Fetched pages that a scan reads: no error status, no PDF and some HTML; ``pages(url, html)``, ``status`` if known."""
    ok = F.coalesce(F.col("status"), F.lit(200)) < 400 if "status" in pages.columns else F.lit(True)
    return pages.where(ok & ~F.lower(F.regexp_replace(text("url"), r"[?#].*$", "")).endswith(".pdf") & (text("html") != ""))


def listing(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """A folder's files as rows: ``name, path, size, modified``; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


#: Plug-in scans by adapter name, beside the rules of :mod:`adapters`: each takes links and returns notices.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def adapter(name: str):
    def register(fn):
        ADAPTERS[name] = fn
        return fn

    return register


def scan(links: DataFrame) -> DataFrame:
    """Notices of all adapters: one pass for those with rules, and one for each plug-in; unknown adapters are generic."""
    from .adapters import RULES, scan_rules

    named = F.coalesce(F.col("adapter"), F.lit("generic"))
    ruled = F.when(named.isin(*RULES), named).otherwise("generic")
    out = scan_rules(links.where(~named.isin(*ADAPTERS)).withColumn("adapter", ruled)).drop("adapter")
    for name, fn in ADAPTERS.items():
        out = out.unionByName(fn(links.where(named == name)), allowMissingColumns=True)
    return out


def scan_status(sources: DataFrame, links: DataFrame, found: DataFrame) -> DataFrame:
    """``name, links, notices, status`` of each source: failed if its pages gave no link, else ok or empty.

    ``sources(name)``, ``links(name)``, ``found(name)``: counts are joined, never rows.
    """
    counted = lambda df, n: df.groupBy("name").agg(F.count("*").alias(n))
    rows = sources.select("name").distinct().join(counted(links, "links"), "name", "left").join(counted(found, "notices"), "name", "left")
    n = lambda k: F.coalesce(k, F.lit(0))
    status = F.when(n("links") == 0, "failed").when(n("notices") == 0, "empty").otherwise("ok")
    return rows.select("name", n("links").alias("links"), n("notices").alias("notices"), status.alias("status"))


def write_notices(df: DataFrame, path: str) -> None:
    """Live or archive table: full texts go, descriptions are cut to 500 characters."""
    df.drop("content", "html").withColumn("description", F.left("description", F.lit(500))).write.mode("overwrite").parquet(path)


def write_archive(df: DataFrame, path: str) -> None:
    """The archive: the first row of each id, address or title, then as :func:`write_notices`."""
    from ..operators import dedupe, keys

    rows = df.withColumn("_key", keys.publisher(df.columns)).where("_key <> ''")
    write_notices(dedupe.first_per_key(rows, "_key").select(df.columns), path)


def write_index(items: DataFrame, path: str) -> None:
    """The search index twice: as JSON lines, and each line as a script's push, for readers without a server."""
    items.write.mode("overwrite").json(f"{path}/json")
    told = F.concat(F.lit("(window.searchData = window.searchData || []).push("), F.to_json(F.struct(*items.columns)), F.lit(");"))
    items.select(told.alias("value")).write.mode("overwrite").text(f"{path}/js")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def sitemap(urls: DataFrame, url: str = "url") -> DataFrame:
    """Distinct addresses in order, each with its sitemap entry."""
    return urls.where(text(url) != "").select(F.col(url).alias("url")).distinct().withColumn("entry", F.concat(F.lit("<url><loc>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))).orderBy("url")
