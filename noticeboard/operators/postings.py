"""A stored search index: posting lists of character grams in buckets, and the items by block.

A substring scorer gives points only to items of which a field contains the query or one of its words. Such a field has all
grams of that text, so the items that have them all are the only ones to score: the hits are those of a scan. A search reads the buckets of
its grams and the item blocks of its candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean
from . import search

FIELDS = ("title", "category", "department", "state", "description", "keywords")


@dataclass(frozen=True)
class Layout:
    """``buckets`` of grams, ``block`` ids of items a block, grams of up to ``size`` characters."""

    buckets: int = 64
    block: int = 65_536
    size: int = 3


def _grams(texts, size: int):
    """Distinct grams of 1 to ``size`` characters of an array of texts; none reaches over two texts."""

    def of(n: int):
        cut = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substr(t, i, F.lit(n)))
        return F.flatten(F.transform(F.filter(texts, lambda t: F.length(t) >= n), cut))

    return F.array_distinct(F.concat(*(of(n) for n in range(1, size + 1))))


def _bucket(gram, layout: Layout):
    return F.pmod(F.xxhash64(gram), F.lit(layout.buckets)).cast("int")


def build(items: DataFrame, path: str, layout: Layout = Layout()) -> None:
    """Write the index of ``items(ord, ...)`` below ``path``: ``items`` by block, ``postings`` by bucket.

    A posting list is cut by item blocks, so that the list of a gram that all items have is bounded in each row. Items
    without an ``ord`` are left out; fields that are missing or null are empty.
    """
    rows = items.where("ord IS NOT NULL").withColumn("block", F.floor(F.col("ord") / layout.block).cast("bigint"))
    rows.repartition("block").write.partitionBy("block").mode("overwrite").parquet(f"{path}/items")
    fields = search._fields(items)
    told = rows.select("ord", "block", F.explode(_grams(F.array(*(fields[f] for f in FIELDS)), layout.size)).alias("gram"))
    lists = told.groupBy("gram", "block").agg(F.array_sort(F.collect_set("ord")).alias("ords")).withColumn("bucket", _bucket(F.col("gram"), layout))
    lists.repartition(layout.buckets, "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")


def wanted_grams(query: str, size: int = 3) -> list[tuple[int, str]]:
    """(term, gram) of the query and of each of its words: the longest grams, or the term itself where it is shorter."""
    q = " ".join(query.split()).lower()
    terms = list(dict.fromkeys([q, *q.split()]))
    return [(i, g) for i, t in enumerate(terms) for g in dict.fromkeys(t[k : k + size] for k in range(max(1, len(t) - size + 1)))]


def candidates(spark: SparkSession, path: str, query: str, layout: Layout = Layout()) -> DataFrame:
    """``ord, block`` of the items that have all grams of the query or of one of its words."""
    grams = wanted_grams(query, layout.size)
    asked = spark.createDataFrame(grams, "term int, gram string").withColumn("bucket", _bucket(F.col("gram"), layout))
    buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
    need = asked.groupBy("term").agg(F.count("*").alias("need"))
    lists = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets) & F.col("gram").isin([g for _, g in grams]))
    hits = lists.join(F.broadcast(asked.drop("bucket")), "gram").select("term", "block", F.explode("ords").alias("ord"))
    hits = hits.groupBy("term", "block", "ord").agg(F.count("*").alias("have")).join(F.broadcast(need), "term").where("have = need")
    return hits.select("ord", "block").distinct()


def find(spark: SparkSession, path: str, query: str, limit: int | None = None, layout: Layout = Layout()) -> DataFrame:
    """The hits of :func:`search.search`, third scorer, over the indexed items; a query under two characters has none."""
    items = spark.read.parquet(f"{path}/items")
    if len(" ".join(query.split())) < 2:
        return search.search(items.drop("block"), query, 3, limit)
    near = candidates(spark, path, query, layout)
    blocks = [r["block"] for r in near.select("block").distinct().collect()]
    rows = items.where(F.col("block").isin(blocks)).join(near, ["block", "ord"], "left_semi").drop("block")
    return search.search(rows, query, 3, limit)


def suggest(spark: SparkSession, path: str, query: str, limit: int = 8, layout: Layout = Layout()) -> DataFrame:
    """The suggestions of :func:`search.suggest` over the indexed items."""
    items = spark.read.parquet(f"{path}/items")
    if not query.split():
        return search.suggest(items, query, limit)
    near = candidates(spark, path, query, layout)
    return search.suggest(items.join(near, ["block", "ord"], "left_semi").where(clean("title") != ""), query, limit)
