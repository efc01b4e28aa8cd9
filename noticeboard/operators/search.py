"""Catalogue search: scoring, facets, suggestions, spelling and related titles."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean, has_any, squeeze, text, tokens
from ..functions.udfs import ratio_bound, similarities, similarity
from ..functions.wordlists import SPELLING, SYNONYMS
from .dedupe import first_per_key

#: Points of the three scorers (title equal, title begins, title contains; then by field).
V1 = {"title": (100, 80, 60), "category": 30, "department": 25, "state": 20, "description": 10}
V2 = {"title": (150, 100, 70), "category": 30, "department": 20, "state": 20, "description": 10, "keywords": 15}
V3 = {"title": (200, 120, 90), "category": 45, "department": 35, "state": 25, "keywords": 25, "description": 15}
TOKENS2 = {"title": 12, "description": 4}
TOKENS3 = {"title": 20, "category": 10, "description": 5, "keywords": 5}


def _fields(items: DataFrame) -> dict[str, Column]:
    """Normalised searchable fields; a keyword list is joined, a missing column is empty."""
    kinds = dict(items.dtypes)
    get = lambda k: F.array_join(k, " ") if kinds.get(k, "").startswith("array") else (text(k) if k in kinds else F.lit(""))
    return {k: clean(get(k)) for k in ("title", "category", "department", "state", "description", "keywords")}


def _points(fields: dict[str, Column], q: Column, by: dict) -> Column:
    equal, begins, contains = by["title"]
    t = fields["title"]
    out = F.when(t == q, equal).when(t.startswith(q), begins).when(t.contains(q), contains).otherwise(0)
    for k, points in by.items():
        if k != "title":
            out = out + F.when(fields[k].contains(q), points).otherwise(0)
    return out


def _token_points(fields: dict[str, Column], q: Column, by: dict[str, int]) -> Column:
    def one(total: Column, token: Column) -> Column:
        return total + sum((F.when(fields[k].contains(token), n).otherwise(0) for k, n in by.items()), F.lit(0))

    return F.aggregate(tokens(q), F.lit(0), one)


def score(items: DataFrame, query: Column | str, version: int = 3) -> Column:
    """Score of an item for a query. Versions 1 and 2 add a share of title similarity, 3 does not."""
    q = clean(F.lit(query) if isinstance(query, str) else query)
    fields = _fields(items)
    if version == 3:
        return _points(fields, q, V3) + _token_points(fields, q, TOKENS3)
    if version == 2:
        return _points(fields, q, V2) + _token_points(fields, q, TOKENS2) + F.floor(similarity(q, fields["title"]) * 25).cast("int")
    return _points(fields, q, V1) + F.floor(similarity(q, fields["title"]) * 40).cast("int")


def search(items: DataFrame, query: str, version: int = 3, limit: int | None = None) -> DataFrame:
    """Items with a score above 0, best first, the earlier of equals first; under two characters nothing.

    Version 3 keeps the best of each address. The limits of the versions are 20, 50 and 30.
    """
    q = " ".join(query.split()).lower()
    hits = items.withColumn("score", score(items, q, version)).where((F.col("score") > 0) & F.lit(len(q) >= 2))
    if version == 3:
        hits = first_per_key(hits.withColumn("_o", F.struct(-F.col("score"), "ord")), "url", ord="_o").drop("_o")
    return hits.orderBy(F.desc("score"), "ord").limit(limit or {1: 20, 2: 50, 3: 30}[version])


def facet(items: DataFrame, field: str, value: str) -> DataFrame:
    """Items whose field contains the value, whatever the case; an empty value matches all."""
    return items.where(clean(field).contains(" ".join(value.split()).lower()))


def titles(items: DataFrame) -> DataFrame:
    return items.withColumn("title", squeeze("title")).where(F.col("title") != "")


def suggest(items: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """The first distinct titles that contain the query, in index order."""
    q = " ".join(query.split()).lower()
    hits = titles(items).where(clean("title").contains(q)).groupBy("title").agg(F.min("ord").alias("ord"))
    return hits.orderBy("ord").limit(limit)


def did_you_mean(items: DataFrame, query: str, least: float = 0.6) -> DataFrame:
    """The most similar title, the first of equals, if it is similar enough: a row or none."""
    q = clean(F.lit(query))
    near = titles(items).groupBy("title").agg(F.min("ord").alias("ord")).where(ratio_bound(q, clean("title")) >= least)
    scored = near.withColumn("ratio", similarity(q, F.col("title"))).where(F.col("ratio") >= least)
    return scored.orderBy(F.desc("ratio"), "ord").limit(1)


def related(items: DataFrame, query: str, least: float = 0.4, limit: int = 10) -> DataFrame:
    """The first distinct titles in index order that are similar enough."""
    q = clean(F.lit(query))
    near = titles(items).groupBy("title").agg(F.min("ord").alias("ord")).where(ratio_bound(q, clean("title")) >= least)
    return near.withColumn("ratio", similarity(q, F.col("title"))).where(F.col("ratio") >= least).orderBy("ord").limit(limit)


def trending(items: DataFrame, limit: int = 10) -> DataFrame:
    """The first distinct categories in index order."""
    named = items.withColumn("category", squeeze("category")).where(F.col("category") != "")
    return named.groupBy("category").agg(F.min("ord").alias("ord")).orderBy("ord").limit(limit)


def correct(query: str) -> str:
    return " ".join(SPELLING.get(w, w) for w in query.lower().split())


def expand(query: str) -> list[str]:
    """The corrected query, its words and their synonyms, each once, in that order."""
    fixed = correct(query)
    words = fixed.split()
    return list(dict.fromkeys([fixed, *words, *(s for w in words for s in SYNONYMS.get(w, ()))]))


def smart_search(items: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Best score of each item over all expansions of the query: one pass over the items.

    An item is its slug, or its address where it has none. Expansions under two characters are left out.
    """
    tries = [q for q in expand(query) if len(q) >= 2]
    made = {f"_{k}": v for k, v in _fields(items).items() if k in V1}
    rows = items.withColumns(made).withColumn("_near", similarities(tries, F.col("_title")))  # cleaned once for all tries
    scores = [_points({k[1:]: F.col(k) for k in made}, F.lit(q), V1) + F.floor(F.col("_near")[i] * 40).cast("int") for i, q in enumerate(tries)]
    best = F.greatest(*scores) if len(scores) > 1 else (scores[0] if scores else F.lit(0))
    key = F.coalesce(F.nullif(text("slug"), F.lit("")), text("url")) if "slug" in items.columns else text("url")
    hits = rows.withColumn("score", best).drop(*made, "_near").where(F.col("score") > 0).withColumn("_o", F.struct(-F.col("score"), "ord"))
    return first_per_key(hits, key, ord="_o").drop("_o").orderBy(F.desc("score"), "ord").limit(limit)


def rewrite_query(items: DataFrame, query: str) -> str:
    """Controller rewriting: normalised, replaced by the closest title if any, then by a spelling entry."""
    q = " ".join(query.lower().split())
    found = did_you_mean(items, q).select("title").first()
    q = found["title"].lower() if found else q
    return SPELLING.get(q, q)


def spelling_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SPELLING.items()), "word string, fixed string")


def top_queries(log: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent queries of a log (``query, ord``), the first seen of equals first."""
    return log.groupBy("query").agg(F.count("*").alias("n"), F.min("ord").alias("first")).orderBy(F.desc("n"), "first").limit(k)


def recent_queries(log: DataFrame, k: int = 10, window: int = 100) -> DataFrame:
    """Distinct queries of the last ``window`` entries, by first occurrence there, newest first."""
    last = log.orderBy(F.desc("ord")).limit(window)
    return last.groupBy("query").agg(F.min("ord").alias("ord")).orderBy(F.desc("ord")).limit(k)


def dashboard(log: DataFrame) -> DataFrame:
    """One row of totals of a query log (``query, n_results``)."""
    return log.agg(
        F.count("*").alias("searches"),
        F.countDistinct("query").alias("distinct_queries"),
        F.count_if(F.col("n_results") == 0).alias("zero_results"),
        F.coalesce(F.sum("n_results"), F.lit(0)).alias("results"),
    )


def contains_all(field: Column | str, words: list[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & has_any(clean(field), [w])
    return out


def best_match(items: DataFrame, query: str) -> DataFrame:
    """The first hit of the smart search, marked as featured; no row without a hit."""
    return smart_search(items, query).limit(1).withColumn("featured", F.lit(True))


def search_summary(items: DataFrame, query: str) -> DataFrame:
    """One row: ``query, count, featured, did_you_mean``; a report, so of hits up to the search's limit."""
    hits = smart_search(items, query).select("ord", "title", "score").withColumn("k", F.lit(1))
    first = F.min_by("title", F.struct(-F.col("score"), "ord"))
    told = hits.groupBy("k").agg(F.count("*").alias("count"), first.alias("featured"))
    near = did_you_mean(items, query).limit(1).select(F.lit(1).alias("k"), F.col("title").alias("did_you_mean"))
    one = items.sparkSession.range(1).select(F.lit(1).alias("k"), F.lit(query).alias("query"))
    rows = one.join(told, "k", "left").join(near, "k", "left")
    return rows.select("query", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("featured", F.lit("")).alias("featured"), F.coalesce("did_you_mean", F.lit("")).alias("did_you_mean"))


class ResultCache:
    """Results of queries for ``ttl`` seconds, by the query without outer spaces. A result is a capped list of hits."""

    def __init__(self, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock = ttl, clock
        self.kept: dict[str, tuple[float, DataFrame]] = {}

    def search(self, items: DataFrame, query: str) -> DataFrame:
        """The kept result, or that of the smart search, kept from now on; a blank query has no hits."""
        asked, now = query.strip(), self.clock()
        if asked in self.kept and now - self.kept[asked][0] < self.ttl:
            return self.kept[asked][1]
        hits = smart_search(items, asked) if asked else items.limit(0)
        rows = hits.collect()
        self.kept[asked] = now, items.sparkSession.createDataFrame(rows, hits.schema)
        return self.kept[asked][1]
