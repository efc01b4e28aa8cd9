"""Counts and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(df: DataFrame, category: str = "category", department: str = "department") -> DataFrame:
    """``kind, value, n``: the total and the counts by category and by department, in one pass.

    Null categories count as Latest Jobs, null departments as Government.
    """
    rows = df.select(F.coalesce(category, F.lit("Latest Jobs")).alias("c"), F.coalesce(department, F.lit("Government")).alias("d"))
    sets = rows.groupingSets([["c"], ["d"], []], "c", "d").agg(F.count("*").alias("n"), F.grouping("c").alias("gc"), F.grouping("d").alias("gd"))
    kind = F.when(F.col("gc") == 0, "category").when(F.col("gd") == 0, "department").otherwise("total")
    return sets.select(kind.alias("kind"), F.coalesce("c", "d", F.lit("")).alias("value"), "n")


def page_counts(routed: DataFrame, pages: str = "pages") -> DataFrame:
    """Notices on each page, and over all pages in the row of a null page."""
    return routed.select(F.explode_outer(pages).alias("page")).rollup("page").agg(F.count("*").alias("n"))


def conditional(df: DataFrame, **tests: Column) -> DataFrame:
    """One row: how many rows pass each test."""
    return df.agg(*(F.count_if(test).alias(name) for name, test in tests.items()))


def index_health(items: DataFrame) -> DataFrame:
    """One row of counts of an index's defects."""
    return items.agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce(F.col("title"), F.lit("")) == "").alias("no_title"),
        F.count_if(~F.coalesce(F.col("url"), F.lit("")).rlike("^https?://")).alias("bad_url"),
        (F.count("url") - F.countDistinct("url")).alias("repeated_urls"),
    )
