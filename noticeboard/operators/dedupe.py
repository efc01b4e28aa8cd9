"""Dedupe, ranking and limits. Order is explicit: every "first" is by ``ord``.

First and best of a key are aggregates, not windows: they combine before the shuffle, so a
key that a third of all rows share costs one row from each task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise


def _row(df: DataFrame) -> Column:
    return F.struct(*df.columns)


def first_per_key(df: DataFrame, *keys: Column | str, ord: str = "ord") -> DataFrame:
    """The first row of each key by ``ord``; nulls are a key."""
    named = [F.lit(0).alias("_0"), *(F.col(k).alias(f"_k{i}") if isinstance(k, str) else k.alias(f"_k{i}") for i, k in enumerate(keys))]
    kept = df.groupBy(*named).agg(F.min_by(_row(df), F.col(ord)).alias("r"))
    return kept.select("r.*")


def best_per_key(df: DataFrame, key: Column | str, by: str = "priority", ord: str = "ord") -> DataFrame:
    """The row of largest ``by`` of each key, the first of equals; it takes the place of the key's first row."""
    k = (F.col(key) if isinstance(key, str) else key).alias("_k")
    best = df.groupBy(k).agg(
        F.max_by(_row(df), F.struct(F.coalesce(F.col(by).cast("double"), F.lit(0.0)), -F.col(ord))).alias("r"), F.min(ord).alias("place")
    )
    return best.select(*(F.col("place").alias(c) if c == ord else F.col(f"r.{c}").alias(c) for c in df.columns))


def repeats(df: DataFrame, key: Column | str, ord: str = "ord") -> DataFrame:
    """Every row whose key an earlier row has."""
    k = F.col(key) if isinstance(key, str) else key
    first = df.groupBy(k.alias("_k")).agg(F.min(ord).alias("_first"))
    return df.withColumn("_k", k).join(first, "_k").where(F.col(ord) > F.col("_first")).drop("_k", "_first")


def top_per_group(df: DataFrame, group: Sequence[str] | str, order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each task's rows before the shuffle."""
    keys = [group] if isinstance(group, str) else list(group)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def capped_sections(df: DataFrame, section: str, caps: dict[str, int], order: Sequence[Column]) -> DataFrame:
    """Each section's first rows, up to its own cap; other sections go."""
    cap = F.create_map(*(F.lit(x) for kv in caps.items() for x in kv))[F.col(section)]
    known = df.where(F.col(section).isin(*caps))
    return top_per_group(known, section, order, max(caps.values())).where(F.col("rank") <= cap)


def rank_all(df: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Every row with its place by ``order``, a BIGINT from 1; no task sorts all rows.

    Rows are dealt by range, sorted inside their tasks and kept, as ranges are sampled anew each
    time a plan runs. A row's rank is its place in its range behind the rows of all ranges
    before it; the window over the counts reads one row a range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the id is the task's number, then the row's place in the task
    kept = materialise(dealt.select(F.struct(*df.columns).alias("_row"), F.monotonically_increasing_id().alias("_at")))
    kept = kept.select("_row", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    counts = kept.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    ranked = kept.join(F.broadcast(counts), "_part")
    given = [F.col("_row")[c].alias(c) for c in df.columns if c != rank]
    return ranked.select(*given, (F.col("_before") + F.col("_place") + 1).alias(rank))


def rank_decay(df: DataFrame, order: Sequence[Column], limit: int | None = None) -> DataFrame:
    """Rank of every row, or of the first ``limit`` rows, and a score that falls with it, one at least."""
    if limit is None:
        ranked = rank_all(df, order)
    else:
        ranked = df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.withColumn("score", F.greatest(100 - 2 * F.col("rank") + 2, F.lit(1)))
