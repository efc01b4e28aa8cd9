"""The publisher run: pages and a live table to live, archive and search tables, merged once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, records
from ..functions import wordlists as W
from ..functions.text import strip
from ..operators import dedupe, keys, lifecycle, links, merge, orders, route, summary
from ..operators.store import Store
from ..schema import NOTICE, conform
from ..storage import materialise


def parse(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` to classified notices, the first of each title and address; ``ord`` is the place on the pages."""
    rows = links.anchors(pages.select("page_id", F.col("url").alias("page_url"), "html"))
    rows = rows.withColumn("url", links.resolve(F.col("page_url"), F.col("href"))).where("url IS NOT NULL AND title <> ''")
    rows = rows.withColumn("category", classify.classify_post("title", "url")).where("category IS NOT NULL")
    rows = rows.withColumn("ord", F.struct("page_id", "pos"))
    first = dedupe.first_per_key(rows, keys.title_url("title", "url"))
    place = F.col("page_id").cast("bigint") * 100_000 + F.col("pos")
    return records.optimise(conform(first.select("title", "url", "category", F.lit("").alias("department"), place.alias("ord"))))


def prepare(fresh: DataFrame, as_of: str) -> DataFrame:
    """A batch as the merge takes it: optimised, the best row of each id by priority, complete and not expired.

    Only kind and id are told before repeats go; the other rules read the rows that are left.
    """
    rows = conform(fresh)
    rows = rows.where(classify.classify_post(strip("title"), strip("url"), "description").isNotNull())
    best = dedupe.best_per_key(rows, keys.job_id(strip("title"), strip("url")))
    return records.validate(records.optimise(best), as_of)


def publish_into(live: Store, fresh: DataFrame, as_of: str) -> dict[str, int]:
    """Merge a batch into a stored live table: ``version, touched, rewritten`` buckets; only buckets in which a row changed are written.

    The rows of the buckets that the batch meets are judged anew before the merge, the others when they are read, by :func:`published`.
    Publishing a batch again writes nothing. The store's key is ``job_id``.
    """
    return live.run(prepare(fresh, as_of), lambda old, new: merge.upsert(records.revalidate(conform(old)), new, "job_id", W.COMPARED_FIELDS))


def published(live: Store, spark: SparkSession, as_of: str) -> dict[str, DataFrame]:
    """``live, hidden, archive`` and the routed ``pages`` of a stored live table as of a day; expiry is judged when it is read, so no day rewrites rows."""
    rows = live.read(spark)
    return _outputs(records.revalidate(conform(spark.createDataFrame([], NOTICE) if rows is None else rows)), as_of)


def _outputs(merged: DataFrame, as_of: str) -> dict[str, DataFrame]:
    state = lifecycle.with_status(merged, as_of)
    row = {k: F.col(k) for k in state.columns}
    kept, hidden, archive = lifecycle.split(state, F.col("is_expired"), classify.is_publishable(row))
    pages = route.categories(kept, orders.sort_columns(kept.columns, "category")).select("page", "job_id", "title", "rank")
    return {"live": kept, "hidden": hidden, "archive": archive, "pages": pages}


def publish(live: DataFrame, fresh: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Merge a batch and split the result: ``live``, ``hidden``, ``archive``, the routed ``pages``, ``new`` rows and ``counts``.

    The live table is judged anew first. A job_id has one row in the result, so publishing a batch again
    changes nothing. The merged table is written once; all results read it.
    """
    known, batch = records.revalidate(conform(live)), prepare(fresh, as_of)
    merged = materialise(merge.upsert(known, batch, "job_id", W.COMPARED_FIELDS))
    new = merged.where("change <> 'kept'")
    return _outputs(merged.drop("change"), as_of) | {"new": new, "counts": summary.counts(merged)}
