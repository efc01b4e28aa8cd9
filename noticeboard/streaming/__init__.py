"""Incremental batches as streams: an extension, as the engine's own runs are plain batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge


def upsert_stream(
    stream: DataFrame,
    read_live: Callable[[], DataFrame],
    write_live: Callable[[DataFrame, int], None],
    key: str,
    compared: Sequence[str],
    checkpoint: str,
) -> StreamingQuery:
    """Merge each micro-batch into the live table; ``write_live`` gets the merged rows and the batch number.

    A batch that is run again merges to the same table, as the merge is idempotent.
    """

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates([key])
        write_live(merge.upsert(read_live(), rows, key, compared).drop("change"), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_only_stream(stream: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """Rows whose key the stream has not had within the watermark delay."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
