"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import clean, materialise, release, scratch, shared_dir  # noqa: F401

U64 = np.uint64
MASK64 = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it if ``df`` has it already."""
    while name in df.columns:
        name += "_"
    return name


#: A key is heavy if more than one in ``HEAVY_SHARE`` rows has it, and more than ``LEAST_ROWS`` rows, the
#: size of a part; a sketch of ``TRACKED`` keys finds them.
HEAVY_SHARE, LEAST_ROWS, TRACKED = 1024, 64, 8192


def heavy_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """``_heavy, _parts``: hashes of the keys that more than one in ``HEAVY_SHARE`` rows have, or None.

    At most ``HEAVY_SHARE`` keys can be heavy, so the table may be broadcast whatever the input, and
    ``_parts``, by which a key's rows are dealt, sums to at most twice as many. The sketch combines
    in each task; a count that is off moves rows to other tasks and changes no result.
    """
    top = rows.select(F.xxhash64(key).alias("h")).agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h, {HEAVY_SHARE}, {TRACKED})").alias("top")).first()
    part = max(LEAST_ROWS, -(-top["n"] // HEAVY_SHARE))
    found = [(x["item"], -(-x["count"] // part)) for x in top["top"] if x["count"] > part]
    return rows.sparkSession.createDataFrame(found, "_heavy bigint, _parts int") if found else None


def heavy_counted(counts: DataFrame, key: str, n: str) -> DataFrame | None:
    """:func:`heavy_keys` from a table of exact counts, one row a key."""
    part = max(LEAST_ROWS, -(-(counts.agg(F.sum(n)).first()[0] or 0) // HEAVY_SHARE))
    found = counts.where(F.col(n) > part).select(F.xxhash64(key).alias("_heavy"), F.ceil(F.col(n) / part).cast("int").alias("_parts")).collect()
    return counts.sparkSession.createDataFrame(found, "_heavy bigint, _parts int") if found else None


def dealt(rows: DataFrame, key: str, heavy: DataFrame | None) -> DataFrame:
    """``rows`` with ``_part``: 0, or for a heavy key one of its parts, by a hash of the row."""
    if heavy is None:
        return rows.withColumn("_part", F.lit(0))
    row = F.xxhash64(*(F.col(c) for c in rows.columns if c != key), F.lit(0))
    joined = rows.join(F.broadcast(heavy), F.xxhash64(key) == F.col("_heavy"), "left")
    part = F.coalesce(F.pmod(row, F.col("_parts")), F.lit(0)).cast("int")
    return joined.withColumn("_part", part).select(*rows.columns, "_part")


def copied(facts: DataFrame, key: str, heavy: DataFrame | None) -> DataFrame:
    """``facts``, one row a key, with ``_part``: a copy for each part of a heavy key."""
    if heavy is None:
        return facts.withColumn("_part", F.lit(0))
    joined = facts.join(F.broadcast(heavy), F.xxhash64(key) == F.col("_heavy"), "left")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    return joined.withColumn("_part", parts).select(*facts.columns, "_part")


def spread_join(rows: DataFrame, facts: DataFrame, key: str, heavy: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``facts`` by ``key``, each heavy key's rows dealt to many tasks."""
    if heavy is None:
        return rows.join(facts, key, how)
    return dealt(rows, key, heavy).join(copied(facts, key, heavy), [key, "_part"], how).drop("_part")


def apart(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with columns of these names, which a result needs, renamed: an ``_in`` is put behind them."""
    return docs.withColumnsRenamed({name: unused(docs, name + "_in") for name in names if name in docs.columns})


def given(docs: DataFrame, *names: str) -> list[F.Column]:
    """The columns of ``docs`` by their own names, in a result that :func:`apart` has set some apart in."""
    return [F.col(unused(docs, c + "_in")).alias(c) if c in names else F.col(c) for c in docs.columns]


_claims: dict[str, Callable[[], None]] = {}
_last: list[str] = [""]


def give_back() -> None:
    """Return a worker's unused memory to the system: workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def claim(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Keep the caches of one operator at a time in a Python worker.

    Workers serve one stage after another; what the last owner has cached is cleared when
    another begins. ``clear`` empties the caches of ``owner``.
    """
    for other in [k for k in _claims if k != owner]:
        _claims.pop(other)()
    if _last[0] != owner:
        _last[0] = owner
        gc.collect()
        give_back()
    if clear:
        _claims[owner] = clear


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str
) -> DataFrame:
    """``mapInArrow`` over record batches.

    ``make`` runs once in each task and returns a function from a batch to a dict of
    column values (lists, numpy or Arrow arrays), or None for no rows.
    """
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(make.__module__)
        work = make()
        for batch in batches:
            out = work(batch)
            if out is not None:
                yield to_batch(out, target)
            del batch, out
        give_back()

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        value = columns[field.name]
        if not isinstance(value, (pa.Array, pa.ChunkedArray)):
            value = pa.array(value, type=field.type, from_pandas=False)
        elif value.type != field.type:
            value = value.cast(field.type)
        arrays.append(value)
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Whole texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """Whole texts of a batch as UTF-8; null is the empty text."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (shift-multiply finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@functools.cache
def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * U64(2) + U64(1)


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
