"""Operator 12: whitening of embeddings by TSQR, without a covariance matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _arrow_schema, claim, materialise, release, scratch

#: R factors that one task of the tree merges.
FAN_IN = 16
#: Entries from this size on, after scaling, are out of range.
LIMIT = 1 << 31


def quantised(vector: str, scale: int) -> Column:
    """floor(scale * c) of each entry as int; null unless all entries are there, finite and in range."""
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    fits = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * scale) < LIMIT))
    return F.when(fits, scaled.cast("array<int>"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n: the whole part is subtracted in integers, only the fraction in doubles."""
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(float) - part


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - sums)^2 a row, exact; null beyond a long. Wide values take Python's integers."""
    far = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums)) if x.size else 0
    if x.shape[1] * far * far < 1 << 63:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    rows = (sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x)
    return [v if v < 1 << 63 else None for v in rows]


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def exact_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and their sum in each dimension: integers, added up in each task first."""
    each = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at")
    found = {r["at"]: r for r in each.agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()}
    return found[0]["n"], [int(found[i]["s"]) for i in range(width)]


def leaf_factors(fit: DataFrame, width: int, n: int, sums: list[int]) -> DataFrame:
    """``leaf, r``: the R factor of each partition's centred rows, updated batch by batch."""
    schema = "leaf bigint, r array<double>"
    target = _arrow_schema(fit.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        r = None
        for batch in batches:
            if batch.num_rows:
                rows = _centred(_matrix(batch.column("x"), width), n, sums)
                r = _triangle(rows if r is None else np.vstack([r, rows]))
        if r is not None:
            yield pa.RecordBatch.from_pydict({"leaf": [TaskContext.get().partitionId()], "r": [r.reshape(-1)]}, schema=target)

    return fit.select("x").mapInArrow(run, schema)


def merged(factors: DataFrame, width: int) -> DataFrame:
    """One level of the tree: each ``FAN_IN`` factors stacked, in order of their leaf, and factored again."""

    def merge(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("leaf").to_numpy(), kind="stable")
        parts = table.column("r").to_pylist()
        r = _triangle(np.vstack([np.array(parts[i]).reshape(-1, width) for i in order]))
        leaf = int(table.column("leaf")[0].as_py()) // FAN_IN
        return pa.table({"leaf": pa.array([leaf], pa.int64()), "r": pa.array([r.reshape(-1).tolist()], pa.list_(pa.float64()))})

    return factors.groupBy(F.floor(F.col("leaf") / FAN_IN)).applyInArrow(merge, "leaf bigint, r array<double>")


def tsqr(fit: DataFrame, width: int, n: int, sums: list[int]) -> np.ndarray:
    """R of all centred rows: ``width`` columns, so all that the driver gets. Each level is a table, cut off from the last."""
    factors = materialise(leaf_factors(fit, width, n, sums))
    last = factors.agg(F.max("leaf")).first()[0]
    while last:
        last //= FAN_IN
        above = materialise(merged(factors, width))
        release(factors)
        factors = above
    return np.array(factors.first()["r"]).reshape(-1, width)


@dataclass
class Whitening:
    """``directions``: a column a component, divided by the root of its eigenvalue."""

    n: int
    sums: list[int]
    width: int
    directions: np.ndarray
    explained: list[float]
    identity_error: float = float("nan")

    @classmethod
    def of(cls, r: np.ndarray, n: int, sums: list[int], components: int) -> Whitening:
        """From R's singular values s and right vectors: eigenvalues are s^2 / n.

        Directions in which all rows agree, up to rounding, cannot be whitened and are left out. The largest
        entry of a component is positive, the first of equal ones.
        """
        _, s, v = np.linalg.svd(r, full_matrices=False)
        real = int((s > s.max(initial=0) * max(r.shape) * np.finfo(float).eps).sum())
        v = v[: min(components, real)]
        v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]
        e = s * s / n
        return cls(n, sums, r.shape[1], (v / np.sqrt(e[: len(v)])[:, None]).T, (e[: len(v)] / e.sum()).tolist() if len(v) else [])

    def project(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums) @ self.directions


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of (whitened fit list's covariance - identity): one small matrix of sums a task."""
    k = model.directions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        total = np.zeros((k, k))
        for batch in batches:
            z = model.project(_matrix(batch.column("x"), model.width))
            total += z.T @ z
        flat = total.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(flat)], ["at", "v"])

    sums = fit.select("x").mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    cov = np.zeros(k * k)
    for row in sums:
        cov[row["at"]] = row["v"] / model.n
    return float(np.abs(cov.reshape(k, k) - np.eye(k)).max(initial=0))


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component.

    Entries become x = floor(scale * c) + offset. The fit list is each distinct x once: partial aggregates
    combine repeats before the shuffle, so a vector that a third of the rows hold is one row a task. Its count n and
    sums S are exact integers; rows are centred by them, factored a partition at a time, the R factors merged
    in a tree, and only the last R, ``width`` squared values, comes to the driver.

    Left out are rows whose vector is null or holds null or non-finite entries, or one of ``LIMIT`` or more after
    scaling, and rows whose vector has another length than most (the longer of equally frequent ones). Null
    and repeated ids stay, repeated rows too. Components without variance are left out, so one distinct
    vector, an empty table or empty vectors give no rows. ``deviation`` is null where it exceeds a long. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).alias("vec_id"), quantised(vector, scale).alias("x")).where("x IS NOT NULL")
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    with scratch():
        fit = materialise(rows.select("x").distinct())
        found = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
        width = found["width"] if found else 0
        if not width:
            return spark.createDataFrame([], schema)
        same = F.size("x") == width
        fit = fit.where(same)
        n, sums = exact_sums(fit, width)
        model = Whitening.of(tsqr(fit, width, n, sums), n, sums, components)
        if not model.explained:
            return spark.createDataFrame([], schema)
        model.identity_error = identity_error(fit, model)
    k = len(model.explained)
    target = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch.column("x"), width)
            columns = [
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)),
                pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(model.project(x).reshape(-1)),
                pa.array(np.tile(model.explained, m)),
                pa.array(np.full(m * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return rows.where(same).mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
