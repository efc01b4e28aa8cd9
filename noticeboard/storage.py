"""Intermediate tables in the folder that driver and executors share.

A written table cuts the lineage and outlives any executor. Tables written inside :func:`scratch`
are deleted when it ends, but for the one it keeps; what is left goes with :func:`clean`, at the
latest when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

_open: list[list[str]] = []
_left: dict[str, SparkSession] = {}


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder stands in for local masters only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), f"noticeboard-{os.getuid()}")
    return base.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name under the shared folder, deleted with the scope that asks for it."""
    path = f"{shared_base(spark)}/{uuid.uuid4().hex}"
    _left[path] = spark
    if _open:
        _open[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._noticeboard_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_noticeboard_path", None)
        if path and _left.pop(path, None):
            delete(df.sparkSession, path)


@contextmanager
def scratch() -> Iterator:
    """A scope whose tables are deleted at its end. It yields ``keep``, which writes a result that stays."""
    _open.append([])

    def keep(df: DataFrame) -> DataFrame:
        out = materialise(df)
        _open[-1].remove(out._noticeboard_path)
        if len(_open) > 1:
            _open[-2].append(out._noticeboard_path)
        return out

    try:
        yield keep
    finally:
        for path in _open.pop():
            if spark := _left.pop(path, None):
                delete(spark, path)


def clean(spark: SparkSession | None = None) -> None:
    """Delete all tables that are left, of one session or of all."""
    for path, owner in list(_left.items()):
        if spark is None or owner is spark:
            del _left[path]
            with suppress(Exception):  # the context may have ended
                delete(owner, path)


atexit.register(clean)
