"""A table that runs change in place: buckets by key, copied on write, with a manifest a version.

A run reads the buckets of its keys, merges, and writes anew only buckets in which a row changed; the others stay the files of the
version that wrote them. A version is there once its manifest is written, so a run that dies leaves the last version as it was, and
readers of older versions keep their files until :func:`vacuum`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, materialise, scratch

BUCKETS = 64


@dataclass(frozen=True)
class Store:
    """``path`` in a file system that all share, ``key`` the column that a row has alone."""

    path: str
    key: str
    buckets: int = BUCKETS

    def _files(self, spark: SparkSession, sub: str) -> list[str]:
        context = spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{sub}")
        fs = at.getFileSystem(context._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self, spark: SparkSession) -> list[int]:
        """Versions whose manifest is whole, ascending."""
        return [int(v[1:]) for v in self._files(spark, "manifest") if "_SUCCESS" in self._files(spark, f"manifest/{v}")]

    def manifest(self, spark: SparkSession, version: int | None = None) -> dict[int, int]:
        """Bucket to the version that wrote it; empty before the first run."""
        known = self.versions(spark)
        version = (known[-1] if known else None) if version is None else version
        if version is None:
            return {}
        return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{self.path}/manifest/v{version:08d}").collect()}

    def read(self, spark: SparkSession, version: int | None = None, only: set[int] | None = None) -> DataFrame | None:
        """All rows of a version, or those of some buckets; None if there are none."""
        places = [f"{self.path}/data/v{v:08d}/_b={b}" for b, v in sorted(self.manifest(spark, version).items()) if only is None or b in only]
        return spark.read.option("mergeSchema", "true").parquet(*places) if places else None

    def bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def run(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> dict[str, int]:
        """Merge a batch into the last version: ``version, touched, rewritten`` buckets.

        ``merge(old, new)`` gives the rows that shall be there with a column ``change``, "kept" for those that stay as they are. Rows without a key
        are left out. A batch that changes nothing makes no version.
        """
        spark = batch.sparkSession
        batch = batch.where(F.col(self.key).isNotNull())
        with scratch():
            batch = materialise(batch)
            touched = {r[0] for r in batch.select(self.bucket()).distinct().collect()}
            old = self.read(spark, only=touched)
            old = batch.limit(0) if old is None else old
            done = materialise(merge(old, batch).withColumn("_b", self.bucket()))
            changed = {r["_b"] for r in done.where("change <> 'kept'").select("_b").distinct().collect()}
            known = self.versions(spark)
            last = known[-1] if known else 0
            if not changed:
                return {"version": last, "touched": len(touched), "rewritten": 0}
            rows = done.where(F.col("_b").isin(changed)).drop("change")
            version = last + 1
            rows.repartition(len(changed), "_b").write.partitionBy("_b").mode("overwrite").parquet(f"{self.path}/data/v{version:08d}")
            kept = self.manifest(spark) | dict.fromkeys(sorted(changed), version)
            told = spark.createDataFrame(sorted(kept.items()), "bucket int, version long")
            told.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{version:08d}")  # of a run that died before, if there is one
        return {"version": version, "touched": len(touched), "rewritten": len(changed)}

    def vacuum(self, spark: SparkSession) -> int:
        """Delete what the last version does not use: older manifests, buckets written anew, runs that died. The number of folders deleted."""
        known, kept, gone = self.versions(spark), self.manifest(spark), 0
        for v in self._files(spark, "manifest"):
            if int(v[1:]) != (known[-1] if known else 0):
                delete(spark, f"{self.path}/manifest/{v}")
                gone += 1
        for v in self._files(spark, "data"):
            for b in self._files(spark, f"data/{v}"):
                if b.startswith("_b=") and kept.get(int(b[3:])) != int(v[1:]):
                    delete(spark, f"{self.path}/data/{v}/{b}")
                    gone += 1
        return gone
