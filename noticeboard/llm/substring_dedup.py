"""Operator 5: substring dedup with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words. Its fingerprint is the least hash among the
anchors (shorter word runs) inside it, so equal windows have equal fingerprints wherever
they stand, while neighbouring windows mostly share one: a text has about one fingerprint
for each 13 words. The index keeps fingerprints in sorted immutable runs; a new batch is
merge-joined with them, and only texts that share a fingerprint have their windows
compared, by two independent 64-bit hashes. The index lives in a folder with a manifest, so that a
later session can open it and add its own batch.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, bytes_of, documents, heavy_counted, heavy_keys, map_batches, materialise, mix64, release, scratch, shared_dir, spread_join

WINDOW, ANCHOR = 50, 25
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
NOTHING = hashlib.sha256(b"").hexdigest()


def _power(which: int, n: int) -> np.ndarray:
    """base ** i, or the inverse's powers, for i below n; kept up to a bound."""
    if len(_powers[which]) >= n:
        return _powers[which][:n]
    factors = np.full(max(n, 1 << 14), _INVERSE if which else _BASE, np.uint64)
    factors[0] = 1
    made = np.cumprod(factors, dtype=np.uint64)
    if len(made) <= 1 << 20:
        _powers[which] = made
    return made[:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)


def run_hashes(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash of every run of ``k`` words: a polynomial of scrambled word hashes, from prefix sums."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(h ^ U64(seed)) * _power(0, n), out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * _power(1, n - k + 1))


def sliding_min(a: np.ndarray, k: int) -> np.ndarray:
    """The least of every ``k`` neighbours, by doubling."""
    size = 1
    while 2 * size <= k:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    rest = k - size
    return np.minimum(a[:-rest], a[rest:]) if rest else a


def fingerprints(h: np.ndarray) -> np.ndarray:
    """The fingerprint of every window, by its first word."""
    if len(h) < WINDOW:
        return np.zeros(0, np.uint64)
    return sliding_min(run_hashes(h, ANCHOR, 1), WINDOW - ANCHOR + 1)


def read_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_words, all_sha256, fps``: fps are the text's distinct fingerprints."""

    def make():
        def work(batch):
            out = {k: [] for k in ("text_hash", "n_words", "all_sha256", "fps")}
            for text in bytes_of(batch):
                words = text.split()
                joined = b" ".join(words)
                out["text_hash"].append(hashlib.blake2b(joined, digest_size=16).digest())
                out["n_words"].append(len(words))
                out["all_sha256"].append(hashlib.sha256(joined).hexdigest())
                out["fps"].append(np.unique(fingerprints(word_hashes(words))).view(np.int64) if len(words) >= WINDOW else [])
            return out | {"doc_id": batch.column("doc_id")}

        return work

    return map_batches(docs, make, "doc_id bigint, text_hash binary, n_words bigint, all_sha256 string, fps array<bigint>")


#: Settings under which a run's sorted buckets are read as sorted and grouped as they come.
SORTED = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.execution.replaceHashWithSortAgg": "true", "spark.sql.autoBroadcastJoinThreshold": "-1"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with some settings, put back at the end."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@dataclass(frozen=True)
class Run:
    """An immutable run: its folder's name, level and buckets, and ``fp, least owner, largest owner`` of its heavy fps."""

    name: str
    level: int
    buckets: int
    heavy: list[list[int]]


class FingerprintIndex:
    """A log-structured index of ``fp, owner`` rows in the folder ``path``; ``owner`` is a document's id.

    A batch becomes a run: rows bucketed and sorted by fp, but for those of fps that more than one in
    1024 of its rows have (so fewer than 1024), which lie apart in ``heavy`` and meet others by
    broadcasts. Runs are merge-joined bucket by bucket, without a shuffle or a sort. A run also has
    ``texts``: ``text_hash, first_id``. ``fan_out`` runs of one level are merged into one of the
    next by :meth:`compact`, so a row is written again once a level. The manifest with the
    largest number names the runs; it is written last, so an addition that fails leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fan_out: int = 4):
        self.spark, self.path, self.fan_out = spark, path.rstrip("/"), fan_out
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.runs, made = 0, [], self._versions()
        if made:
            self.version = made[-1]
            self.runs = [Run(**r) for r in json.loads(spark.read.text(self._manifest(self.version)).first()[0])]

    def _fs(self, path: str):
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(context._jsc.hadoopConfiguration()), at

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest/{version:08d}"

    def _versions(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/manifest")
        if not fs.exists(at):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return sorted(int(n) for n in names if fs.exists(self._fs(f"{self.path}/manifest/{n}/_SUCCESS")[1]))

    def _commit(self, runs: list[Run]) -> None:
        told = json.dumps([asdict(r) for r in runs])
        self.spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(self._manifest(self.version + 1))
        self.version, self.runs = self.version + 1, runs

    def _name(self, run: Run, part: str) -> str:
        return f"noticeboard_{hashlib.md5(self.path.encode()).hexdigest()[:12]}_{run.name}_{part}"

    def _table(self, run: Run, part: str) -> DataFrame:
        """A part of a run; the catalogue learns of its buckets in the first session that reads it."""
        columns, key = {"rows": ("fp bigint, owner bigint", "fp, owner"), "texts": ("text_hash binary, first_id bigint", "text_hash, first_id")}[part]
        name = self._name(run, part)
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key.split(',')[0]}) SORTED BY ({key}) "
                f"INTO {run.buckets} BUCKETS LOCATION '{self.path}/runs/{run.name}/{part}'"
            )
        return self.spark.table(name)

    def _heavy(self, run: Run) -> DataFrame:
        return self.spark.read.schema("fp bigint, owner bigint").parquet(f"{self.path}/runs/{run.name}/heavy")

    def _heads(self, run: Run) -> DataFrame:
        """``fp, lo, hi`` of the run's heavy fps."""
        return self.spark.createDataFrame([tuple(x) for x in run.heavy], "fp bigint, lo bigint, hi bigint")

    def _write(self, rows: DataFrame, texts: DataFrame, level: int) -> Run:
        run = Run(f"r{self.version + 1:08d}", level, self.buckets, [])
        at = f"{self.path}/runs/{run.name}"
        fs, folder = self._fs(at)
        fs.delete(folder, True)  # of an addition that failed
        heavy = heavy_keys(rows, "fp")
        fps = F.xxhash64("fp")
        common = rows.join(F.broadcast(heavy), fps == F.col("_heavy"), "left_semi") if heavy is not None else rows.limit(0)
        rest = rows.join(F.broadcast(heavy), fps == F.col("_heavy"), "left_anti") if heavy is not None else rows
        common.write.option("compression", "zstd").parquet(f"{at}/heavy")
        for part, table, key, more in (("rows", rest, "fp", "owner"), ("texts", texts, "text_hash", "first_id")):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(run, part)}")
            (
                table.repartition(run.buckets, key)
                .write.option("compression", "zstd").option("path", f"{at}/{part}")
                .bucketBy(run.buckets, key).sortBy(key, more).saveAsTable(self._name(run, part))
            )
        heads = self._heavy(run).groupBy("fp").agg(F.min("owner"), F.max("owner")).collect()
        return Run(run.name, level, run.buckets, sorted(list(h) for h in heads))

    def known_texts(self, texts: DataFrame) -> DataFrame:
        """``texts(text_hash, first_id, ...)`` with ``known_id``: the smallest id that the index has for the text, or null."""
        out = texts.withColumn("known_id", F.lit(None).cast("bigint"))
        for run in self.runs:
            old = self._table(run, "texts").groupBy("text_hash").agg(F.min("first_id").alias("_old"))
            out = out.join(old, "text_hash", "left").withColumn("known_id", F.least("known_id", "_old")).drop("_old")
        return out

    def add(self, rows: DataFrame, texts: DataFrame) -> DataFrame:
        """Add a run of ``fp, owner`` and ``text_hash, first_id``; returns the rows, old and new, whose fp another owner has too.

        Old rows come back only if the batch has their fp. Compaction is left to :meth:`compact`.
        """
        new = self._write(rows, texts, 0)
        edges = lambda t: t.groupBy("fp").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"))
        mine, my_heads = self._table(new, "rows"), self._heads(new)
        spread = edges(mine)
        found = [mine.join(spread.where("lo <> hi").select("fp"), "fp", "left_semi")]
        few = my_heads.where("lo <> hi").select("fp")
        with settings(self.spark, SORTED):
            for run in self.runs:
                old, heads = self._table(run, "rows"), self._heads(run)
                theirs = edges(old)

                def shared(a: DataFrame, b: DataFrame) -> DataFrame:
                    b = b.select("fp", F.col("lo").alias("old_lo"), F.col("hi").alias("old_hi"))
                    return a.join(b, "fp").where("least(lo, old_lo) <> greatest(hi, old_hi)").select("fp")

                met = shared(spread, theirs)
                found += [mine.join(met, "fp", "left_semi"), old.join(met, "fp", "left_semi")]
                some = shared(spread, F.broadcast(heads)).union(shared(theirs, F.broadcast(my_heads))).union(shared(my_heads, heads))
                some = materialise(some.distinct())  # fps that are heavy in one of the two runs
                found += [old.join(F.broadcast(some), "fp", "left_semi"), self._heavy(run).join(F.broadcast(some), "fp", "left_semi")]
                few = few.union(some)
            few = materialise(few.distinct())
            found += [mine.join(F.broadcast(few), "fp", "left_semi"), self._heavy(new).join(F.broadcast(few), "fp", "left_semi")]
            out = found[0]
            for more in found[1:]:
                out = out.unionByName(more)
            out = materialise(out)
        self._commit([*self.runs, new])
        return out

    def compact(self) -> None:
        """Merge the runs of each level that has ``fan_out`` of them into one run of the next level."""
        level = 0
        while any(r.level >= level for r in self.runs):
            full = [r for r in self.runs if r.level == level]
            if len(full) >= self.fan_out:
                rows = texts = None
                for run in full:
                    mine = self._table(run, "rows").unionByName(self._heavy(run))
                    rows = mine if rows is None else rows.unionByName(mine)
                    told = self._table(run, "texts")
                    texts = told if texts is None else texts.unionByName(told)
                merged = self._write(rows, texts, level + 1)
                self._commit([r for r in self.runs if r not in full] + [merged])
                for run in full:
                    self._forget(run)
            level += 1

    def _forget(self, run: Run) -> None:
        for part in ("rows", "texts"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(run, part)}")
        fs, at = self._fs(f"{self.path}/runs/{run.name}")
        fs.delete(at, True)

    def drop(self) -> None:
        """Delete the index."""
        for run in self.runs:
            self._forget(run)
        fs, at = self._fs(self.path)
        fs.delete(at, True)
        self.version, self.runs = 0, []


def shared_windows(candidates: DataFrame) -> DataFrame:
    """``doc_id, window``: windows of ``candidates(doc_id, text, fps)`` that a smaller id has too.

    Only windows whose fingerprint is listed are made. The smallest id of each window is found
    by a partial aggregate before the shuffle, however many texts share the window.
    """

    def make():
        def work(batch):
            ids, one, two = [], [], []
            for doc_id, text, fps in zip(batch.column("doc_id").to_pylist(), bytes_of(batch), batch.column("fps").to_pylist()):
                h = word_hashes(text.split())
                if len(h) < WINDOW:
                    continue
                hit = np.isin(fingerprints(h), np.array(fps, np.int64).view(np.uint64))
                a, b = run_hashes(h, WINDOW, 2)[hit], run_hashes(h, WINDOW, 3)[hit]
                a, at = np.unique(a, return_index=True)
                ids.append(np.full(len(a), doc_id, np.int64))
                one.append(a.view(np.int64))
                two.append(b[at].view(np.int64))
            if not ids:
                return None
            return {"doc_id": np.concatenate(ids), "window": np.concatenate(one), "check": np.concatenate(two)}

        return work

    rows = map_batches(candidates.select("doc_id", "text", "fps"), make, "doc_id bigint, window bigint, check bigint")
    rows = materialise(rows)
    first = rows.groupBy("window", F.col("check").alias("_check")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    first = materialise(first.where("first < last"))
    met = spread_join(rows, first.select("window", "_check", "first"), "window", heavy_counted(first, "window", "n"))
    return met.where("check = _check AND doc_id > first").select("doc_id", "window")


def cut(rows: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_words, n_removed, kept_sha256`` of ``rows(doc_id, text, windows)``."""

    def make():
        def work(batch):
            out = {k: [] for k in ("text_hash", "n_words", "n_removed", "kept_sha256")}
            for text, windows in zip(bytes_of(batch), batch.column("windows").to_pylist()):
                words = text.split()
                out["text_hash"].append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                kept = remove_windows(words, np.array(windows, np.int64).view(np.uint64))
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            return out | {"doc_id": batch.column("doc_id")}

        return work

    return map_batches(rows.select("doc_id", "text", "windows"), make, "doc_id bigint, text_hash binary, n_words bigint, n_removed bigint, kept_sha256 string")


def remove_windows(words: list[bytes], windows: np.ndarray) -> list[bytes]:
    """The words that no window with a listed hash covers."""
    hit = np.isin(run_hashes(word_hashes(words), WINDOW, 2), windows)
    if not hit.any():
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return [w for w, c in zip(words, covered) if not c]


def index_batch(index: FingerprintIndex, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add ``docs(doc_id, text)`` to the index: their ``rows``, their ``texts`` and the ``fp, owner`` rows found.

    ``rows`` has ``doc_id, text_hash, n_words, all_sha256``; ``texts`` has ``text_hash, first_id`` (the smallest
    id of the index or the batch) and ``n``, for texts that fill a window. A text of the index is not added again.
    """
    wide = materialise(read_texts(docs))
    long = wide.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    mine = long.groupBy("text_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.any_value("fps").alias("fps"))
    texts = materialise(index.known_texts(mine))
    rows = materialise(wide.drop("fps"))
    release(wide)
    fresh = texts.where("known_id IS NULL OR first_id < known_id")
    found = index.add(fresh.select(F.explode("fps").alias("fp"), F.col("first_id").alias("owner")), fresh.select("text_hash", "first_id"))
    told = materialise(texts.select("text_hash", F.least("first_id", "known_id").alias("first_id"), "n"))
    release(texts)  # with all fps, which the run has now
    return rows, told, found


def removals(docs: DataFrame, rows: DataFrame, texts: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of ``rows``; ``docs`` has the texts of all ids that ``found`` names.

    A common passage's fps and windows and a text with very many copies are dealt to many tasks.
    """
    suspects = found.groupBy(F.col("owner").alias("doc_id")).agg(F.collect_set("fp").alias("fps"))
    candidates = materialise(docs.join(suspects, "doc_id"))
    removed = shared_windows(candidates).groupBy("doc_id").agg(F.collect_set("window").alias("windows"))
    done = materialise(cut(candidates.join(removed, "doc_id")).distinct())

    heavy = heavy_counted(texts, "text_hash", "n")
    told = spread_join(rows.where(F.col("n_words") >= WINDOW), texts.select("text_hash", "first_id"), "text_hash", heavy, "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    whole = told.where(copy).select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(NOTHING).alias("kept_sha256"))
    rest = told.where(~copy & F.col("doc_id").isNotNull()).drop("first_id")
    rest = rest.join(done.select("doc_id", "text_hash", "n_removed", "kept_sha256"), ["doc_id", "text_hash"], "left")
    alone = rows.where((F.col("n_words") < WINDOW) | F.col("doc_id").isNull()).withColumns({"n_removed": F.lit(0), "kept_sha256": F.lit(None).cast("string")})
    rest = rest.unionByName(alone.select(rest.columns))
    rest = rest.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"))
    return whole.unionByName(rest)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def dedup_batch(index: FingerprintIndex, docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Add a batch to a lasting index and remove from it what earlier documents have; rows as :func:`dedup_substrings`.

    ``history(doc_id, text)`` is the table of the documents added before; only texts that the index
    finds are compared. Words go if a window over them also starts in a document of smaller id,
    of this batch or before; what an earlier batch was given is not judged again.
    """
    with scratch() as keep:
        docs = _plain(docs)
        rows, texts, found = index_batch(index, docs)
        return keep(removals(docs if history is None else docs.unionByName(_plain(history)), rows, texts, found))


def dedup_substrings(docs: DataFrame, batches: int = 3, fan_out: int = 2) -> DataFrame:
    """Remove every word that a window covers whose words also start in a document of smaller id.

    Documents come in ``batches`` of ascending ids, as they would day by day; each is matched with
    the index of all before it, and between batches ``fan_out`` runs of a level become one: by default
    the third batch meets the first two as one compacted run. A text whose words equal an earlier text's
    is decided by that alone and is not indexed again. Windows are judged on the input. The index is dropped
    at the end, without a last compaction; :func:`dedup_batch` works on one that stays.

    One row a document: ``doc_id, n_words, n_removed, kept_sha256`` (kept words joined by one
    space). Null and empty texts have no words; texts under a window lose none. Rows with a null
    id lose none and cost others none. Rows of one id don't count as each other's earlier text.
    An empty table gives no rows. Other columns are not read.
    """
    spark, docs = docs.sparkSession, _plain(docs)
    with scratch() as keep:
        ends = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
        index, parts = FingerprintIndex(spark, shared_dir(spark), fan_out=fan_out), []
        for lo, hi in zip([None, *ends], [*ends, None]):
            batch = docs if lo is None else docs.where(F.col("doc_id") > lo)
            batch = batch if hi is None else batch.where((F.col("doc_id") <= hi) | (F.col("doc_id").isNull() & F.lit(lo is None)))
            if parts:
                index.compact()
            parts.append(index_batch(index, batch))
        rows, texts, found = parts[0]
        for more_rows, more_texts, more_found in parts[1:]:
            rows, texts, found = rows.unionByName(more_rows), texts.unionByName(more_texts), found.unionByName(more_found)
        texts = materialise(texts.groupBy("text_hash").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n")))
        out = keep(removals(docs, rows, texts, found))
        index.drop()
        return out


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir))


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(ws) - 48)) AS u(i)
), firsts AS (
  SELECT h, min(doc_id) AS first FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, i + k AS j FROM windows JOIN firsts USING (h), range(50) AS r(k) WHERE first < doc_id
), kept AS (
  SELECT doc_id, j, ws[j] AS word FROM w, unnest(range(1, len(ws) + 1)) AS u(j) WHERE (doc_id, j) NOT IN (SELECT (doc_id, j) FROM gone)
), told AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM kept GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN told USING (doc_id)
"""
