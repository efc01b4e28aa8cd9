"""Two data sources: pages of many sources, where one that fails does so alone, and a folder of rendered pages, written in two phases.

``SourcePages`` plans a partition for each source, and more for a large one. What goes wrong in a source is a row with ``error``; the other
sources' rows are as they are. ``PageFolder`` lets each task stage its pages in a folder of its own. The commit names the folders of
the tasks that ended in one marker, and only then :func:`finish` moves the pages to their places, one rename each: a reader sees a page of the last run
or of this one, never half of one. A task that is killed or runs twice leaves a folder that no marker names.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.text import text
from ..operators import merge
from ..operators.store import Store
from ..storage import materialise, scratch

PAGES = "source string, page_id long, url string, html string, status int, error string"
#: Bytes of a source that one task reads, more or less: whole row groups and files.
SLICE = 128 << 20
#: Sources of one scan; their list is kept by hand and travels with the plan.
MOST_SOURCES = 100_000
_TYPES = {"page_id": pa.int64(), "url": pa.string(), "html": pa.string(), "status": pa.int32()}
_ARROW = pa.schema([("source", pa.string()), *_TYPES.items(), ("error", pa.string())])
#: What a source can do wrong; other faults end the task, which Spark tries again.
FAULTS = (OSError, pa.ArrowException, ValueError)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Slice(InputPartition):
    """Part ``slot`` of ``slots`` of a source's files: row groups of a table in turn, or whole pages."""

    source: str
    files: tuple[str, ...]
    slot: int = 0
    slots: int = 1
    error: str | None = None


def _slices(name: str, path: str, size: int) -> list[Slice]:
    try:
        store, at = opened(path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        files = [info]
        if info.type == fs.FileType.Directory:
            files = sorted(store.get_file_info(fs.FileSelector(at, recursive=True)), key=lambda x: x.path)
            files = [x for x in files if x.is_file and not x.base_name.startswith(("_", "."))]
    except FAULTS as e:
        return [Slice(name, (), error=_told(e))]
    out: list[Slice] = []
    pages: list[str] = []
    held = 0
    for x in files:
        if x.extension == "parquet":
            slots = max(1, -(-x.size // size))
            out += [Slice(name, (x.path,), k, slots) for k in range(slots)]
            continue
        pages.append(x.path)
        held += x.size
        if held >= size:
            out.append(Slice(name, tuple(pages)))
            pages, held = [], 0
    return out + ([Slice(name, tuple(pages))] if pages else [])


def _told(e: BaseException) -> str:
    return f"{type(e).__name__}: {e}"[:500]


def _batch(source: str, columns: dict[str, pa.Array], n: int, error: str | None = None) -> pa.RecordBatch:
    """A batch of the pages' schema; columns that a source lacks are null."""
    arrays = [pa.array([source] * n, pa.string())]
    arrays += [columns[k] if k in columns else pa.nulls(n, t) for k, t in _TYPES.items()]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([error] * n, pa.string())], schema=_ARROW)


def _table_pages(source: str, store: fs.FileSystem, file: str, slot: int, slots: int) -> Iterator[pa.RecordBatch]:
    with store.open_input_file(file) as f:
        table = pq.ParquetFile(f)
        have = [k for k in _TYPES if k in table.schema_arrow.names]
        if "html" not in have:
            raise ValueError("no column html")
        groups = list(range(slot, table.num_row_groups, slots))
        for rows in table.iter_batches(256, row_groups=groups, columns=have):
            yield _batch(source, {k: rows.column(k).cast(_TYPES[k]) for k in have}, rows.num_rows)


class SourceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.sources = json.loads(options["sources"])
        self.roots = {name: path for name, path in self.sources}
        self.size = int(options.get("slice", SLICE))

    def partitions(self) -> list[Slice]:
        """Each source's slices; folders and sizes are looked up, no file is read."""
        with ThreadPoolExecutor(32) as pool:
            found = pool.map(lambda s: _slices(s[0], s[1], self.size), self.sources)
        return [x for part in found for x in part] or [Slice("", ())]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        name = partition.source
        if partition.error:
            yield _batch(name, {}, 1, partition.error)
        for file in partition.files:
            try:
                store, _ = opened(self.roots[name])
                if file.endswith(".parquet"):
                    yield from _table_pages(name, store, file, partition.slot, partition.slots)
                else:
                    with store.open_input_stream(file) as f:
                        page = f.read().decode("utf-8", "replace")
                    yield _batch(name, {"url": pa.array([file]), "html": pa.array([page])}, 1)
            except FAULTS as e:
                yield _batch(name, {"url": pa.array([file])}, 1, _told(e))


class SourcePages(DataSource):
    """``spark.read.format("source_pages")`` with ``sources``, a JSON list of names and paths."""

    @classmethod
    def name(cls) -> str:
        return "source_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> SourceReader:
        return SourceReader(self.options)


def source_pages(spark: SparkSession, sources: list[tuple[str, str]] | DataFrame, slice_bytes: int = SLICE) -> DataFrame:
    """``source, page_id, url, html, status, error``: the pages of all sources, and a row with ``error`` for what fails.

    A source is a name and the path of a Parquet file with ``html``, of a folder of such files, or of a folder of pages as files;
    or ``sources(name, url)`` as :func:`read_sources` gives it. A path that is missing, a file that is broken and a table without ``html``
    are error rows of that source. An empty folder gives no row. Of a repeated name the first path counts.
    """
    if isinstance(sources, DataFrame):
        sources = [tuple(r) for r in sources.select("name", "url").limit(MOST_SOURCES + 1).collect()]
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: scan them in several runs")
    named: dict[str, str] = {}
    for name, path in sources:
        named.setdefault(name, path)
    spark.dataSource.register(SourcePages)
    return spark.read.format("source_pages").option("sources", json.dumps(list(named.items()))).option("slice", slice_bytes).load()


def scan_outcome(pages: DataFrame) -> DataFrame:
    """``source, pages, chars, errors, status`` of each source that gave a row: failed if it gave no page, partial if some of it failed."""
    good = F.col("error").isNull()
    out = pages.groupBy("source").agg(
        F.count_if(good).alias("pages"), F.sum(F.when(good, F.length(text("html"))).otherwise(0)).alias("chars"), F.count_if(~good).alias("errors")
    )
    return out.withColumn("status", F.when(F.col("pages") == 0, "failed").when(F.col("errors") > 0, "partial").otherwise("ok"))


# Pages to a folder.


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    pages: int


class PageWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"

    def write(self, iterator) -> Staged:
        store, at = opened(self.root)
        folder = f"{at}/_staged/{self.run}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        n = 0
        for row in iterator:
            name = row["page"]
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"no name of a page: {name!r}")
            with store.open_output_stream(f"{folder}/{name}", compression=None) as f:
                f.write((row["html"] or "").encode())
            n += 1
        return Staged(folder, n)

    def commit(self, messages) -> None:
        """The marker is written under another name and renamed, so it is whole or not there."""
        store, at = opened(self.root)
        store.create_dir(f"{at}/_pending", recursive=True)
        draft, marker = f"{at}/_staged/{self.run}/marker", f"{at}/_pending/{self.run}"
        store.create_dir(f"{at}/_staged/{self.run}", recursive=True)
        with store.open_output_stream(draft, compression=None) as f:
            f.write(json.dumps([[m.folder, m.pages] for m in messages if m and m.pages]).encode())
        store.move(draft, marker)

    def abort(self, messages) -> None:
        store, at = opened(self.root)
        if store.get_file_info(f"{at}/_staged/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/_staged/{self.run}")


class PageFolder(DataSource):
    """``df.write.format("page_folder")`` for ``page, html``; :func:`finish` puts the pages in their places."""

    @classmethod
    def name(cls) -> str:
        return "page_folder"

    def writer(self, schema, overwrite: bool) -> PageWriter:
        if overwrite:
            raise ValueError("pages are added or replaced one by one: use mode append")
        return PageWriter(self.options["path"])


def stage(pages: DataFrame, path: str) -> None:
    """The first phase: ``pages(page, html)`` are staged and the run is committed; no page has changed yet."""
    pages.sparkSession.dataSource.register(PageFolder)
    pages.select("page", "html").write.format("page_folder").mode("append").save(path)


def _names(path: str) -> list[str]:
    store, at = opened(path)
    if store.get_file_info(at).type != fs.FileType.Directory:
        return []
    return sorted(x.base_name for x in store.get_file_info(fs.FileSelector(at)))


def finish(spark: SparkSession, path: str) -> int:
    """The second phase, for all committed runs in their order: each page is renamed to its place. The number of runs.

    It may be repeated, by a later run too: what a run that died had moved is gone from its folder.
    """
    root = path.rstrip("/")
    store, at = opened(root)

    def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there, top = opened(root)
        for b in batches:
            for folder in b["folder"]:
                for x in there.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                    try:
                        there.move(x.path, f"{top}/{x.base_name}")
                    except FileNotFoundError:  # another attempt of this task has moved it
                        pass
            yield b[["folder"]]

    runs = _names(f"{root}/_pending")
    for run in runs:
        with store.open_input_stream(f"{at}/_pending/{run}", compression=None) as f:
            folders = json.loads(f.read())
        if folders:
            tasks = spark.createDataFrame([(x, n) for x, n in folders], "folder string, pages long").repartition(len(folders))
            tasks.mapInPandas(moved, "folder string").write.format("noop").mode("overwrite").save()
        store.delete_file(f"{at}/_pending/{run}")
        store.delete_dir(f"{at}/_staged/{run}")
    return len(runs)


def sweep(path: str, seconds: int = 86_400) -> int:
    """Delete staged runs that no marker names and that began so long ago: tasks that outlived their run. The number deleted."""
    root = path.rstrip("/")
    store, at = opened(root)
    live, limit = set(_names(f"{root}/_pending")), time.time_ns() - seconds * 10**9
    old = [run for run in _names(f"{root}/_staged") if run not in live and int(run.split("-")[0]) <= limit]
    for run in old:
        store.delete_dir(f"{at}/_staged/{run}")
    return len(old)


def _latest(old: DataFrame, new: DataFrame) -> DataFrame:
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.page") == F.col("n.page"), "full_outer")
    fresh = F.col("n.page").isNotNull() & ~F.col("o.digest").eqNullSafe(F.col("n.digest"))
    value = lambda k: F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k)
    return both.select(value("page"), value("digest"), F.when(fresh, "changed").otherwise("kept").alias("change"))


def write_changed(pages: DataFrame, path: str) -> dict[str, int]:
    """Write the pages that differ from what the folder holds: ``pages, written``.

    ``pages(page, html)``; of a repeated name the least text is written, null text is an empty page, and a null or empty name, one with a slash or one
    that begins with a dot or an underscore is an error. Digests are kept in a store beside the pages and are brought up to date last: a
    run that dies before has its pages written once more by the next. Other pages of the folder stay.
    """
    spark = pages.sparkSession
    digests = Store(f"{path.rstrip('/')}/_digests", "page")
    finish(spark, path)
    sweep(path)
    with scratch():
        made = materialise(pages.groupBy("page").agg(F.min(text("html")).alias("html")))
        known = digests.read(spark)
        known = spark.createDataFrame([], "page string, digest string") if known is None else known.select("page", "digest")
        fresh = materialise(merge.changed_outputs(made, known))
        n = fresh.count()
        if n:
            stage(fresh, path)
            finish(spark, path)
            digests.run(fresh.select("page", "digest"), _latest)
            digests.vacuum(spark)
        return {"pages": made.count(), "written": n}
