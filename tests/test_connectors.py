"""Sources that fail alone, and pages that are there whole or not at all."""

import os

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from noticeboard.sources import connectors as C


def pages(spark, told):
    return spark.createDataFrame(list(told.items()), "page string, html string")


def there(root):
    return {n: open(f"{root}/{n}").read() for n in os.listdir(root) if n[0] not in "_."}


def test_one_bad_source_fails_alone(spark, tmp_path):
    good, broken, other, folder = (str(tmp_path / n) for n in ("good.parquet", "broken.parquet", "other.parquet", "folder"))
    pq.write_table(pa.table({"page_id": pa.array(range(500), pa.int32()), "html": [None, *[f"<p>{i}</p>" for i in range(1, 500)]], "error": ["x"] * 500}), good, row_group_size=50)
    with open(broken, "wb") as f:
        f.write(b"PAR1 not a table")
    pq.write_table(pa.table({"text": ["a"]}), other)
    os.makedirs(f"{folder}/sub")
    for i in range(3):
        with open(f"{folder}/sub/{i}.html", "w") as f:
            f.write(f"<h1>{i}é</h1>")
    pq.write_table(pa.table({"html": ["from a table"]}), f"{folder}/t.parquet")
    with open(f"{folder}/u.parquet", "wb") as f:
        f.write(b"no table at all")
    os.makedirs(tmp_path / "empty")
    named = [("good", good), ("good", "a second path"), ("broken", broken), ("other", f"file://{other}"), ("folder", folder), ("absent", str(tmp_path / "none")), ("empty", str(tmp_path / "empty")), ("odd", "nosuch://x/y")]
    df = C.source_pages(spark, named, slice_bytes=300)
    assert df.rdd.getNumPartitions() > 10
    got = {r.source: (r.pages, r.errors, r.status) for r in C.scan_outcome(df).collect()}
    assert got == {"good": (500, 0, "ok"), "broken": (0, got["broken"][1], "failed"), "other": (0, got["other"][1], "failed"), "folder": (4, got["folder"][1], "partial"), "absent": (0, 1, "failed"), "odd": (0, 1, "failed")}
    rows = df.where("source = 'good'").collect()
    assert sorted(r.page_id for r in rows) == list(range(500)) and all(r.error is None for r in rows)
    assert {r.html for r in df.where("source = 'folder' AND error IS NULL").collect()} == {"<h1>0é</h1>", "<h1>1é</h1>", "<h1>2é</h1>", "from a table"}
    assert "no column html" in df.where("source = 'other'").first().error
    listed = spark.createDataFrame([("good", good)], "name string, url string")
    assert C.source_pages(spark, listed).count() == 500 and C.source_pages(spark, []).count() == 0


def test_only_changed_pages_are_written(spark, tmp_path):
    root = str(tmp_path / "site")
    first = {f"p{i}.html": f"é {i}" for i in range(40)} | {"empty.html": None}
    assert C.write_changed(pages(spark, first), root) == {"pages": 41, "written": 41}
    assert there(root) == {k: v or "" for k, v in first.items()}
    times = {n: os.stat(f"{root}/{n}").st_mtime_ns for n in there(root)}
    again = first | {"p7.html": "new", "more.html": "m"}
    assert C.write_changed(pages(spark, again), root) == {"pages": 42, "written": 2}
    assert there(root) == {k: v or "" for k, v in again.items()}
    assert [n for n in first if os.stat(f"{root}/{n}").st_mtime_ns != times[n]] == ["p7.html"]
    assert C.write_changed(pages(spark, again), root)["written"] == 0
    assert C.write_changed(pages(spark, {}), root) == {"pages": 0, "written": 0}
    twice = spark.createDataFrame([("p1.html", "b"), ("p1.html", "a")], "page string, html string")
    assert C.write_changed(twice, root) == {"pages": 1, "written": 1} and there(root)["p1.html"] == "a"
    assert os.listdir(f"{root}/_staged") == [] and os.listdir(f"{root}/_pending") == []


def test_a_task_that_dies_leaves_no_page(spark, tmp_path):
    root = str(tmp_path / "site")
    C.write_changed(pages(spark, {"a.html": "old"}), root)

    def dies(batches):
        for b in batches:
            yield b
        raise RuntimeError("the executor is gone")

    with pytest.raises(Exception, match="gone"):
        C.stage(pages(spark, {"a.html": "new", "b.html": "new"}).coalesce(1).mapInPandas(dies, "page string, html string"), root)
    assert C.finish(spark, root) == 0 and there(root) == {"a.html": "old"}
    for name in (None, "", "../x", "_x", ".x"):
        with pytest.raises(Exception):
            C.stage(pages(spark, {"c.html": "x"}).withColumn("page", F.lit(name).cast("string")), root)
    assert C.sweep(root) == 0  # a run of today may still be writing
    C.sweep(root, 0)
    assert there(root) == {"a.html": "old"} and os.listdir(f"{root}/_staged") == []


def test_a_task_that_runs_twice_counts_once(spark, tmp_path):
    """An attempt that no marker names writes beside the other; the commit names one of them."""
    root = str(tmp_path / "site")
    writer = C.PageWriter(root)
    lost = writer.write(iter([{"page": "a.html", "html": "ha"}]))
    kept = writer.write(iter([{"page": "a.html", "html": "whole"}, {"page": "b.html", "html": None}]))
    assert lost.folder != kept.folder and there(root) == {}
    writer.commit([kept, None])
    assert there(root) == {} and C.finish(spark, root) == 1
    assert there(root) == {"a.html": "whole", "b.html": ""} and C.finish(spark, root) == 0


def test_a_driver_that_dies_between_the_phases(spark, tmp_path):
    root = str(tmp_path / "site")
    C.stage(pages(spark, {"a.html": "1", "b.html": "1"}), root)
    C.stage(pages(spark, {"b.html": "2"}), root)
    [first, second] = sorted(os.listdir(f"{root}/_pending"))
    folder = [f"{root}/_staged/{first}/{d}" for d in os.listdir(f"{root}/_staged/{first}")]
    [at] = [d for d in folder if os.path.exists(f"{d}/a.html")]
    os.rename(f"{at}/a.html", f"{root}/a.html")  # the run that died had come so far
    assert C.write_changed(pages(spark, {"c.html": "3"}), root)["written"] == 1
    assert there(root) == {"a.html": "1", "b.html": "2", "c.html": "3"}
