"""The copy-on-write store: what runs rewrite, what dies with a run, what readers of old versions see."""

import os

import pytest
from pyspark.sql import functions as F

from noticeboard.operators import merge
from noticeboard.operators.store import Store


def put(old, new):
    return merge.upsert(old, new, "job_id", ("title",))


def rows(spark, titles):
    data = [(k, t, "", "2026", True, i) for i, (k, t) in enumerate(titles.items())]
    return spark.createDataFrame(data, "job_id string, title string, publish_date string, year string, is_valid_post boolean, ord long")


@pytest.fixture
def store(tmp_path):
    return Store(str(tmp_path / "live"), "job_id", 16)


def titles(df):
    return {r.job_id: r.title for r in df.collect()}


def test_one_changed_row_rewrites_one_bucket(spark, store):
    first = {f"k{i}": f"t{i}" for i in range(200)}
    assert store.run(rows(spark, first), put) == {"version": 1, "touched": 16, "rewritten": 16}
    assert titles(store.read(spark)) == first
    again = first | {"k7": "new"}
    assert store.run(rows(spark, again), put) == {"version": 2, "touched": 16, "rewritten": 1}
    assert sum(v == 2 for v in store.manifest(spark).values()) == 1
    assert titles(store.read(spark)) == again and titles(store.read(spark, 1)) == first
    assert store.run(rows(spark, again), put)["rewritten"] == 0 and store.versions(spark) == [1, 2]
    one = store.run(rows(spark, {"k7": "newer"}), put)
    assert (one["touched"], one["rewritten"]) == (1, 1)
    assert store.vacuum(spark) > 0 and titles(store.read(spark)) == again | {"k7": "newer"} and store.versions(spark) == [3]


def test_a_run_that_dies_changes_nothing(spark, store):
    first = {f"k{i}": f"t{i}" for i in range(50)}
    store.run(rows(spark, first), put)

    def dies(old, new):
        fail = F.udf(lambda x: 1 / 0)
        return put(old, new).withColumn("title", fail("title"))

    with pytest.raises(Exception):
        store.run(rows(spark, {"k1": "x"}), dies)
    os.makedirs(f"{store.path}/manifest/v00000002")  # a manifest without its mark is none
    assert store.versions(spark) == [1] and titles(store.read(spark)) == first
    assert store.run(rows(spark, {"k1": "x"}), put)["version"] == 2
    assert titles(store.read(spark)) == first | {"k1": "x"}


def test_empty_batches_and_keys(spark, store):
    assert store.run(rows(spark, {}), put) == {"version": 0, "touched": 0, "rewritten": 0} and store.read(spark) is None
    store.run(rows(spark, {None: "x", "a": "y"}), put)
    assert titles(store.read(spark)) == {"a": "y"}
