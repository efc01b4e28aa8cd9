"""The stored index gives the hits of a scan and reads little."""

import random

import pytest

from noticeboard.operators import postings, search

LAYOUT = postings.Layout(buckets=16, block=50)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    r = random.Random(2)
    words = ["clerk", "officer", "exam", "teacher", "भर्ती", "ssc", "ab", "2026", "rare"]
    text = lambda n: " ".join(r.choice(words[:8]) for _ in range(n))
    rows = [(i, text(3), r.choice(words[:4]), r.choice(["Dept", None]), text(4) if i % 9 else None, f"https://x.in/{i % 150}", [text(1), "Kw"]) for i in range(200)]
    rows += [(777, "Rare  Officer", "exam", "D", "", "https://x.in/777", None), (None, "officer", "", "", "", "u", None)]
    items = spark.createDataFrame(rows, "ord long, title string, category string, department string, description string, url string, keywords array<string>")
    path = str(tmp_path_factory.mktemp("index") / "i")
    postings.build(items, path, LAYOUT)
    return items.where("ord IS NOT NULL"), path


@pytest.mark.parametrize("query", ["officer", "Clerk  Exam", "rare", "ab", "ssc 2026", "nothing here", "nothing officer", "भर्ती", "kw", "x", "", "r o", "exam t"])
def test_same_hits_as_the_scan(spark, stored, query):
    items, path = stored
    want = [(r.ord, r.score) for r in search.search(items, query, 3).collect()]
    assert [(r.ord, r.score) for r in postings.find(spark, path, query, layout=LAYOUT).collect()] == want
    told = [r.title for r in search.suggest(items, query).collect()]
    assert [r.title for r in postings.suggest(spark, path, query, layout=LAYOUT).collect()] == told


def test_a_search_reads_its_buckets_and_blocks_only(spark, stored):
    _, path = stored
    near = postings.candidates(spark, path, "rare", LAYOUT)
    assert [(r.ord, r.block) for r in near.collect()] == [(777, 15)]
    every = len(spark.read.parquet(f"{path}/postings").inputFiles())
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1][:40]
    grams = {g for _, g in postings.wanted_grams("rare")}
    assert len(grams) == 2 and every == LAYOUT.buckets  # two grams lie in at most two of sixteen files


def test_grams_of_a_query():
    assert postings.wanted_grams("Ab  cdef") == [(0, "ab "), (0, "b c"), (0, " cd"), (0, "cde"), (0, "def"), (1, "ab"), (2, "cde"), (2, "def")]
    assert postings.wanted_grams("") == [(0, "")]
