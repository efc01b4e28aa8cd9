"""The similarity join against difflib over all pairs."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeboard.operators import search, similarity


def typed(title, r):
    t = list(title)
    for _ in range(r.randrange(4)):
        i = r.randrange(len(t) + 1)
        t[i : i + r.randrange(2)] = r.choice(["x", "e", "", " "])
    return "".join(t)


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["clerk", "officer", "exam", "result", "teacher", "notice", "2026", "भर्ती", "board", "ssc"]
    titles = [" ".join(r.choice(words) for _ in range(r.randrange(1, 7))) for _ in range(n)]
    return titles, [typed(r.choice(titles), r) for _ in range(25)] + ["a", "zzz", titles[0].upper()]


@pytest.mark.parametrize("least", [0.4, 0.6, 0.7, 0.85, 1.0])
def test_pairs_equal_difflib_and_filters_lose_none(least):
    titles, queries = corpus(int(least * 100), 90)
    found, told = similarity.block_pairs(queries, titles, least)
    want = {(i, j) for i, q in enumerate(queries) for j, t in enumerate(titles) if difflib.SequenceMatcher(None, q, t).ratio() >= least}
    assert {(q, t) for q, t, _ in found} == want and told["found"] == len(want)
    assert told["found"] <= told["in_order"] <= told["neighbours"] <= told["characters"] <= told["pairs"]
    if least >= 0.7:
        assert told["neighbours"] < told["pairs"] / 3


@pytest.mark.parametrize("seed", range(4))
def test_subsequences_equal_the_table(seed):
    r = random.Random(seed)
    texts = ["".join(r.choice("abc") for _ in range(r.randrange(0, 200))) for _ in range(12)]

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row
            row = [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        return row[-1]

    found = similarity.Subsequences(texts)
    for q in [*texts[:4], "abcz" * 30, ""]:
        assert found.with_text(q, np.arange(len(texts))).tolist() == [plain(q, t) for t in texts]


@pytest.mark.parametrize("seed", range(3))
def test_alternating_matches_pass_the_neighbour_bound(seed):
    """Ratios just over two thirds made of blocks as short as they can be."""
    r = random.Random(seed)
    pairs = [("".join(r.choice("abcdef") + ("x" if r.random() < 0.5 else "") for _ in range(12)), "".join(r.choice("abcdef") + ("y" if r.random() < 0.5 else "") for _ in range(12))) for _ in range(60)]
    queries, titles = [a for a, _ in pairs], [b for _, b in pairs] + ["".join(c + "y" for c in a[::2]) for a, _ in pairs]
    for least in (0.67, 0.75):
        want = sum(difflib.SequenceMatcher(None, q, t).ratio() >= least for q in queries for t in titles)
        assert similarity.block_pairs(queries, titles, least)[1]["found"] == want


def test_join_equals_difflib(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PART", 7)
    titles, queries = corpus(5)
    q = spark.createDataFrame([(i, x) for i, x in enumerate(queries)] + [(99, queries[0]), (100, None), (101, " ")], "qid long, query string")
    t = spark.createDataFrame([(i, x, "z") for i, x in enumerate(titles)] + [(900, titles[3].upper(), "z"), (901, None, "z")], "ord long, title string, ratio string")
    squeeze = lambda x: " ".join(x.lower().split())
    distinct = {}
    for i, x in enumerate(titles):
        distinct.setdefault(squeeze(x), i)
    want = {}
    for i, x in [*enumerate(queries), (99, queries[0])]:
        for title, o in distinct.items():
            if (v := difflib.SequenceMatcher(None, squeeze(x), title).ratio()) >= 0.6:
                want[i, title] = (o, v)
    got = similarity.similar_titles(q, t, 0.6).collect()
    assert {(r.qid, r.title): (r.ord, r.ratio) for r in got} == want and len(got) == len(want)
    best = {r.qid: r.ord for r in similarity.best_titles(q, t).collect()}
    assert best == {i: min((-v, o) for (j, _), (o, v) in want.items() if j == i)[1] for i in {i for i, _ in want}}
    one = search.did_you_mean(t.drop("ratio").where("ord < 900"), queries[1]).first()
    assert (one.ord if one else None) == best.get(1)
    related = {(r.qid, r.ord) for r in similarity.related_titles(q, t, limit=3).collect()}
    for i in (0, 4):
        near = sorted(o for title, o in distinct.items() if difflib.SequenceMatcher(None, squeeze(queries[i]), title).ratio() >= 0.4)[:3]
        assert {o for j, o in related if j == i} == set(near)
    assert similarity.similar_titles(q.limit(0), t, 0.6).count() == 0 == similarity.similar_titles(q, t.limit(0), 0.6).count()


def test_no_pair_leaves_a_task_but_results(spark):
    titles = spark.range(3000).select(F.col("id").alias("ord"), F.concat(F.lit("notice of the board "), F.col("id").cast("string")).alias("title"))
    asked = titles.where("ord % 300 = 0").select(F.col("ord").alias("qid"), F.col("title").alias("query"))
    plan = similarity.similar_titles(asked, titles, 0.99)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert similarity.similar_titles(asked, titles, 0.99).count() == 10


@pytest.mark.parametrize("limit", [1, 3])
def test_rounds_give_the_first_related_and_end_with_enough(spark, monkeypatch, limit):
    monkeypatch.setattr(similarity, "PART", 7)
    monkeypatch.setattr(similarity, "FIRST", 12)
    monkeypatch.setattr(similarity, "ASKED", 6)
    met, pairs = [], similarity._pairs
    monkeypatch.setattr(similarity, "_pairs", lambda texts, *rest: (met.append(texts.count()), pairs(texts, *rest))[1])
    titles, queries = corpus(8, 150)
    queries += ["unlike all others 0123456789", queries[0]]
    t = spark.createDataFrame([(7 * i, x) for i, x in enumerate(titles)] + [(5000, titles[3].upper()), (5001, None), (-5, "zzz")], "ord long, title string").repartition(3)
    q = spark.createDataFrame([*enumerate(queries), (100, None), (101, " ")], "qid long, query string")
    squeeze = lambda x: " ".join(x.lower().split())
    distinct = {"zzz": -5}
    for i, x in enumerate(titles):
        distinct.setdefault(squeeze(x), 7 * i)
    want = {}
    for i, x in enumerate(queries):
        near = sorted((o, title, v) for title, o in distinct.items() if (v := difflib.SequenceMatcher(None, squeeze(x), title).ratio()) >= 0.6)[:limit]
        want |= {(i, rank): pair for rank, pair in enumerate(near, 1)}
    got = similarity.related_titles(q, t, 0.6, limit).collect()
    assert {(r.qid, r["rank"]): (r.ord, r.title, r.ratio) for r in got} == want and len(got) == len(want)
    assert len(met) > 2 and met == sorted(met, reverse=True) and met[0] > met[-1] > 0, "a query with enough titles goes to no later round"


def test_a_block_ends_a_query_with_enough():
    titles, queries = corpus(3, 90)
    every, _ = similarity.block_pairs(queries, titles, 0.6)
    some, told = similarity.block_pairs(queries, titles, 0.6, 2)
    assert sorted(some) == sorted(x for q in range(len(queries)) for x in sorted((p for p in every if p[0] == q), key=lambda p: p[1])[:2])
    assert told["found"] == len(some) < len(every)


@pytest.mark.parametrize("size", [1, 2, 3])
def test_counts_of_grams(size):
    texts = ["", "a", "ab", "abab", "भर्ती 🙂🙂🙂", "bbb"]
    index = similarity.Index(texts, size)
    asked = ["abab", "b🙂🙂", "", "zzz", "ती 🙂"]
    grams = lambda t: {g: sum(t[i : i + size] == g for i in range(len(t))) for g in {t[i : i + size] for i in range(len(t) - size + 1)}}
    assert index.common(asked).tolist() == [[sum(min(n, grams(t).get(g, 0)) for g, n in grams(q).items()) for t in texts] for q in asked]
    assert similarity.Index([], size).common(["a"]).shape == (1, 0)
