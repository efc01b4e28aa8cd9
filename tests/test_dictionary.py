"""Dictionaries against CASE expressions and plain searches."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from noticeboard.functions.phrases import Phrases
from noticeboard.operators import dictionary


def book(spark, pairs):
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(pairs)], "ord int, key string, value string")


def test_longest_first_and_whole_words(spark):
    words = book(spark, [("post", "P"), ("post office", "PO"), ("of", "O"), (None, "x"), ("", "y"), ("a|b", None)])
    rows = spark.createDataFrame([("Post office of posts a|b",), (None,), ("",)], "t string")
    got = [r.found for r in dictionary.annotate(rows, "t", words).collect()]
    assert [[(x.start, x.key, x.value) for x in r] for r in got] == [[(0, "post office", "PO"), (12, "of", "O"), (21, "a|b", "")], [], []]
    assert [r.localised for r in dictionary.replaced(rows, "t", words).collect()] == ["PO O posts ", None, ""]
    assert dictionary.replaced(rows, "t", words, whole_words=False).first().localised == "PO O Ps "


@pytest.mark.parametrize("seed", range(3))
def test_first_rule_equals_a_case_expression(spark, seed):
    r = random.Random(seed)
    pairs = [("".join(r.choice("abcd ") for _ in range(r.randrange(2, 6))), f"v{i % 7}") for i in range(60)]
    rows = spark.createDataFrame([("".join(r.choice("abcd AB") for _ in range(r.randrange(30))),) for _ in range(200)] + [(None,)], "t string")
    case = F.lit(None).cast("string")
    for key, value in reversed(pairs):
        case = F.when(F.lower("t").contains(key), value).otherwise(case)
    got = dictionary.first_rule(rows.withColumn("want", case), "t", book(spark, pairs)).collect()
    assert len({x.label for x in got}) > 3 and all(x.label == x.want for x in got)


def test_replacing_equals_one_alternation(spark):
    r = random.Random(1)
    pairs = {"".join(r.choice("abc") for _ in range(r.randrange(1, 5))): f"<{i}>" for i in range(30)}
    texts = ["".join(r.choice("abc ") for _ in range(40)) for _ in range(100)]
    rx = re.compile("|".join(sorted(pairs, key=len, reverse=True)))
    got = dictionary.replaced(spark.createDataFrame([(t,) for t in texts], "t string"), "t", book(spark, pairs.items()), whole_words=False).collect()
    assert [g.localised for g in got] == [rx.sub(lambda m: pairs[m[0]], t) for t in texts]


def test_time_follows_the_text_and_not_the_keys():
    def seconds(n_keys, n_words):
        phrases, text = Phrases([f"key{i:05d}" for i in range(n_keys)], True), " ".join(f"key{i % 20_000:05d}x word" for i in range(n_words))
        began = time.perf_counter()
        list(phrases.occurrences(text))
        return time.perf_counter() - began

    seconds(10, 1000)
    assert seconds(10_000, 100_000) < 60 * max(seconds(10, 100_000), 0.02)  # a thousand times the keys, most with hits
    assert seconds(10_000, 200_000) < 40 * max(seconds(10_000, 20_000), 0.005)


def test_too_large_a_dictionary_is_refused(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "MOST_CHARS", 10)
    with pytest.raises(ValueError):
        dictionary.annotate(spark.createDataFrame([("x",)], "t string"), "t", book(spark, [("abcdef", "ghijkl")]))
