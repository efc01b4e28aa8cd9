"""Lines and texts as readers and searchers see them, against a plain version and by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from noticeboard.functions import reading, records, text


def told(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_lines(spark):
    lines = ["1. Apply now", "Page 3 of 5", "पृष्ठ 2", "login", "Privacy Policy", "index 12 of things", "क/ख भाग", "&lt;b&gt; A &amp; B", "~~ x | y •• z ;", "Go to index 4", "(क) नियम", "\x07bell", None]
    assert told(spark, lines, text.reader_line) == ["Apply now", "", "", "", "", "of things", "क / ख भाग", "b> A & B", "x y z", "", "नियम", "bell", ""]


def test_document_lines_drop_furniture_and_repeats(spark):
    body = "Header\r\nHeader\n---- ==== 7\nPage 1 of 2\n(a) First point\n\nok\nHeader\nविभाग में\n.. 1 .. 2 .. ..\n5"
    assert told(spark, [body, None, ""], lambda x: F.array_join(reading.document_lines(x), "~")) == ["Header~7~First point~ok~Header~विभाग में~5", "", ""]
    assert told(spark, ["word " * 4000, None], reading.document_text) == [("word " * 4000)[:9000].strip(), ""]


@pytest.mark.parametrize("seed", range(2))
def test_repeats_equal_a_plain_pass(spark, seed):
    r = random.Random(seed)
    bodies = ["\n".join(r.choice(["alpha", "beta", "§§§§ §", "x1"]) for _ in range(30)) for _ in range(40)]

    def plain(body):
        out = []
        for line in body.split("\n"):
            dense = len(re.findall(r"[A-Za-z0-9]", line)) / len(line) >= 0.35
            if dense and (not out or out[-1] != line):
                out.append(line)
        return "\n".join(out)

    assert told(spark, bodies, reading.document_text) == [plain(b) for b in bodies]


def test_search_text(spark):
    assert told(spark, ["ＳＳＣ  Exam – 2026", "A—B", "ﬁne", None], reading.search_text) == ["ssc exam - 2026", "a-b", "fine", ""]


FIELDS = {
    "vacancy": (["12 posts", "7"], ["many", "01/02/2026", "as on 1 2026", "5 registration opens"]),
    "qualification": (["Degree", "x" * 900], ["MBA", "x" * 901, "apply online now please", "see www.a.in"]),
    "salary": (["Rs. 35,400", "Level 7", "35400 - 112400", "₹ 100"], ["Rs. 25", "abc", "₹", "good pay"]),
    "age_limit": (["18 years"], ["years"]),
    "application_fee": (["Rs 100", "No fee", "निःशुल्क"], ["ask", "1" * 301, "5 facebook", "5 https://x"]),
    "last_date": (["05-01-2026", "5 March 2026"], ["March 2026", "5 March 1999"]),
    "selection_process": (["Written test"], ["http://x", "visit the website for it"]),
    "any": (["value"], ["", "n/a", "as on 5", "at the time of joining", "the", "—", "* Rs. 25", "not mentioned"]),
}


@pytest.mark.parametrize("name", FIELDS)
def test_needs_of_each_field(spark, name):
    good, bad = FIELDS[name]
    assert told(spark, good, lambda x: records.is_detail(x, name)) == [True] * len(good)
    assert told(spark, bad, lambda x: records.is_detail(x, name)) == [False] * len(bad)
