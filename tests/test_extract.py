"""Labels, span table and facts: each label, each rejected fragment, both sides of each limit; worked out by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from noticeboard.functions import extract, phrases


def told(spark, bodies, fact):
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, x string")
    return [r.y for r in df.select("i", extract.READERS[fact]("x").alias("y")).orderBy("i").collect()]


def test_templates():
    assert phrases.readings("a[ ]{b|c}d") == ["abd", "acd", "a bd", "a cd"]
    assert phrases.readings("plain") == ["plain"] and phrases.readings("x{|y}") == ["x", "xy"]


def test_settled_phrases_are_leftmost_longest():
    found = phrases.Phrases(["post graduate", "post", "graduate degree", "|art|"])
    assert found.settled("post graduate degree art smart") == [(0, 13, 0), (21, 24, 3)]
    assert phrases.Phrases([]).settled("x") == [] and phrases.Phrases(["a"]).settled("") == []
    assert len(phrases.lowered("İSTANBUL é")) == 10


@pytest.mark.parametrize("seed", range(4))
def test_phrases_equal_a_search_of_each(seed):
    r = random.Random(seed)
    keys = list({"".join(r.choice("ab ") for _ in range(r.randrange(1, 5))).strip() or "a" for _ in range(8)})
    text = "".join(r.choice("ab ") for _ in range(200))
    want = sorted((i, i + len(k), n) for n, k in enumerate(keys) for i in range(len(text)) if text.startswith(k, i))
    assert sorted(phrases.Phrases(keys).occurrences(text)) == want
    longest = re.compile("|".join(map(re.escape, sorted(keys, key=len, reverse=True))))
    assert [text[a:b] for a, b, _ in phrases.Phrases(keys).settled(text)] == longest.findall(text)


def test_every_label_is_found_and_no_label_inside_another():
    for fact, f in extract.FACTS.items():
        for group in f.groups:
            for template in group:
                for phrase in phrases.readings(template):
                    before, behind = ("7 ", "") if f.number else ("see ", ": 5 March 2026 and more")
                    spans = extract.spans_of(f"{before}{phrase.strip('|').upper()}{behind}")
                    assert any(s["fact"] == fact for s in spans), phrase
    spans = [s for s in extract.spans_of("number of vacancies 12, vacancies 15") if s["fact"] == "vacancy"]
    assert [s["value"].strip() for s in spans] == ["12, vacancies 15", "15"]


VACANCY = [
    ("Grand total 12 34", "34"), ("Total number of vacancies 5 2025", "5"), ("total posts: 7. Grand total 8 9", "9"), ("Total posts 2024. Grand total", None),
    ("Number of vacancies: 45 in all", "45"), ("No. of vacancies 12", "12"), ("vacancies 01-02-2026 then 6", "6"), ("vacancies 51417 serial", None), ("vacancies 51417 posts", "51417"),
    ("vacancies 100001", None), ("रिक्त पद 40", "40"), ("पदों की संख्या 25", "25"), ("रिक्त पद २५", "25"), ("there are 7 posts here", "7"), ("posts 7", None), ("1950 posts", None), ("12 पद", "12"),
    ("vacancy in 2026", None), ("", None), (None, None), ("vacancies " + "x " * 70 + "9", None), ("total posts " + "x " * 80 + "9", "9"), ("vacancies 1901 2001 2002 2003 2004 2005 2006 2007 5", None),
]


def test_vacancy(spark):
    assert told(spark, [b for b, _ in VACANCY], "vacancy") == [v for _, v in VACANCY]


QUALIFICATION = [
    ("Essential qualification: candidates from Mumbai only, Bachelor degree in Arts. Desirable typing", "Bachelor degree in Arts."),
    ("Educational qualification: Bachelor degree in law experience 3 years", "Bachelor degree in law"),
    ("Minimum educational qualification B.Tech or M Tech Age 30", "B.Tech or M Tech"),
    ("Educational qualifications: स्नातकोत्तर उपाधि", "स्नातकोत्तर उपाधि"), ("Essential qualification बी.टेक डिग्री", "बी.टेक डिग्री"), ("Essential qualification एम.टेक पास", "एम.टेक पास"),
    ("educational qualification none given", ""), ("Qualification: Class ten; other", "Class ten"), ("qualification Class ten", ""), ("शैक्षिक योग्यता - दसवीं पास | x", "दसवीं पास"),
    ("Essential qualification MBA", ""), ("Essential qualification MBA degree", "MBA degree"), ("inessential qualification: LLB degree", "LLB degree"), ("", ""), (None, ""),
    ("Educational qualification: agegraduate Diploma in age", "Diploma in"), ("Essential qualification " + "x " * 600 + "Diploma", ""), ("Essential qualification Degree " + "y" * 400, ("Degree " + "y" * 400)[:360]),
]


def test_qualification(spark):
    assert told(spark, [b for b, _ in QUALIFICATION], "qualification") == [v for _, v in QUALIFICATION]


def test_each_degree_counts_as_a_word_only(spark):
    bodies = [f"Essential qualification {d} course x" for d in extract.DEGREES] + [f"Essential qualification pre{d}post course" for d in extract.DEGREES if "." not in d]
    got = told(spark, bodies, "qualification")
    assert all(got[: len(extract.DEGREES)]) and not any(got[len(extract.DEGREES) :])


def test_salary(spark):
    good = ["Pay scale: Rs 44900 - 142400", "Scale of pay Level 7", "Salary - ₹ 1,000", "वेतनमान: रु 5200-20200", "Emoluments: 18000 - 20000", "pay level: level-4", "Stipend: Rs 99999"]
    want = ["Rs 44900 - 142400", "Level 7", "₹ 1,000", "रु 5200-20200", "18000 - 20000", "level-4", "Rs 99999"]
    assert told(spark, [g + ". More" for g in good], "salary") == want
    assert told(spark, [f"Salary: Rs 50000 {w} x" for w in extract.NO_PAY], "salary") == [""] * len(extract.NO_PAY)
    assert told(spark, ["Salary: Rs 45", "Salary: Rs 999", "Salary: good", "Salary Rs 50000", "Rs 50000", "my nonsalary: Rs 50000", None], "salary") == [""] * 7
    assert told(spark, ["Salary: login first. Salary: Rs 20000", "Basic pay scale none. Salary: Rs 7000"], "salary") == ["Rs 20000", "Rs 7000"]


def test_plain_facts(spark):
    assert told(spark, ["Age limit: 18 to 30 years. x", "Upper age limit 40", "आयु सीमा - 35 वर्ष", "age 30"], "age_limit") == ["18 to 30 years", "40", "35 वर्ष", ""]
    assert told(spark, ["Application fee: Rs 100; x", "Examination fee – nil", "आवेदन शुल्क 200 | y", "fee 5"], "application_fee") == ["Rs 100", "nil", "200", ""]
    assert told(spark, ["Selection process: test. x", "Mode of selection interview", "चयन प्रक्रिया: साक्षात्कार"], "selection_process") == ["test", "interview", "साक्षात्कार"]


def test_dates_behind_labels(spark):
    bodies = [
        "Last date for apply is 10-07-2026.", "Closing date 5 March 2026", "Last date to apply | 05/01/2026", "Closing date. 05-01-2026", "अंतिम तिथि 5 मार्च 2026", "Closing date 1/2/26 Last date to apply 3/4/26",
        "Closing date March 5, 2026 or 06-06-2026", "Application deadline " + "x" * 200 + " 05-01-2026", "closing date soon", None,
    ]
    assert told(spark, bodies, "last_date") == ["10-07-2026", "5 March 2026", "05/01/2026", "", "5 मार्च 2026", "3/4/26", "06-06-2026", "", "", ""]
    assert told(spark, ["Opening date: 01.02.2026", "आवेदन प्रारंभ तिथि 01-02-2026"], "application_start_date") == ["01.02.2026", "01-02-2026"]
    assert told(spark, ["Examination date 7 Jan 2026", "Date of exam: x; 7 Jan 2026", "परीक्षा दिनांक 07-01-2026"], "exam_date") == ["7 Jan 2026", "", "07-01-2026"]


def test_all_facts_take_one_scan(spark):
    df = spark.createDataFrame([("Total posts 5. Age limit: 30. Salary: Rs 9000", "x", "none")], "body string, salary string, _spans string")
    plan = extract.with_details(df, "body")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and plan.count("scan(") <= 2
    kept = extract.with_details(df, "body", trusted=lambda c, n: c != "").first()
    assert (kept.vacancy, kept.salary, kept.age_limit, kept._spans) == ("9000", "x", "30", "none")  # a number before a full stop is not plain
    assert extract.with_details(df, "body").first().salary == "Rs 9000"


def test_a_long_text_is_scanned_in_linear_time():
    import time

    def seconds(n):
        body = "vacancies and salary posts age limit text " * n
        began = time.perf_counter()
        extract.spans_of(body)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(20_000) < 40 * max(seconds(2_000), 0.002)
