"""Publishing through the store, and what is told about a run."""

import platform

from pyspark.sql import functions as F

from noticeboard.operators import lookup, route
from noticeboard.operators.store import Store
from noticeboard.plans import pipeline
from noticeboard.sources import adapters

DAY = "2026-06-01"


def batch(spark, titles):
    data = [(i, t, f"https://example.gov.in/recruitment/{i}", last) for i, (t, last) in enumerate(titles)]
    return spark.createDataFrame(data, "ord long, title string, url string, last_date string")


def test_publishing_again_rewrites_only_what_changed(spark, tmp_path):
    live = Store(str(tmp_path / "live"), "job_id", 16)
    first = [(f"Officer Recruitment 2026 of department number {i}", "31-12-2026") for i in range(20)]
    done = pipeline.publish_into(live, batch(spark, first), DAY)
    assert done["version"] == 1 and 1 < done["rewritten"] <= 16
    first[7] = (first[7][0], "30-11-2026")
    assert pipeline.publish_into(live, batch(spark, first), DAY)["rewritten"] == 1
    later = pipeline.published(live, spark, "2026-12-15")  # no run has judged this day
    assert [r.last_date for r in later["archive"].select("last_date").collect()] == ["30-11-2026"]


def test_an_empty_store(spark, tmp_path):
    live = Store(str(tmp_path / "live"), "job_id")
    assert pipeline.publish_into(live, batch(spark, []), DAY)["version"] == 0
    assert pipeline.published(live, spark, DAY)["archive"].isEmpty()


def test_health_and_failed_sources(spark):
    row = lookup.health_report(spark.range(3), 1_780_000_000.0, 1_780_000_012.345).first()
    assert (row.total_jobs, row.runtime_seconds, row.platform, row.generated_at) == (3, 12.35 if row.runtime_seconds > 12.34 else 12.34, platform.system(), "2026-05-28T20:26:52.345000")
    sources = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("c", "u3"), ("c", "u3"), (None, "u4")], "name string, url string")
    pages = spark.createDataFrame([("a", None), ("a", "one bad file"), ("b", "z"), ("b", "y")], "source string, error string")
    assert sorted((r.url, r.errors, r.error) for r in lookup.failed_sources(sources, pages).collect()) == [("u2", 2, "y"), ("u3", 0, ""), ("u4", 0, "")]


def test_pages_where_scans_begin(spark):
    rows = [("UKPSC", "x", "uk"), ("other", None, "uk"), ("UKSSSC", "https://s", None), (None, "https://n", "")]
    got = adapters.entry_pages(spark.createDataFrame(rows, "name string, url string, adapter string")).collect()
    assert sorted((str(r.name), r.adapter, r.page_url.split("/")[2] if r.page_url else "", r.department) for r in got) == [
        ("None", "generic", "n", ""), ("UKPSC", "uk", "psc.uk.gov.in", "UKPSC"), ("UKSSSC", "generic", "s", ""),
        ("other", "uk", "psc.uk.gov.in", "UKPSC"), ("other", "uk", "sssc.uk.gov.in", "UKSSSC"),
    ]
    links = spark.createDataFrame([(1, "https://elsewhere.in/", "Clerk recruitment of 2026", "https://e/1", "uk", "UKSSSC"), (2, "https://elsewhere.in/", "Forest guard vacancy", "https://e/2", "uk", None)], "ord long, page_url string, title string, url string, adapter string, department string")
    assert {r.ord: r.department for r in adapters.scan_rules(links).collect()} == {1: "UKSSSC", 2: "UKPSC"}


def test_older_homepage(spark):
    rows = [(i, f"notice {i}", ("Uttarakhand Jobs", "Banking Jobs", "Police")[i % 3], f"p{i // 2}.html") for i in range(80)]
    df = spark.createDataFrame(rows, "ord long, title string, category string, html_file string")
    got = route.legacy_homepage(df, [F.asc("ord")])
    count = {r.section: r["count"] for r in got.groupBy("section").count().collect()}
    assert count == {"latest_cards": 10, "latest_posts": 15, "uk_jobs": 10, "central_jobs": 10, "state_jobs": 10}
    assert [r.ord for r in got.where("section = 'latest_posts'").orderBy("rank").collect()] == list(range(0, 30, 2))
    files = spark.createDataFrame([("p0.html",), ("p0.html",), ("p39.html",)], "name string")
    assert {(r.section, r.ord) for r in route.legacy_homepage(df, [F.asc("ord")], files).collect()} == {("latest_cards", 0), ("latest_posts", 0), ("uk_jobs", 0), ("central_jobs", 1)}
