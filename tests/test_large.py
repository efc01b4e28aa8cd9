"""Steps that have to grow with their input: what their plans hold, and odd inputs against plain versions."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from noticeboard.operators import links, lookup, similarity


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(extended=True)
    return out.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def test_official_pdf_joins_whole_names(spark):
    names = ["Bob no1x", "bob no1x", "bob", "(bob) no2x", "no-bob", "indian overseas bank", "  ", "--", None, "bob no1xy longer than all of the titles there are"]
    titles = ["Posts of BOB  no1x 2026", "xbob no1x and bob", "bobcat", "at (Bob) no2x", "no-bob here", "xno-bob", "Indian Overseas Banks", "overseas indian bank", "", None]
    asked = spark.createDataFrame(list(enumerate(titles)), "ord int, title string")
    pages = spark.createDataFrame([(n, "Detailed advertisement", "", f"https://x.in/{i}.pdf") for i, n in enumerate(names)], "organisation string, title string, around string, url string")
    out = lookup.official_pdf(asked, pages)
    words = lambda x: re.findall(r"[^\W_]+", x.lower())
    met = {
        i: [k for k, n in enumerate(names) if t and n and words(n) and words(n)[0] in words(t) and n.lower() in " ".join(t.split()).lower()]
        for i, t in enumerate(titles)
    }
    told = {r["ord"]: r["pdf"] for r in out.collect()}
    assert told == {i: f"https://x.in/{max(ks)}.pdf" for i, ks in met.items() if ks}
    assert re.search(r"Join Inner, \(.*_name#", plan(out)), "titles and names meet by the whole name, not by a word that all may share"


def test_card_links_tell_a_score_once(spark):
    rows = spark.createDataFrame([(1, "Law Officer", "advertisement", "", "https://x.in/a.pdf#p", "https://x.in/"), (1, "Law Officer", None, None, "HTTPS://x.in/b", None), (2, "x", "y", "", "mailto:a", "")], "ord int, title string, label string, context string, url string, root string")
    out = links.card_links(rows)
    assert [(r["url"], r["score"], r["rank"]) for r in out.collect()] == [("https://x.in/a.pdf#p", 85, 1)]
    assert plan(out).count("answer key") == 2, "two lists of terms hold it, each searched once a row"


def test_headlines_read_the_start_alone(spark, tmp_path):
    from noticeboard.plans import queries

    texts = ["", None, "a" * 200, " \n\t" * 300 + "b c", "x \n y  " * 40, "π🙂 " * 60, "w" * 47 + "   \n z", "w" * 48 + " z", "short"]
    spark.createDataFrame([(i * 100, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    _, titles = queries._headlines(spark, str(tmp_path))
    whole = lambda t: re.sub("[^a-zA-Z0-9 ]", "", re.sub(r"[ \t\n\x0b\f\r]+", " ", t)[:48])
    assert {r["ord"]: r["title"] for r in titles.collect()} == {i * 100: None if t is None else whole(t) for i, t in enumerate(texts)}


def test_parts_are_not_put_together(spark):
    titles = spark.createDataFrame([(i, f"title {i:04d} {'x' * (i % 40)}") for i in range(400)], "ord long, title string")
    asked = titles.select(F.col("ord").alias("qid"), F.col("title").alias("query")).where("ord % 40 = 0")
    plan = similarity.similar_titles(asked, titles, 0.6)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [bucket#") == 1 and plan.count("RepartitionByExpression [b#") == 1


def tasks_with_rows(df) -> int:
    return df.select(F.spark_partition_id().alias("task")).distinct().count()


def parts(spark, tmp_path, n: int) -> str:
    """A folder with ``part`` in one file of one row group."""
    rows = spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("small ring").alias("p_name"), F.lit("PROMO").alias("p_type"), F.lit("Brand#1").alias("p_brand"), F.col("id").cast("int").alias("p_size"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_cases_of_one_row_group_are_dealt(spark, tmp_path):
    from noticeboard.plans import cases

    rows = cases.TITLES.frame(spark, parts(spark, tmp_path, 400))
    assert tasks_with_rows(rows) > 4 and rows.select("ord").distinct().count() == rows.count() == 400


def test_smart_search_reads_a_title_once(spark, tmp_path):
    from difflib import SequenceMatcher

    from noticeboard.operators import search
    from noticeboard.plans import notices

    assert tasks_with_rows(notices.notices(spark, parts(spark, tmp_path, 400))) > 4
    titles = ["Railway RRB  Technician", "rail", "RRB", "teacher of  rail", None, "", "x", "RRB", "ctet"]
    items = spark.createDataFrame([(i, t, f"https://x.in/{i}", "Rail") for i, t in enumerate(titles)], "ord long, title string, url string, category string")
    hits = search.smart_search(items, "railwey teacherjob")
    assert len(re.findall(r"all_of\(|<lambda>\(|two\(", plan(hits).split("ArrowEvalPython")[1])) == 1 and plan(hits).count("ArrowEvalPython") == 1

    def best(title):
        t = " ".join((title or "").split()).lower()
        return max((100 if t == q else 80 if t.startswith(q) else 60 if q in t else 0) + 30 * (q in "rail") + int(SequenceMatcher(None, q, t).ratio() * 40) for q in search.expand("railwey teacherjob"))

    want = sorted(((-best(t), i) for i, t in enumerate(titles) if best(t) > 0))
    assert [(-r.score, r.ord) for r in hits.select("ord", "score").collect()] == want


def test_items_are_dealt_and_a_block_is_one_file(spark, tmp_path):
    import glob

    from noticeboard.operators import postings
    from noticeboard.plans import queries

    items = queries._items(spark, parts(spark, tmp_path, 400))
    assert tasks_with_rows(items) > 4
    postings.build(items, f"{tmp_path}/index", postings.Layout(buckets=4, block=100))
    assert len(glob.glob(f"{tmp_path}/index/items/block=*/*.parquet")) == 4
    assert postings.find(spark, f"{tmp_path}/index", "ring", layout=postings.Layout(buckets=4, block=100)).count() == 30


def test_rules_of_a_batch_read_rows_without_repeats(spark):
    from noticeboard.plans import pipeline

    fresh = spark.createDataFrame([(1, "Officer Recruitment 2026", "https://x.in/a", "aiims")], "ord long, title string, url string, source string")
    told = plan(pipeline.prepare(fresh, "2026-06-01"))
    assert "AIIMS" in told and "AIIMS" not in told.split("Aggregate", 1)[1], "departments are told behind the dedupe"


def documents(spark, tmp_path, texts) -> str:
    """A folder with ``documents`` in one file of one row group."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_lines_of_documents_are_dealt_and_rules_told_once(spark, tmp_path):
    from noticeboard.plans import queries

    out = queries.QUERIES["q_document_lines"](spark, documents(spark, tmp_path, ["first line\nsecond line"] * 400))
    assert tasks_with_rows(out) > 4 and out.where("n_lines = 2").count() == 400
    assert plan(out).count("&nbsp;") == 1 and plan(out).count("creen reader") == 1, "a line is repaired and looked over once"


def in_full(x):
    """A reader's line by each step on every line, as it was told before lines without their signs were passed over."""
    from noticeboard.functions import text as T
    from noticeboard.functions import wordlists as W

    t = T.text(x)
    for name, sign in T.ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(sign))
    t = T.squeeze(F.regexp_replace(T.repair_mojibake(t), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " "))
    low = F.lower(t)
    gone = low.rlike("(?U)" + T.PAGE_LINE) | low.isin(*W.NAVIGATION_LINES) | T.has_any(low, W.READER_NOISE)
    t = F.trim(T.without(T.squeeze(T._stepped(t, T.LINE_STEPS)), (T.LIST_MARK,)))
    return F.when(gone, "").otherwise(T.trimmed(T.squeeze(T._stepped(t, T.LINE_ENDS)), r" \-–—|;,"))


def test_lines_equal_all_steps_in_full(spark):
    import random

    from noticeboard.functions import reading
    from noticeboard.functions import text as T
    from noticeboard.functions import wordlists as W

    r = random.Random(4)
    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in "\n\r"]
    odd = [*W.MOJIBAKE, *T.ENTITIES, *W.ZERO_WIDTH, *W.READER_NOISE, *W.BULLETS, *W.DECORATION, *spaces, *"|-–—;,/.:()âÂï\x00\x07\x1f", "&amp;lt;", "Index 4", "ındex 7", "CONTENTS12", "go to  index 3", "page 3 of 5"]
    odd += ["पृष्ठ 2", "क/ख", "(क)", "iv)", "12.", "a)", "Login", "é", "İ", "ſ", "K", "🙂", "विज्ञा", "पन"]
    plain = ["word", "ntst", "Of", "the", "7", "भर्ती", "naïve", "Â£5"]
    lines = ["".join(r.choice(odd if r.random() < 0.4 else plain) + r.choice(["", " ", " ", "  "]) for _ in range(r.randrange(9))) for _ in range(4000)] + [o + " word" for o in odd] + ["word " + o for o in odd] + odd
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, x string").repartition(4)
    told = rows.select("x", T.reader_line("x").alias("a"), in_full(F.col("x")).alias("b"), T.single_spaced("x").alias("s"), T.squeeze("x").alias("t")).collect()
    assert [(x.x, x.a, x.s) for x in told] == [(x.x, x.b, x.t) for x in told] and len(told) == len(lines)
    bodies = [r.choice(["\n", "\r\n", "\r"]).join(lines[i : i + 20]) for i in range(0, len(lines), 20)] + ["", None, "\n\n"]
    solid = lambda v: (F.length(v) <= 2) | (F.length(F.regexp_replace(v, r"[^A-Za-zऀ-෿0-9]", "")) >= reading.DENSITY * F.length(v))

    def lines_in_full(x):
        raw = F.split(F.regexp_replace(T.text(x), r"\r\n?", "\n"), "\n")
        return reading.without_repeats(F.filter(reading._glyph_lines()(F.transform(raw, in_full)), lambda v: (v != "") & solid(v)))

    both = spark.createDataFrame(list(enumerate(bodies)), "i int, x string").select(reading.document_lines("x").alias("a"), lines_in_full(F.col("x")).alias("b")).collect()
    assert [x.a for x in both] == [x.b for x in both] and sum(len(x.a) for x in both) > 1000
