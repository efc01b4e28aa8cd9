"""Models, fingerprints and pipeline stages against plain versions; clashing names, very long texts, left-over tables."""

import hashlib
import itertools
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_llm import JSON, RANKS, SCHEMA, P, brute_spans, components, graded, shingles, table, words

from noticeboard.llm import pipeline as corpus_pipeline
from noticeboard import storage
from noticeboard.llm import bpe, fingerprints, lines, media, near_dedup, packing, quality, secrets, substring_dedup, toxicity
from noticeboard.llm.common import dealt, heavy_keys, held_out, spread_join


# Quality classifier.

def plain_latent(model, text):
    """Sum of the weights a text's words and size point at, feature by feature."""
    conf, at, found = model.conf, text.split(), 0.0
    bucket = lambda f: xxhash.xxh3_64_intdigest(f.encode()) % (1 << conf.bits)
    for w in set(at):
        core = re.sub(r"[\W_]", "", w).lower()
        kinds = re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in w))
        for f in (f"w:{core}", f"s:{kinds}", f"p:{core[:3]}", f"e:{core[-3:]}"):
            found += conf.scale / len(set(at)) * model.weights[bucket(f)]
    rows = [x for x in text.split("\n") if x.strip()]
    repeats = sum(a == b for a, b in zip(at, at[1:]))
    told = [f"echoes:{math.ceil(10 * repeats / len(at)) if at else 0}", f"size:{int(math.log2(len(at) + 1))}"]
    told += [f"variety:{int(10 * len(set(at)) / max(1, len(at)))}", f"lines:{int(10 * len(set(rows)) / max(1, len(rows)))}"]
    return found + quality.TEXT_VALUE * sum(model.weights[bucket(f)] for f in told)


def test_quality_scores_equal_a_plain_version(spark):
    docs, marks = graded(spark, 240)
    docs = docs.unionByName(table(spark, [None, "", "one\n\none one", "A1! b--c"], start=900))
    model = quality.fit(docs, quality.graded(marks).where(~held_out(F.col("doc_id"))))
    logistic = lambda x: 1 / (1 + math.exp(-x))
    rows = quality.quality_scores(docs, marks).collect()
    assert len(rows) == 244
    for r in rows:
        above = [logistic(plain_latent(model, r.text or "") - t) for t in model.thresholds]
        assert r.expected_grade == pytest.approx(sum(above)) and r.tail_probability == pytest.approx(above[0])
        assert r.selected == (r.tail_probability >= 0.5)


def test_ordinal_fit_is_at_the_least_of_a_plain_loss():
    r = np.random.default_rng(4)
    n, conf = 200, quality.Ratings(bits=2, steps=1500, rate=0.03, ridge=1e-2)
    x = r.normal(size=(n, 4))
    grades = np.digitize(x @ np.array([1.5, -1, 0.3, 0]) + r.logistic(size=n), [-0.5, 1])
    model = quality.fit_rows(grades, np.repeat(np.arange(n), 4), np.tile(np.arange(4), n), x.reshape(-1), conf)

    def loss(w, cuts):
        total = 0.0
        for i in range(n):
            tail = [1.0, *(1 / (1 + math.exp(c - x[i] @ w)) for c in cuts), 0.0]
            total -= math.log(tail[grades[i]] - tail[grades[i] + 1])
        return total / n + conf.ridge / 2 * (w @ w)

    least = loss(model.weights, model.thresholds)
    for _ in range(40):
        step = r.normal(size=6) * 0.05
        assert loss(model.weights + step[:4], model.thresholds + step[4:]) > least - 1e-4


def test_models_do_not_depend_on_the_order_of_rows(spark):
    docs, marks = graded(spark, 300)
    more = docs.where("doc_id < 60").withColumn("doc_id", F.col("doc_id") + 5000)  # copies with labels of their own
    docs = docs.unionByName(more).unionByName(docs.where("doc_id < 5"))
    marks = marks.unionByName(more.selectExpr("doc_id", "1 AS quality", "CAST(doc_id % 2 AS INT) AS toxic"))
    one = [docs.orderBy(F.rand(s)).repartition(1 + 3 * s) for s in (1, 2)]
    scores = [{(r.doc_id, r.text): r.score for r in toxicity.fit(d, marks).score(d).collect()} for d in one]
    assert scores[0] == scores[1]
    grades = [{(r.doc_id, r.text): r.expected_grade for r in quality.quality_scores(d, marks).collect()} for d in one]
    assert grades[0] == grades[1]


# Toxicity.

def plain_features(lexicon, text):
    """The dense features word by word, by the names that the module lists."""
    at = text.split()
    n = len(at)
    if not n:
        return dict.fromkeys(toxicity.FEATURES, 0.0)
    weigh = lambda w: max([lexicon.get(w, 0.0), *(lexicon.get(w[:k] + "*", 0.0) for k in (4, 5, 6))])
    plain = [toxicity.core(w) for w in at]
    weights = [np.float32(weigh(w)) for w in plain]
    insult, you = [w in toxicity.INSULTS for w in plain], [w in toxicity.SECOND_PERSON for w in plain]
    letters = [sum(c.isalpha() for c in w) for w in at]
    upper = [sum(c.isupper() for c in w) for w in at]
    signs = [sum(c in toxicity.PUNCTUATION for c in w) for w in at]
    inside = [a > 0 and not w.isalpha() for a, w in zip(letters, plain)]
    leet = ["".join(c for c in w.translate(toxicity.LEET) if c.isalpha()) if i else "" for w, i in zip(plain, inside)]
    disguised = [i and (w in toxicity.INSULTS or weigh(w) > 0) for w, i in zip(leet, inside)]
    hits = [i for i in range(n) if weights[i] > 0 or insult[i]]
    gaps = [min(abs(i - j) for j in range(n) if you[j]) for i in hits] if any(you) else []
    return {
        "lexicon_share": sum(w > 0 for w in weights) / n, "lexicon_weight": sum(map(float, weights)) / n, "lexicon_hits": math.log1p(sum(w > 0 for w in weights)),
        "lexicon_distinct": len({at[i] for i in hits}), "lexicon_max": max(map(float, weights)), "insult_share": sum(insult) / n, "insult_hits": math.log1p(sum(insult)),
        "second_share": sum(you) / n, "near_hits": sum(g <= 5 for g in gaps), "nearest": 1 / (1 + min(gaps)) if gaps else 0.0,
        "upper_share": sum(upper) / max(1, sum(letters)), "capital_words": sum(a > 2 and u == a for a, u in zip(letters, upper)) / n,
        "bangs": sum(w.count("!") for w in at) / n, "questions": sum(w.count("?") for w in at) / n, "punctuation": sum(signs) / max(1, sum(map(len, at))),
        "repeated_signs": sum(s > 1 for s in signs) / n, "obfuscated": sum(inside) / n, "leet_hits": sum(disguised) / n,
        "stretched": sum(bool(re.search(r"([^\W\d_])\1\1", w)) for w in plain) / n, "words": math.log1p(n), "mean_length": sum(map(len, at)) / n,
    }


def test_toxicity_scores_equal_a_plain_version(spark):
    docs, marks = graded(spark, 240)
    odd = [None, "", "You id1ot!! sooo BAD??", "no words but 12 34 -- ...", "zorgung, you moron! u.s. rate"]
    docs = docs.unionByName(table(spark, odd, start=900))
    model = toxicity.fit(docs, marks.where(~held_out(F.col("doc_id"))))
    trees, (at, value) = model.trees, model.knots

    def margin(x):
        total = trees.base
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.value):
            node = 0
            while 2 * node + 2 < len(leaf):
                j = feature[node]
                node = 2 * node + 1 + (sum(e <= x[j] for e in trees.edges[j]) > cut[node])
            total += leaf[node]
        return total

    for r in model.score(docs).collect():
        found = plain_features(model.lexicon.weights, r.text or "")
        assert model.lexicon.features(r.text or "").tolist() == pytest.approx([found[k] for k in toxicity.FEATURES], abs=1e-6)
        raw = margin(model.lexicon.features(r.text or ""))
        k = int(np.searchsorted(at, raw))
        fitted = value[0] if k == 0 else value[-1] if k == len(at) else value[k - 1] + (value[k] - value[k - 1]) * (raw - at[k - 1]) / (at[k] - at[k - 1])
        want = min(1.0, max(0.0, 0.99 * fitted + 0.01 / (1 + math.exp(-raw))))
        assert r.score == pytest.approx(want, abs=1e-9) and r.predicted == int(r.score >= 0.5)


# Fingerprints.

def plain_mix(x):
    mask = (1 << 64) - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & mask
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & mask
    return x ^ (x >> 31)


def plain_terms(text):
    """Lower-case runs of anything but ASCII white space, control characters and punctuation."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return {xxhash.xxh3_64_intdigest(w) for w in re.split(rb"[\x00-\x20!-/:-@\[-`{-~]+", lowered.encode()) if w}


def plain_mark(text, lexicon, conf):
    found = plain_terms(text)
    if not found:
        return ""
    found = sorted(found & lexicon or found)
    level = max(0, round(math.log2(len(found))) - 1)
    parts = []
    for bits in range(level, level + fingerprints.LEVELS):
        hashes = []
        for seed in fingerprints.odd_constants(conf.subsets, conf.seed).tolist():
            inside = [t for t in found if plain_mix(t * seed & ((1 << 64) - 1)) >> (64 - bits) == 0] if bits else found
            told = b"".join(t.to_bytes(8, "little") for t in inside)
            hashes.append(f"{xxhash.xxh32_intdigest(told) >> 8:06x}" if inside else "-")
        parts.append((bits, hashes))
    return parts


def plain_likeness(a, b):
    if a == b:
        return 1.0
    pairs = [(p, q) for bits, mine in a or () for other, theirs in b or () if bits == other for p, q in zip(mine, theirs) if (p, q) != ("-", "-")]
    return sum(p == q for p, q in pairs) / len(pairs) if pairs else 0.0


def test_fingerprints_equal_a_plain_version(spark):
    r, conf = random.Random(8), fingerprints.IMatch(low=0.05, high=0.6)
    texts = [" ".join(words(r.randrange(1, 160), s, 90)) for s in range(30)] + ["", None, "Solo", "é ü, Solo!", "x-y_z w1"]
    counts = Counter(t for x in texts for t in plain_terms(x or ""))
    lexicon = {t for t, n in counts.items() if 0.05 * len(texts) <= n <= 0.6 * len(texts)}
    show = lambda m: m if isinstance(m, str) else ";".join(f"{b}:" + ",".join(h) for b, h in m)
    for row in fingerprints.fingerprint_documents(table(spark, texts).repartition(3), conf).collect():
        text, following = texts[row.doc_id] or "", texts[(row.doc_id - 1) % len(texts)] or ""
        k = len(text) // 3
        marks = [plain_mark(x, lexicon, conf) for x in (text, text[: len(text) - k] + following[:k], following)]
        assert [row.fingerprint, row.edited_fingerprint] == [show(m) for m in marks[:2]]
        assert [row.near_edited, row.near_next] == pytest.approx([plain_likeness(marks[0], m) for m in marks[1:]])


# Pipeline.

def test_each_stage_equals_a_plain_version(spark, tmp_path):
    docs, marks = graded(spark, 240)
    base = words(150, 77, 4000)
    near = [" ".join(base), " ".join([*base, "more"]), " ".join(base), " ".join(words(150, 78, 4000))]
    keys = ["token=Zx9KqLm27TrPw and " + " ".join(words(30, 5)), "password=commonexample1 " + " ".join(words(30, 6)), "password=commonexample1 " + " ".join(words(30, 7))]
    docs = docs.unionByName(table(spark, near + keys[:2], start=5000)).unionByName(table(spark, keys[2:], start=5100, lang="de"))
    docs = docs.withColumn("text", F.concat(F.lit("site header\n"), "text")).unionByName(table(spark, [None, ""], start=6000))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    step = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = lambda df: sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()))
    all_rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]

    model = quality.fit(docs, quality.graded(marks).where(~held_out(F.col("doc_id"))))
    kept = rows(step["quality classifier"](spark, docs.where("text IS NOT NULL"), str(tmp_path)))
    assert kept == sorted(x for x in all_rows if x[1] is not None and plain_latent(model, x[1]) >= model.thresholds[0])

    seen = Counter((x[3], line.strip(" ")) for x in all_rows for line in set((x[1] or "").split("\n")))
    pages = Counter(x[3] for x in all_rows)
    gone = lambda x, line: line.strip(" ") != "" and seen[x[3], line.strip(" ")] >= 5 and seen[x[3], line.strip(" ")] > 0.1 * pages[x[3]]
    clean = {x[0]: None if x[1] is None else "\n".join(v for v in x[1].split("\n") if not gone(x, v)) for x in all_rows}
    after = step["line dedup"](spark, docs, "")
    assert {r.doc_id: r.text for r in after.collect()} == clean

    ids = sorted(clean)
    of = components([shingles(clean[i] or "", 5) for i in ids], 80)
    left = step["MinHash near-dedup"](spark, after, "")
    assert sorted(r.doc_id for r in left.collect()) == [ids[i] for i, c in enumerate(of) if c == i]

    told = {x[0]: (clean[x[0]], x[3], x[2]) for x in all_rows}
    places = {}
    for text, source, lang in told.values():
        for _, a, b in brute_spans(text or ""):
            value = re.split(r"[:=]\s*", text[a:b])[-1]
            places.setdefault(value, set()).add((source, lang))
    redacted = {r.doc_id: r.text for r in step["secret scans"](spark, after, "").collect()}
    for i, (text, _, _) in told.items():
        for _, a, b in reversed(brute_spans(text or "")):
            value = re.split(r"[:=]\s*", text[a:b])[-1]
            if len({s for s, _ in places[value]}) <= 2 and len({g for _, g in places[value]}) <= 1:
                text = text[:a] + "[secret]" + text[b:]
        assert redacted[i] == text
    assert "[secret]" in redacted[5004] and "commonexample1" in redacted[5005]

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    sizes = {i: len(tokenizer.encode(clean[i] or "", add_special_tokens=False).ids) + 1 for i in ids}
    got = Counter()
    for p in step["packing"](spark, after, "").collect():
        assert p.doc_tokens == sizes[p.doc_id]
        got[p.doc_id] += p.length
    assert got == sizes


def test_pipeline_of_an_empty_table_and_of_awkward_rows(spark, tmp_path):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (None, "a b c", "en", None, 5), (4, "z " * 30000, "en", None, 60000)]
    for name, rows in (("empty", []), ("odd", odd)):
        at = tmp_path / name
        clash = {c: F.lit(c) for c in ("selected", "expected_grade", "lines_dropped", "kept", "_own", "found", "row", "told")}
        spark.createDataFrame(rows, SCHEMA).withColumns(clash).write.parquet(str(at / "documents.parquet"))
        marks.write.parquet(str(at / "labels.parquet"))
        docs = spark.read.parquet(str(at / "documents.parquet"))
        for stage, step in corpus_pipeline.STAGES:
            result = step(spark, docs, str(at))
            assert result.count() >= len(rows) - 1
            if stage != "packing":
                assert result.columns == docs.columns
                assert {r.selected for r in result.collect()} <= {"selected"} and {r.lines_dropped for r in result.collect()} <= {"lines_dropped"}
        assert (corpus_pipeline.run(spark, str(at)).count() > 0) == bool(rows)


# Names, lengths, tables.

def test_columns_of_a_result_s_name_are_kept(spark):
    docs, marks = graded(spark, 60)
    names = ("score", "predicted", "selected", "expected_grade", "tail_probability", "lines_dropped")
    docs = docs.withColumns({c: F.lit("mine") for c in names})
    for out, made in (
        (toxicity.fit(docs, marks).score(docs), ("score", "predicted")),
        (quality.quality_scores(docs, marks), ("expected_grade", "tail_probability", "selected")),
        (lines.drop_boilerplate(docs), ("lines_dropped",)),
    ):
        first = out.first()
        assert all(first[c + "_in"] == "mine" and first[c] != "mine" for c in made)


@pytest.mark.parametrize("spaces", [True, False])
def test_texts_of_many_megabytes(spark, spaces):
    r = random.Random(4)
    long = (" " if spaces else "").join(r.choice(["alpha", "Beta", "x1", "zorg"]) + str(r.randrange(50_000)) for _ in range(450_000))
    texts = [long, long + " tail", "short one"]
    docs = table(spark, texts).repartition(3)
    marks = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    near = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(docs).collect()}
    assert near == ({0: 0, 1: 0, 2: 2} if spaces else {0: 0, 1: 1, 2: 2})
    cut = {x.doc_id: x for x in substring_dedup.dedup_substrings(docs).collect()}
    assert cut[1].n_removed == (cut[1].n_words - 1 if spaces else 0)
    assert all(x.exact for x in bpe.round_trip(docs, RANKS, P.PATTERN).collect())
    sums = Counter()
    for p in packing.pack_documents(docs, JSON).collect():
        sums[p.doc_id, p.doc_tokens] += p.length
    assert all(n == total for (_, total), n in sums.items()) and len(sums) == 3
    by_id = {x.doc_id: x for x in media.media_columns(docs).collect()}
    assert all(by_id[i].n_bytes == len(t) for i, t in enumerate(texts))
    assert all(x.n_chars == len(texts[x.doc_id]) for x in fingerprints.fingerprint_documents(docs).collect())
    for result in (secrets.scan_secrets(docs), secrets.redact(docs), lines.drop_boilerplate(docs), quality.quality_scores(docs, marks), toxicity.fit(docs, marks).score(docs)):
        assert len(result.collect()) == 3


def test_two_large_clusters_with_one_link_and_their_pairs(spark, monkeypatch):
    """Two stars of copies whose only link is between two edited members: one verified pair joins them."""
    a = words(200, 1, 9000)
    bridge = a[:188] + [f"q{i}" for i in range(12)]
    b = bridge[12:] + [f"y{i}" for i in range(12)]
    texts = [" ".join([*a, f"a{i}"]) for i in range(40)] + [" ".join([*b, f"b{i}"]) for i in range(40)] + [" ".join(bridge), " ".join(words(200, 3, 9000))]
    tried = []
    verify = near_dedup.verify

    def counted(pairs, docs, conf):
        tried.append(pairs.count())
        return verify(pairs, docs, conf)

    monkeypatch.setattr(near_dedup, "verify", counted)
    conf = near_dedup.NearDedup(words=3, percent=85, block=16)
    want = components([shingles(t, 3) for t in texts], 85)
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(table(spark, texts), conf).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(tried) < 40 * 40


def test_heavy_keys_are_dealt_and_joined_whole(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    facts = rows.select("k").distinct().withColumn("name", F.concat(F.lit("n"), "k"))
    heavy = heavy_keys(rows, "k")
    assert heavy.count() == 1 and dealt(rows, "k", heavy).where("k = 7").select("_part").distinct().count() > 90
    joined = spread_join(rows, facts, "k", heavy)
    assert joined.count() == 20_000 and joined.where("name <> concat('n', k)").count() == 0
    assert heavy_keys(rows.limit(0), "k") is None


def test_tables_go_with_their_operators(spark):
    docs, marks = graded(spark, 60)
    base = storage.shared_base(spark).removeprefix("file://")
    storage.clean(spark)
    there = lambda: len(os.listdir(base)) if os.path.isdir(base) else 0
    before = there()
    for run in (near_dedup.near_duplicates, substring_dedup.dedup_substrings, secrets.scan_secrets, media.media_columns, fingerprints.fingerprint_documents):
        result = run(docs)
        assert result.count() == 60 and there() == before + 1  # the result's own table
        storage.release(result)
        storage.clean(spark)
        assert there() == before
