"""Source divergence, whitening and the streaming transducer against plain versions."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import JSON, SCHEMA, P, awkward, table, words

from noticeboard.llm import divergence, transducer, whitening
from noticeboard.llm.common import materialise

# Source divergence.


def plain_divergence(rows, least=3, top=200):
    """rows: (lang, source, text). Dense, by the definition."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    docs = [(g or "", s or "", term.findall((t or "").translate(lower))) for g, s, t in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        ours = [d for d in docs if d[0] == lang]
        seen = Counter(w for d in ours for w in set(d[2]))
        kept = [w for w, n in seen.items() if n >= least]
        counts = defaultdict(Counter)
        for _, s, found in ours:
            counts[s].update(w for w in found if seen[w] >= least)
        whole = sum(counts.values(), Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        gap = lambda a, b: (a - b) ** 2 // b
        q, each = p(whole), {s: p(c) for s, c in counts.items()}
        for s in each:
            pairs = [(-sum(gap(each[s][w], each[o][w]) for w in kept), o.encode(), o) for o in each if o != s]
            out |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)}
            terms = [(-gap(each[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] and each[s][w] > q[w]]
            out |= {(lang, s, "term", w, -v, i) for i, (v, _, w) in enumerate(sorted(terms)[:top], 1)}
    return out


def corpus(n, seed, sources=7):
    r = random.Random(seed)
    odd = ["", None, "ÀÉ àé", "don't-stop x2y", "日本 日本語", "A\x00b\x7fc", "  ", "ß" * 50]
    rows = []
    for i in range(n):
        text = r.choice(odd) if r.random() < 0.2 else " ".join(words(r.randrange(1, 60), seed * 1000 + i, 60)).replace("w", r.choice(["W", "wé", "q"]))
        text = text if text is None else text.translate(str.maketrans("0123456789", "abcdefghij"))
        rows.append((r.choice(["en", "de", "", None]), "hot" if r.random() < 0.4 else r.choice([None, *map(str, range(sources))]), text))
    return rows


@pytest.mark.parametrize("block", [1, 400, 8 << 20])
def test_divergence_equals_the_definition(spark, block, monkeypatch):
    rows = corpus(160, 5) + [("solo", "one", "a b c"), ("none", "x", "q"), ("none", "y", None)]
    docs = spark.createDataFrame([(i, t, g, s) for i, (g, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(3)
    monkeypatch.setattr(divergence, "BLOCK_BYTES", block)
    assert set(map(tuple, divergence.source_divergence(docs).collect())) == plain_divergence(rows)


def test_divergence_ranks_only_the_first_terms(spark):
    rows = corpus(80, 9, 2)
    docs = spark.createDataFrame([(i, t, g, s) for i, (g, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    assert set(map(tuple, divergence.source_divergence(docs, least_docs=2, top_terms=3).collect())) == plain_divergence(rows, 2, 3)


def test_divergence_of_empty_and_awkward_tables(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = awkward(spark)
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert set(map(tuple, divergence.source_divergence(docs).collect())) == plain_divergence(rows)


def test_pairs_of_postings_are_expanded_whole(monkeypatch):
    sizes = np.array([3, 1, 5, 2])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    want = sorted((a, b) for s, n in zip(ends, sizes) for a, b in itertools.permutations(range(s, s + n), 2))
    for limit in (1, 4, 1000):
        monkeypatch.setattr(divergence, "EXPANDED", limit)
        got = [(a, b) for x, y in divergence._expanded(np.arange(4), sizes, ends) for a, b in zip(x.tolist(), y.tolist())]
        assert sorted(got) == want


def test_recounting_holds_no_rows_by_pair(spark):
    """A term that all sources have is one row with its postings, not a row for each pair."""
    lists = spark.createDataFrame([("en", [(f"s{i}", 10 + i, 3) for i in range(60)])] * 50, "lang string, held array<struct<source string, p long, base long>>")
    lists = lists.select(F.col("lang").cast("binary").alias("lang"), F.expr("transform(held, x -> named_struct('source', cast(x.source as binary), 'p', x.p, 'base', x.base))").alias("held"))
    found = divergence.met(lists.coalesce(1)).collect()
    assert len(found) == 60 * 59
    f = lambda p, q: (p - q) ** 2 // q
    assert {(r.source, r.item): r.v for r in found}[b"s1", b"s4"] == 50 * (f(11, 14) - f(11, 3) - f(3, 14) + f(3, 3))


# Whitening.


def plain_whitening(vectors, components):
    x = np.floor(np.array(vectors, float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ v[:, :components] / np.sqrt(e[:components]), e / e.sum()


@pytest.mark.parametrize("parts, fan_in", [(1, 16), (7, 2)])
def test_whitening_equals_an_eigenvalue_solver(spark, parts, fan_in, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", fan_in)
    r = np.random.default_rng(1)
    good = (r.normal(size=(120, 6)) * [3, 2.5, 1, 0.7, 0.5, 0.2] + r.normal(size=6)).tolist()
    good += [good[0]] * 60  # a third of the rows
    bad = [None, [None] + good[0][1:], [float("nan")] + good[0][1:], [float("inf")] + good[0][1:], [1e300] * 6, [], [1.0] * 5]
    rows = [(i, v, "x") for i, v in enumerate(good)] + [(900 + i, v, "x") for i, v in enumerate(bad)] + [(None, good[3], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").repartition(parts)
    with_fit = whitening.whiten(df, components=4).collect()
    n, deviation, white, explained = plain_whitening(good, 4)
    got = {(x.vec_id, x.component): x for x in with_fit}
    assert len(with_fit) == 4 * (len(good) + 1) and {x.n for x in with_fit} == {n} and len({x.identity_error for x in with_fit}) == 1
    for c in range(4):
        column = np.array([got[i, c + 1].whitened for i in range(len(good))])
        assert min(np.abs(column - white[:, c]).max(), np.abs(column + white[:, c]).max()) < 1e-9
        assert got[0, c + 1].explained == pytest.approx(explained[c], rel=1e-9) and got[0, c + 1].identity_error < 1e-9
    assert [got[i, 1].deviation for i in range(len(good))] == deviation.tolist()
    assert got[None, 2].whitened == got[3, 2].whitened


def test_whitening_without_variance_or_rows(spark):
    kind = "vec_id long, embedding array<float>"
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]
    found = whitening.whiten(spark.createDataFrame(line, kind)).collect()
    assert {r.component for r in found} == {1} and len(found) == 9 and found[0].explained == pytest.approx(1)
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])] * 3):
        assert whitening.whiten(spark.createDataFrame(rows, kind)).count() == 0


def test_deviation_is_exact_beyond_products_of_longs():
    x = np.array([[1 << 30, 5], [-(1 << 30), 6], [0, 0]], np.int64)
    sums = [int(v) for v in x.sum(axis=0)]
    assert whitening._deviations(x, 3, sums) == [None, None, 11 * 11]
    assert whitening._deviations(x // 8, 3, [v // 8 for v in sums])[2] is not None
    near = np.array([[400_000_000, 1], [399_999_999, 2]], np.int64)
    sums = [int(v) for v in near.sum(axis=0)]
    assert whitening._deviations(near, 2, sums) == [2, 2]


def test_factors_do_not_depend_on_the_tree(spark):
    r = np.random.default_rng(2)
    rows = [(r.integers(-50, 50, 5).tolist(),) for _ in range(300)]
    fit = spark.createDataFrame(rows, "x array<int>")
    n, sums = whitening.exact_sums(fit, 5)
    one, many = (whitening.tsqr(materialise(fit.repartition(k)), 5, n, sums) for k in (1, 40))
    assert np.allclose(np.linalg.svd(one)[1], np.linalg.svd(many)[1], rtol=1e-12)


# Streaming transducer.

ODD = [
    "", " ", "  two  spaces ", "it's we'll I'D", "naïve café, señor! ok.", "日本語 テスト", "a\x1c b", "12 34.5 <|endoftext|> end", "<|endoftext|>" * 3, "a<|endof", "tail \n",
    "x" * 9000 + "'s", " " * 9000 + "x", "日本語" * 3000, "ab" * 5000 + "  ", "'" * 6000 + "re", "1" * 7000 + " a", "՘a֋", "a" + "\n" * 5000, "é" * 5000 + "!" * 5000 + "\U0003fc3b", "\t " * 4000 + "b",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def bpe():
    return transducer.Bpe(JSON, P.PATTERN)


def encoded(bpe, text, block):
    return np.concatenate(list(transducer.encode(bpe, text, block))).tolist()


@pytest.mark.parametrize("block", [3, 1000, transducer.BLOCK])
def test_transducer_equals_the_library_in_blocks_of_any_size(bpe, library, block):
    r = random.Random(block)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'re", ".", "!", "9", "|", "ß", "—", " ", "日", "՘", "<|endoftext|>", "<|", "\x1c", "\x85", "　", "😀", " the"]
    for text in [t for t in ODD if block > 3 or len(t) < 200] + ["".join(r.choice(alphabet) for _ in range(r.randrange(80))) for _ in range(400)]:
        assert encoded(bpe, text, block) == library.encode(text, add_special_tokens=False).ids


def test_state_stays_bounded(bpe):
    """Whatever comes, the encoder keeps no more than a tail, a window and what a block can leave."""
    for text in ("ab" * 200_000, " " * 300_000, "日本語" * 60_000, "'" * 200_000, "word " * 50_000):
        encoder, most = transducer.Encoder(bpe), 0
        for at in range(0, len(text), 2000):
            encoder.feed(text[at : at + 2000])
            most = max(most, len(encoder.tail) + len(encoder.held) + len(encoder.rest))
        assert most <= transducer.LONG + 2000 + bpe.window


def merge_naively(merges, raw):
    parts = [raw[i : i + 1] for i in range(len(raw))]
    for u, v in merges:
        i = 0
        while i + 1 < len(parts):
            if (parts[i], parts[i + 1]) == (u, v):
                parts[i : i + 2] = [u + v]
            i += 1
    return parts


@pytest.mark.parametrize("seed", range(12))
def test_lookahead_is_sufficient(seed):
    """For each split of random texts: tokens that end so many bytes before the split are in the whole text's, too."""
    r = random.Random(seed)
    made, merges = [bytes([c]) for c in b"abc"[: 2 + seed % 2]], []
    while len(merges) < 14:
        u, v = r.choice(made), r.choice(made)
        if u + v not in made and len(u + v) < 12:
            merges.append((u, v))
            made.append(u + v)
    far, seen = transducer.sufficient_lookahead(merges), 0
    for _ in range(300):
        text = bytes(r.choice(b"abc"[: 2 + seed % 2]) for _ in range(40))
        whole = set(itertools.accumulate(map(len, merge_naively(merges, text))))
        cut = r.randrange(1, 40)
        ends = set(itertools.accumulate(map(len, merge_naively(merges, text[:cut]))))
        lost = [cut - e for e in ends - whole if e < cut] + [cut - e for e in whole - ends if e < cut]
        assert max(lost, default=0) <= far
        seen = max(seen, max(lost, default=0))
    assert seen or far


def test_improper_merge_lists_are_refused():
    for merges in ([(b"ab", b"c")], [(b"a", b"b"), (b"a", b"b")], [(b"a", b"b"), (b"b", b"c"), (b"ab", b"c"), (b"a", b"bc")]):
        with pytest.raises(ValueError):
            transducer.sufficient_lookahead(merges)


def test_decoder_equals_the_library_on_any_ids(bpe, library):
    r = random.Random(1)
    for _ in range(500):
        ids = [r.randrange(50257) for _ in range(r.randrange(12))]
        decoder = transducer.Decoder(bpe)
        assert "".join(decoder.feed(np.array(ids[i : i + 3])) for i in range(0, len(ids), 3)) + decoder.close() == library.decode(ids, skip_special_tokens=False)


def test_stream_round_trip_over_a_table(spark, library):
    import hashlib

    docs = table(spark, [None, *ODD]).unionByName(awkward(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    rows = transducer.stream_round_trip(docs, JSON, P.PATTERN, block=700).collect()
    want = Counter()
    for d in docs.collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), True] += 1
    assert Counter(map(tuple, rows)) == want
    assert transducer.stream_round_trip(spark.createDataFrame([], SCHEMA), JSON, P.PATTERN).count() == 0


def test_small_memory_of_segments_changes_nothing(library):
    small = transducer.Bpe(JSON, P.PATTERN, remembered=3)
    text = " ".join(words(400, 2)) + math.pi.hex()
    assert encoded(small, text, 50) == library.encode(text, add_special_tokens=False).ids
    assert len(small.segments) <= 3


@pytest.mark.parametrize("seed", range(3))
def test_words_merged_together_equal_words_merged_alone(bpe, seed):
    from noticeboard.llm.tokens import WordMerger

    r = random.Random(seed)
    pairs = [(*p, bpe.made[rank]) for p, rank in sorted(bpe.rank.items(), key=lambda x: x[1])]
    made = [bytes(r.choice(b"etaoin shrdlu\xc3\xa9") for _ in range(r.randrange(1, 30))) for _ in range(400)] + [b"aaaaaaaa", b"a", b"the"]
    got = {}
    for places, raw, size in WordMerger(pairs, bpe.byte).merge(made):
        got |= {i: np.frombuffer(raw[k * size : (k + 1) * size], "<u4").tolist() for k, i in enumerate(places)}
    assert [got[i] for i in range(len(made))] == [bpe.merge(w) for w in made]
