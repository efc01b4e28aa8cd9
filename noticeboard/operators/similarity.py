"""Similarity join of many queries and many titles by Ratcliff/Obershelp, exact, over a character-count index.

A pair's ratio is twice the matched characters over all characters. Matched characters are common characters, so a pair can reach a
ratio only if its lengths and the common characters of both, counted with repeats, allow it; they keep their order, so no more match than the longest
common subsequence has. For ratios over two thirds common pairs of neighbours are needed too: blocks are parted by characters that do not match, so M
matched characters of T lie in at most T - 2M + 1 blocks. All bounds are exact: no pair is lost.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean
from ..storage import materialise, scratch
from . import dedupe

#: Growth of lengths from one bucket to the next, distinct titles in a part of a bucket, cells of a count table at once.
STEP, PART, CELLS = 1.3, 4096, 1 << 22
#: Distinct titles of the first round of a search that ends with enough of them, queries of a round that meet a part in one task.
FIRST, ASKED = 16 * PART, 4096
RESULT = "qid bigint, query string, title string, ord bigint, ratio double"


def _bucket(n: Column) -> Column:
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / math.log(STEP)).cast("int")


def _signs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts, and of each its text and its place there."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return codes, np.repeat(np.arange(len(texts)), sizes), np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Index:
    """Counts of grams of up to three characters of texts: a row of counts for each text, over the grams that occur. Grams are hashed into no buckets: counts are exact."""

    def __init__(self, texts: list[str], size: int):
        self.size, self.grams = size, np.empty(0, np.int64)
        self.counts = self._table(texts, True)

    def _table(self, texts: list[str], learn: bool) -> np.ndarray:
        codes, rows, _ = _signs(texts)
        n = max(0, len(codes) - self.size + 1)
        inside = rows[:n] == rows[len(rows) - n :]
        grams, rows = sum(codes[i : n + i] << 21 * i for i in range(self.size))[inside], rows[:n][inside]
        if learn:
            self.grams = np.unique(grams)
        columns = np.searchsorted(self.grams, grams)
        if not learn:
            known = np.append(self.grams, -1)[columns] == grams
            rows, columns = rows[known], columns[known]
        out = np.zeros((len(texts), max(1, len(self.grams))), np.int16)
        np.add.at(out.reshape(-1), rows * out.shape[1] + columns, 1)
        return out

    def common(self, texts: list[str]) -> np.ndarray:
        """Common grams, counted with repeats, of each of these texts and each text of the index: by levels, one product each."""
        mine, out = self._table(texts, False), np.zeros((len(texts), len(self.counts)), np.int32)
        for level in range(1, int(mine.max(initial=0)) + 1):
            a, b = mine >= level, self.counts >= level
            used = a.any(axis=0) & b.any(axis=0)
            out += (a[:, used].astype(np.float32) @ b[:, used].T.astype(np.float32)).astype(np.int32)
        return out


class Subsequences:
    """Lengths of longest common subsequences with many texts at once: a bit a character, 64 to a word, a lane a text."""

    def __init__(self, texts: list[str]):
        words = max(1, -(-max(map(len, texts), default=1) // 64))
        self.lengths = np.array([len(t) for t in texts], np.int64)
        codes, rows, places = _signs(texts)
        signs = np.unique(codes)
        masks = np.zeros((len(signs), words, len(texts)), np.uint64)
        at = (np.searchsorted(signs, codes) * words + (places >> 6)) * len(texts) + rows
        np.add.at(masks.reshape(-1), at, np.uint64(1) << (places & 63).astype(np.uint64))  # each bit once
        self.masks: dict[str, np.ndarray] = {chr(x): masks[i] for i, x in enumerate(signs.tolist())}
        self.words = words

    def with_text(self, text: str, lanes: np.ndarray) -> np.ndarray:
        """The length for each of these lanes: a zero bit is a matched character."""
        state = np.full((self.words, len(lanes)), ~np.uint64(0))
        known = {ch: self.masks[ch][:, lanes] for ch in set(text) if ch in self.masks}
        if self.words == 1:  # no carry leaves the word: four steps a character, in place
            v, both, left = state[0], np.empty(len(lanes), np.uint64), np.empty(len(lanes), np.uint64)
            for ch in text:
                if (mask := known.get(ch)) is not None:
                    np.bitwise_and(v, mask[0], out=both)
                    np.bitwise_xor(v, both, out=left)
                    np.add(v, both, out=v)
                    np.bitwise_or(v, left, out=v)
            return 64 - np.bitwise_count(v).astype(np.int64)
        for ch in text:
            if (mask := known.get(ch)) is None:
                continue
            carry = np.zeros(len(lanes), np.uint64)
            for w in range(self.words):
                v = state[w]
                added = v + (v & mask[w])
                over = added < v
                added += carry
                carry = (over | (added < carry)).astype(np.uint64)
                state[w] = added | (v & ~mask[w])
        return 64 * self.words - np.bitwise_count(state).sum(axis=0, dtype=np.int64)


def block_pairs(queries: list[str], titles: list[str], least: float, limit: int | None = None) -> tuple[list[tuple[int, int, float]], dict[str, int]]:
    """(query, title, ratio) of the pairs of ``least`` or more, of each query the first ``limit`` titles if given, and how many pairs each filter left."""
    have = [0] * len(queries)
    found, told = [], {"pairs": len(queries) * len(titles), "characters": 0, "neighbours": 0, "in_order": 0, "found": 0}
    chars, grams = Index(titles, 1), Index(titles, 2) if least > 2 / 3 else None
    in_order, lengths = Subsequences(titles), np.array([len(t) for t in titles])
    step = max(1, CELLS // max(1, len(titles)))
    matcher = SequenceMatcher(None)
    for at in range(0, len(queries), step):
        some = queries[at : at + step]
        total = np.array([len(q) for q in some])[:, None] + lengths[None, :]
        need = np.ceil(least * total / 2 - 1e-9)
        keep = (chars.common(some) >= need) | (total == 0)
        told["characters"] += int(keep.sum())
        if grams is not None:
            keep &= grams.common(some) >= 3 * need - total - 1
        told["neighbours"] += int(keep.sum())
        for i, q in enumerate(some):
            lanes = keep[i].nonzero()[0]
            keep[i, lanes] = in_order.with_text(q, lanes) >= need[i, lanes]
        told["in_order"] += int(keep.sum())
        by_title = np.argwhere(keep.T)
        last = -1
        for t, q in by_title.tolist():
            if have[at + q] == limit:
                continue
            if t != last:
                matcher.set_seq2(titles[t])
                last = t
            matcher.set_seq1(some[q])
            if (ratio := matcher.ratio()) >= least:
                found.append((at + q, t, ratio))
                have[at + q] += 1
    told["found"] = len(found)
    return found, told


def _named(titles: DataFrame) -> DataFrame:
    """Distinct cleaned titles, each with its first ``ord``."""
    return titles.select(clean("title").alias("title"), "ord").where("title <> ''").groupBy("title").agg(F.min("ord").alias("ord"))


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("qid", clean("query").alias("query")).where("query <> ''")


def _pairs(texts: DataFrame, named: DataFrame, least: float, limit: int | None = None, slices: int = 1) -> DataFrame:
    """``query, title, ord, ratio`` of distinct cleaned texts; with ``limit``, of each query at least the first ones by ``ord, title``. Texts are dealt to ``slices`` tasks a part."""
    if not 0 < least <= 1:
        raise ValueError("a ratio over 0, at most 1")
    spark = named.sparkSession
    named = named.withColumn("bucket", _bucket(F.length("title")))
    sizes = named.groupBy("bucket").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    mine, each = F.pmod(F.xxhash64("query"), F.lit(slices)).cast("int"), F.sequence(F.lit(0), F.lit(slices - 1))
    named = named.join(F.broadcast(sizes), "bucket").withColumn("part", F.pmod(F.xxhash64("title"), F.col("parts")).cast("int"))
    named = named.withColumn("slice", F.explode(each)).withColumn("part", F.col("part") * slices + F.col("slice"))
    n, wide = F.length("query"), (2 - least) / least
    texts = texts.withColumn("bucket", F.explode(F.sequence(_bucket(F.ceil(n / wide - 1e-9)), _bucket(F.floor(n * wide + 1e-9)))))
    texts = texts.join(F.broadcast(sizes), "bucket").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    texts = texts.withColumn("part", F.col("part") * slices + mine)

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        if limit is not None:
            right = right.sort_by([("ord", "ascending"), ("title", "ascending")])
        asked, names, ords = left.column("query").to_pylist(), right.column("title").to_pylist(), right.column("ord").to_pylist()
        found, _ = block_pairs(asked, names, least, limit)
        rows = [(asked[q], names[t], ords[t], r) for q, t, r in found]
        kinds = (("query", pa.string()), ("title", pa.string()), ("ord", pa.int64()), ("ratio", pa.float64()))
        return pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate(kinds)})

    left, right = texts.select("bucket", "part", "query"), named.select(F.col("bucket").alias("b"), F.col("part").alias("p"), "title", F.col("ord").cast("bigint").alias("ord"))
    # as many tasks as asked for: the work is in the pairs and not in the bytes, by which small partitions would be put together
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    left, right = left.repartition(tasks, "bucket", "part"), right.repartition(tasks, "b", "p")
    return left.groupBy("bucket", "part").cogroup(right.groupBy("b", "p")).applyInArrow(match, "query string, title string, ord bigint, ratio double")


def similar_titles(queries: DataFrame, titles: DataFrame, least: float) -> DataFrame:
    """``qid, query, title, ord, ratio``: of each query all distinct titles with a ratio of ``least`` or more; exact.

    ``queries(qid, query)``, ``titles(ord, title)``; texts are compared cleaned, a title has its first ``ord``, blank titles and
    queries have no pairs, each row of a repeated query has its own. Titles are dealt by length and then into parts of about ``PART``; a query goes to
    the parts whose lengths its ratio allows, so no task holds more than a part and no pair leaves a task that is not a result.
    """
    asked = _asked(queries)
    return asked.join(_pairs(asked.select("query").distinct(), _named(titles), least), "query").select("qid", "query", "title", "ord", "ratio")


def best_titles(queries: DataFrame, titles: DataFrame, least: float = 0.6) -> DataFrame:
    """Did you mean, for many queries: the most similar title of each, the first of equals; a query without one has no row."""
    pairs = similar_titles(queries, titles, least)
    best = F.max_by(F.struct("query", "title", "ord", "ratio"), F.struct("ratio", -F.col("ord")))
    return pairs.groupBy("qid").agg(best.alias("b")).select("qid", "b.*")


def _rounds(named: DataFrame) -> list[Column]:
    """Conditions on ``ord`` that deal titles to rounds in index order: about ``FIRST`` titles, then each time as many as all before. Missing ones come first."""
    n = named.count()
    shares = [FIRST * 2**i / n for i in range(64) if FIRST * 2**i < 0.75 * n]
    ends = sorted(set(named.select(F.col("ord").cast("bigint").alias("ord")).approxQuantile("ord", shares, 0.002))) if shares else []
    place = F.coalesce(sum((F.col("ord") >= F.lit(int(x))).cast("int") for x in ends) if ends else F.lit(0), F.lit(0))
    return [place == i for i in range(len(ends) + 1)]


def related_titles(queries: DataFrame, titles: DataFrame, least: float = 0.4, limit: int = 10) -> DataFrame:
    """Related titles, for many queries: the first ``limit`` similar enough, in index order.

    Titles are searched in rounds in that order, and a query that has ``limit`` titles goes to no later round, whose titles all come behind them: exact,
    and the more titles are alike, the fewer pairs are told. A query with fewer titles meets all.
    """
    order = [F.col("ord"), F.col("title")]
    with scratch() as keep:
        named, asked = materialise(_named(titles)), materialise(_asked(queries))
        texts, found = materialise(asked.select("query").distinct()), None
        for within in _rounds(named):
            if not (left := texts.count()):
                break
            pairs = _pairs(texts, named.where(within), least, limit, -(-left // ASKED))
            first = materialise(dedupe.top_per_group(pairs, "query", order, limit).drop("rank"))
            found = first if found is None else found.unionByName(first)
            full = found.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= limit)
            texts = materialise(texts.join(full, "query", "left_anti"))
        if found is None:
            found = _pairs(texts, named, least)
        rows = asked.join(found, "query").select("qid", "query", "title", "ord", "ratio")
        return keep(dedupe.top_per_group(rows, "qid", order, limit))
