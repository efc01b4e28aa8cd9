"""Operator 8: I-Match document fingerprints over randomised lexicon subsets."""

from __future__ import annotations

import hashlib
import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, _arrow_schema, bytes_of, documents, map_batches, materialise, mix64, odd_constants, scratch, to_batch

#: Bytes of a text that part its terms; A-Z are lowered. Other bytes are part of terms.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else 32 if chr(c) in string.punctuation or c < 32 else c) for c in range(256))
LEVELS = 4


@dataclass(frozen=True)
class IMatch:
    """The lexicon holds terms that between ``low`` and ``high`` of all documents have.

    That band of inverse document frequency bounds it: with t distinct terms a document on
    average it has at most t / ``low`` terms, whatever the corpus. ``subsets`` lexicon subsets
    are drawn, each at several sampling rates.
    """

    low: float = 2e-4
    high: float = 0.1
    subsets: int = 16
    seed: int = 29


def term_hashes(text: str) -> np.ndarray:
    """Distinct terms of a whole text as ascending hashes."""
    words = set(text.encode("utf-8", "surrogatepass").translate(_TABLE).split())
    return np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))


def lexicon(docs: DataFrame, conf: IMatch, flush: int = 4_000_000) -> np.ndarray:
    """Ascending hashes of the terms in the band, from document frequencies over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, n = [], 0, 0

        def counted():
            terms, counts = np.unique(np.concatenate(kept), return_counts=True)
            return to_batch({"term": terms.view(np.int64), "n": counts}, schema)

        for batch in batches:
            for text in batch.column("text").to_pylist():
                kept.append(term_hashes(text or ""))
                size += len(kept[-1])
                if size >= flush:
                    yield counted()
                    kept, size = [], 0
        if kept:
            yield counted()

    schema = _arrow_schema(docs.sparkSession, "term bigint, n bigint")
    total = docs.count()
    df = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    band = df.where((F.col("n") >= conf.low * total) & (F.col("n") <= conf.high * total)).select("term")
    return np.sort(band.toPandas()["term"].to_numpy(np.int64).view(np.uint64))


class Fingerprinter:
    """Fingerprints of texts by one lexicon.

    Subset k at level L holds the lexicon terms whose k-th random value starts with L zero bits;
    at the level of a text, log2 of its terms, a subset holds about one of them. The fingerprint
    has a hash of the sorted terms of each subset at that level and the ones beside it. The subsets are
    drawn once for the corpus, at several rates; a text only chooses which rates it shows, so
    that edits that leave a subset's terms alone leave its hash alone. A text without terms in
    the band is shown by all its terms; one without any term has an empty fingerprint.
    """

    def __init__(self, terms: np.ndarray, conf: IMatch):
        self.terms, self.conf = terms, conf
        self.seeds = odd_constants(conf.subsets, conf.seed)[:, None]

    def __call__(self, text: str) -> str:
        found = term_hashes(text)
        if not len(found):
            return ""
        if len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, found), len(self.terms) - 1)
            inside = found[self.terms[at] == found]
            found = inside if len(inside) else found
        level = max(0, round(math.log2(len(found))) - 1)
        draw = mix64(found[None, :] * self.seeds)
        subset, which = np.nonzero(draw >> U64(64 - level) == 0) if level else np.nonzero(draw >= 0)
        draws, chosen = draw[subset, which], found[which]
        parts = []
        for up in range(LEVELS):
            bits = level + up
            keep = draws >> U64(64 - bits) == 0 if bits else np.ones(len(draws), bool)
            rows, terms = subset[keep], chosen[keep]
            ends = np.searchsorted(rows, np.arange(1, self.conf.subsets + 1))
            start, hashes = 0, []
            for end in ends.tolist():
                hashes.append(f"{xxhash.xxh32_intdigest(terms[start:end].tobytes()) >> 8:06x}" if end > start else "-")
                start = end
            parts.append(f"{bits}:" + ",".join(hashes))
        return ";".join(parts)


def likeness(a: str, b: str) -> float:
    """Share of equal hashes among the subsets that either text fills at the levels both have.

    1 for equal fingerprints, 0 for those without a common level or when one text has no terms.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    mine = dict(x.split(":") for x in a.split(";"))
    theirs = dict(x.split(":") for x in b.split(";"))
    same = filled = 0
    for level in mine.keys() & theirs.keys():
        for p, q in zip(mine[level].split(","), theirs[level].split(",")):
            if p != "-" or q != "-":
                filled += 1
                same += p == q
    return same / filled if filled else 0.0


def edit(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the next text's first, or all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprint_documents(docs: DataFrame, conf: IMatch = IMatch()) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likeness.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The
    next document is the one with the next smaller id; the first follows the last. Texts are
    dealt once, compressed, by ranges of id and text hash and each range is read in order; only the
    text at a range's end meets the next range's first text by a join. Null texts are empty. Rows of
    one id follow each other by a hash of their text, null ids come last. A single row is its own
    next document. An empty table gives no rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    with scratch() as keep:
        return keep(_fingerprint_documents(docs, conf))


def press(docs: DataFrame) -> DataFrame:
    """``doc_id, hash, text``: the text compressed, with a hash of it that parts rows of one id."""

    def make():
        pressed = zstandard.ZstdCompressor(level=3).compress
        return lambda batch: {"doc_id": batch.column("doc_id"), "hash": batch.column("hash"), "text": [pressed(t) for t in bytes_of(batch)]}

    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("hash"), "text"), make, "doc_id bigint, hash bigint, text binary")


def _fingerprint_documents(docs: DataFrame, conf: IMatch) -> DataFrame:
    spark = docs.sparkSession
    terms = spark.sparkContext.broadcast(lexicon(docs, conf))
    result = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in result.split(", ")]
    mixed = f"kind string, range bigint, text string, {result}"
    target, ends = _arrow_schema(spark, mixed), _arrow_schema(spark, result)

    def told(make: Fingerprinter, doc_id, text: str, following: str, mark: str, next_mark: str) -> tuple:
        edited = edit(text, following)
        edited_mark = make(edited)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        return doc_id, len(text), sha, mark, edited_mark, likeness(mark, edited_mark), likeness(mark, next_mark)

    def columns(rows: list[tuple]) -> dict:
        return {n: [r[i] for r in rows] for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, here, before = Fingerprinter(terms.value, conf), TaskContext.get().partitionId(), None
        whole = zstandard.ZstdDecompressor().decompress

        def edge(kind: str, doc_id, text: str) -> pa.RecordBatch:
            blank = {n: [None] for n in names} | {"doc_id": [doc_id]}
            return to_batch(blank | {"kind": [kind], "range": [here], "text": [text]}, target)

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = whole(text).decode()
                mark = make(text)
                if before is None:
                    yield edge("first", doc_id, text)
                else:
                    rows.append(told(make, before[0], before[1], text, before[2], mark))
                before = doc_id, text, mark
            if rows:
                n = len(rows)
                yield to_batch(columns(rows) | {"kind": ["row"] * n, "range": [here] * n, "text": [None] * n}, target)
        if before is not None:
            yield edge("last", before[0], before[1])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter(terms.value, conf)
        for batch in batches:
            got = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")))
            yield to_batch(columns([told(make, i, t, f, make(t), make(f)) for i, t, f in got]), ends)

    order = F.desc("doc_id"), F.desc("hash")
    ranges = press(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(ranges.select("doc_id", "text").mapInArrow(run, mixed))
    firsts = rows.where("kind = 'first'").select("range", F.col("text").alias("following"))
    order = Window.orderBy("range")  # a row for each range, without texts
    met = firsts.select("range").withColumn("next", F.lead("range").over(order)).withColumn("start", F.min("range").over(Window.partitionBy()))
    met = met.select("range", F.coalesce("next", "start").alias("next"))
    last = rows.where("kind = 'last'").select("range", "doc_id", "text").join(met, "range")
    last = last.join(firsts.withColumnRenamed("range", "next"), "next").select("doc_id", "text", "following")
    return rows.where("kind = 'row'").select(names).unionByName(last.mapInArrow(finish, result))


def op8_i_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))
