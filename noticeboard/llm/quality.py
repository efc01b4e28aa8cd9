"""Operator 3: quality classifier by ordinal cumulative-link regression on graded ratings."""

from __future__ import annotations

import itertools
import math
import operator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, claim, documents, held_out, labels, map_batches, texts_of, unused

#: Distinct words whose features or weights a worker remembers.
CACHE_WORDS = 250_000
#: Value of a feature of the whole text; those of its distinct words add up to ``Ratings.scale``.
TEXT_VALUE = 3.0
_seen: dict[object, dict] = {}


@dataclass(frozen=True)
class Ratings:
    """How the regression is fitted.

    At most ``sample`` rated rows are used, those with the least hash of their id. ``bits``
    sets the number of hashed weights, ``ridge`` their penalty.
    """

    sample: int = 6000
    bits: int = 13
    steps: int = 160
    rate: float = 0.15
    ridge: float = 3e-5
    scale: float = 20.0


def shape(word: str) -> str:
    """Character classes of a word with runs collapsed; signs stay themselves."""
    kind = ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return "".join(k for k, _ in itertools.groupby(kind))


def bucket(feature: str, bits: int) -> int:
    return xxhash.xxh3_64_intdigest(feature.encode()) & ((1 << bits) - 1)


def word_buckets(word: str, bits: int) -> tuple[int, ...]:
    core = "".join(c for c in word if c.isalnum()).lower()
    return bucket("w:" + core, bits), bucket("s:" + shape(word), bits), bucket("p:" + core[:3], bits), bucket("e:" + core[-3:], bits)


def text_buckets(text: str, words: list[str], bits: int) -> tuple[int, ...]:
    """Buckets of the whole text: its size, and how much of it repeats at once, by word and by line."""
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    echoes = sum(map(operator.eq, words, words[1:]))
    told = (
        f"echoes:{math.ceil(10 * echoes / n) if n else 0}",
        f"size:{int(math.log2(n + 1))}",
        f"variety:{int(10 * len(set(words)) / max(1, n))}",
        f"lines:{int(10 * len(set(lines)) / max(1, len(lines)))}",
    )
    return tuple(bucket(t, bits) for t in told)


def _cache(key) -> dict:
    """The words of one use, the last: those of another model or step go."""
    if key not in _seen:
        _seen.clear()
    claim(__name__, _seen.clear)
    kept = _seen.setdefault(key, {})
    if len(kept) > CACHE_WORDS:
        kept.clear()
    return kept


def vectors(docs: DataFrame, bits: int, scale: float) -> DataFrame:
    """``grade, buckets, values``: a sparse vector of each whole text; its size is bounded by the weights."""

    def make():
        def work(batch):
            out = {"buckets": [], "values": []}
            for text in texts_of(batch):
                kept, words = _cache(("buckets", bits)), text.split()
                distinct = sorted(set(words))
                for w in distinct:
                    if w not in kept:
                        kept[w] = word_buckets(w, bits)
                flat = np.array([kept[w] for w in distinct], np.int64).reshape(-1)
                counts = np.bincount(flat, minlength=1 << bits) * (scale / max(1, len(distinct)))
                for b in text_buckets(text, words, bits):
                    counts[b] += TEXT_VALUE
                at = np.flatnonzero(counts)
                out["buckets"].append(at.astype(np.int32))
                out["values"].append(counts[at].astype(np.float32))
            return out | {"grade": batch.column("grade")}

        return work

    return map_batches(docs.select("text", F.col("grade").cast("int")), make, "grade int, buckets array<int>, values array<float>")


@dataclass
class OrdinalModel:
    """P(grade > k) = logistic(latent - thresholds[k]) with ascending thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray
    conf: Ratings
    name: str = field(default="")

    def __post_init__(self):
        self.name = xxhash.xxh3_64_hexdigest(self.weights.tobytes() + self.thresholds.tobytes())

    def latent(self, text: str) -> float:
        kept, words, w, bits = _cache(self.name), text.split(), self.weights, self.conf.bits
        total, distinct = 0.0, sorted(set(words))
        for word in distinct:
            value = kept.get(word)
            if value is None:
                value = kept[word] = float(sum(w[b] for b in word_buckets(word, bits)))
            total += value
        return total * self.conf.scale / max(1, len(distinct)) + TEXT_VALUE * float(sum(w[b] for b in text_buckets(text, words, bits)))

    def score(self, docs: DataFrame, text: str = "text", at_least: int = 1) -> DataFrame:
        """``docs`` with ``expected_grade`` and ``tail_probability`` = P(grade >= ``at_least``) more.

        Null and empty texts are scored as a text without words. All rows and columns stay; columns that
        have these names already are kept as ``expected_grade_in`` and ``tail_probability_in``.
        """

        def latents(texts: pd.Series) -> pd.Series:
            return pd.Series([self.latent(t or "") for t in texts], dtype="float64")

        docs = apart(docs, "expected_grade", "tail_probability")
        name = unused(docs, "_latent")
        above = [1 / (1 + F.exp(F.lit(float(t)) - F.col(name))) for t in self.thresholds]
        scored = docs.withColumn(name, F.pandas_udf(latents, "double")(F.col(text)))
        return scored.select(*docs.columns, sum(above[1:], above[0]).alias("expected_grade"), above[at_least - 1].alias("tail_probability"))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_rows(grades: np.ndarray, row: np.ndarray, col: np.ndarray, val: np.ndarray, conf: Ratings) -> OrdinalModel:
    """Maximum likelihood with a ridge, by Adam on all rows; ``row, col, val`` are the sparse matrix."""
    n, dims, levels = len(grades), 1 << conf.bits, max(2, int(grades.max(initial=0)) + 1)
    shares = np.clip(np.array([(grades > k).mean() if n else 0.5 for k in range(levels - 1)]), 1e-3, 1 - 1e-3)
    start = -np.log(shares / (1 - shares))
    params = np.concatenate([np.zeros(dims), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, conf.steps + 1 if n else 1):
        w, gaps = params[:dims], np.exp(params[dims + 1 :])
        cuts = params[dims] + np.concatenate([[0.0], np.cumsum(gaps)])
        f = np.bincount(row, weights=val * w.astype(np.float32)[col], minlength=n)
        upper = np.append(cuts, np.inf)[grades]
        lower = np.append(-np.inf, cuts)[grades]
        a, b = np.where(np.isinf(upper), 1.0, logistic(upper - f)), np.where(np.isinf(lower), 0.0, logistic(lower - f))
        p = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a), b * (1 - b)
        slope = (da - db) / p / n  # of the loss by the latent score
        grad_cuts = np.array([db[grades == k + 1].__truediv__(p[grades == k + 1]).sum() - da[grades == k].__truediv__(p[grades == k]).sum() for k in range(levels - 1)]) / n
        grad = np.concatenate(
            [
                np.bincount(col, weights=val * slope.astype(np.float32)[row], minlength=dims) + conf.ridge * w,
                [grad_cuts.sum()],
                [grad_cuts[k:].sum() * gaps[k - 1] for k in range(1, levels - 1)],
            ]
        )
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        params = params - conf.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    cuts = params[dims] + np.concatenate([[0.0], np.cumsum(np.exp(params[dims + 1 :]))])
    return OrdinalModel(params[:dims].copy(), cuts, conf)


def fit(docs: DataFrame, ratings: DataFrame, conf: Ratings = Ratings()) -> OrdinalModel:
    """Fit on ``ratings(doc_id, grade)``, grades 0 and up, of the texts of ``docs``.

    The sample is bounded by ``conf.sample``, so its ids are broadcast and its vectors, each no
    longer than the weights, come to the driver in the order of ids. Null grades and ids are left out; a
    repeated id counts once, by its smallest text and grade. With no rated row every text gets the same score.
    """
    rated = ratings.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(conf.sample)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    found = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("grade").alias("grade")).orderBy("doc_id")
    rows = vectors(found, conf.bits, conf.scale).toArrow()
    grades = rows.column("grade").to_numpy().astype(np.int64)
    lists, values = (rows.column(c).combine_chunks() for c in ("buckets", "values"))
    if isinstance(lists, pa.ChunkedArray):
        lists, values = pa.concat_arrays(lists.chunks), pa.concat_arrays(values.chunks)
    row = np.repeat(np.arange(len(grades), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    col, val = lists.flatten().to_numpy().astype(np.int32), values.flatten().to_numpy()
    del rows, lists, values
    return fit_rows(grades, row, col, val, conf)


def graded(marks: DataFrame) -> DataFrame:
    """Ratings in three grades from ``labels``: 0 poor, 1 good but toxic, 2 good. Null marks give no grade."""
    return marks.select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).cast("int").alias("grade"))


def quality_scores(docs: DataFrame, marks: DataFrame, least: float = 0.5, conf: Ratings = Ratings()) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_probability`` (of grade 1 or better) and ``selected``.

    Ratings of held-out ids (crc32 of the id as text, modulo 5, is 0) are not learned. Rows with a null or
    repeated id are scored as any other; an empty table gives no rows. Columns that have the names of
    the result already are kept with ``_in`` behind them.
    """
    docs = apart(docs, "selected")
    model = fit(docs, graded(marks).where(~held_out(F.col("doc_id"))), conf)
    return model.score(docs).withColumn("selected", F.col("tail_probability") >= least)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(documents(spark, sf_dir).select("doc_id", "text"), labels(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", "selected")
