"""Operator 6: toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re
import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, claim, documents, held_out, labels, map_batches, texts_of

# Fixed word lists: plain insults, and second-person pronouns of the languages scored.
INSULTS = frozenset("dumb fool foolish garbage idiot idiotic imbecile jerk loser lunatic moron pathetic scum stupid trash useless worthless clown disgusting".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine tu te toi ton ta tes vous votre tú ti tus usted vosotros".split())
LEET = str.maketrans("013457@$!|", "oleastasil")
PUNCTUATION = frozenset(string.punctuation)
STRETCHED = re.compile(r"([^\W\d_])\1\1")
NEAR = 5
FEATURES = (
    "lexicon_share lexicon_weight lexicon_hits lexicon_distinct lexicon_max insult_share insult_hits second_share near_hits nearest "
    "upper_share capital_words bangs questions punctuation repeated_signs obfuscated leet_hits stretched words mean_length"
).split()
CACHE_WORDS = 300_000
#: Values of a described word, and the lengths of the beginnings that the lexicon may hold.
COLUMNS, STEMS = 15, (4, 5, 6)
_seen: dict = {}


@dataclass(frozen=True)
class Boosting:
    """At most ``sample`` labelled rows are used, those with the least hash of their id."""

    sample: int = 12000
    trees: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 64
    least_rows: int = 8
    ridge: float = 1.0
    lexicon: int = 256
    least_share: float = 0.01


def core(word: str) -> str:
    return word.lower().strip(string.punctuation + "¡¿«»“”’…")


def terms(word: str) -> list[str]:
    """What the lexicon may hold of a word: itself, and its beginnings, for stems with many endings."""
    w = core(word)
    return [w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) >= k)] if w else []


class _Words:
    """A worker's table of described words: rows are reused by every text that has the word."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.table = np.zeros((1 << 14, COLUMNS), np.float32)

    def add(self, words: list[str], describe) -> None:
        if not words:
            return
        first = len(self.place)
        while first + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[first : first + len(words)] = [describe(w) for w in words]
        self.place.update(zip(words, range(first, first + len(words))))


class Lexicon:
    """Learned terms with log-odds weights, and what each word of a text adds to its features."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.whole = {t: w for t, w in weights.items() if not t.endswith("*")}
        self.stems = [(k, {t[:-1]: w for t, w in weights.items() if t.endswith("*") and len(t) == k + 1}) for k in STEMS]
        self.stems = [(k, stems) for k, stems in self.stems if stems]
        self.name = xxhash.xxh3_64_hexdigest(repr(sorted(weights.items())).encode())

    def weight(self, w: str) -> float:
        """Of a lower-case word: the largest of its own and its beginnings' weights, 0 without any."""
        found = self.whole.get(w, 0.0)
        for k, stems in self.stems:
            found = max(found, stems.get(w[:k], 0.0))
        return found

    def describe(self, word: str) -> tuple:
        """Row of a word: lexicon, insult, second person, capitals, signs, obfuscation, stretching, length."""
        plain = word if word.isalpha() else word.rstrip(".,;:!?")
        if not plain.isalpha():
            return self._describe_odd(word)
        w, n, tail = plain.lower(), len(plain), word[len(plain) :]
        upper = 0 if plain.islower() else sum(map(str.isupper, plain))
        weight = self.weight(w)
        return (
            weight, weight > 0, w in INSULTS, w in SECOND_PERSON, upper, n, n > 2 and upper == n,
            tail.count("!"), tail.count("?"), len(tail), len(tail) > 1, False, False, bool(STRETCHED.search(w)), len(word),
        )

    def _describe_odd(self, word: str) -> tuple:
        w = core(word)
        weight = self.weight(w)
        letters = sum(map(str.isalpha, word))
        upper = sum(map(str.isupper, word))
        signs = sum(map(PUNCTUATION.__contains__, word))
        inside = letters > 0 and not w.isalpha()
        plain = "".join(filter(str.isalpha, w.translate(LEET))) if inside else ""
        disguised = inside and (plain in INSULTS or self.weight(plain) > 0)
        return (
            weight, weight > 0, w in INSULTS, w in SECOND_PERSON, upper, letters, letters > 2 and upper == letters,
            word.count("!"), word.count("?"), signs, signs > 1, inside, disguised, bool(STRETCHED.search(w)), len(word),
        )

    def features(self, text: str) -> np.ndarray:
        known = _seen.get(self.name)
        if known is None or len(known.place) > CACHE_WORDS:
            _seen.clear()  # those of another lexicon go as well
            claim(__name__, _seen.clear)
            known = _seen[self.name] = _Words()
        words = text.split()
        known.add([w for w in set(words) if w not in known.place], self.describe)
        n = len(words)
        if not n:
            return np.zeros(len(FEATURES))
        at = np.fromiter(map(known.place.__getitem__, words), np.int64, n)
        rows = known.table[at]
        total = rows.sum(axis=0, dtype=np.float64)
        hit, you = rows[:, 1] + rows[:, 2] > 0, rows[:, 3] > 0
        near, nearest = 0, 0.0
        if hit.any() and you.any():
            where_hit, where_you = np.flatnonzero(hit), np.flatnonzero(you)
            right = np.searchsorted(where_you, where_hit)
            gap = np.minimum(
                np.abs(where_hit - where_you[np.minimum(right, len(where_you) - 1)]), np.abs(where_hit - where_you[np.maximum(right - 1, 0)])
            )
            near, nearest = int((gap <= NEAR).sum()), 1.0 / (1.0 + gap.min())
        return np.array(
            [
                total[1] / n, total[0] / n, np.log1p(total[1]), len(np.unique(at[hit])), rows[:, 0].max(), total[2] / n, np.log1p(total[2]),
                total[3] / n, near, nearest, total[4] / max(1, total[5]), total[6] / n, total[7] / n, total[8] / n, total[9] / max(1, total[14]),
                total[10] / n, total[11] / n, total[12] / n, total[13] / n, np.log1p(n), total[14] / n,
            ]
        )


def learn_lexicon(rows: DataFrame, conf: Boosting) -> Lexicon:
    """Terms that mark toxic texts, from ``rows(text, toxic)``.

    Terms of at least ``least_share`` of the toxic texts are counted in all rows of the sample;
    those much commoner in toxic texts are kept, at most ``lexicon`` of them by likelihood ratio.
    """

    def count_terms(only: frozenset | None):
        def make():
            def work(batch):
                counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
                for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist()):
                    found = {t for w in set(text.split()) for t in terms(w)}
                    counts[toxic].update(found if only is None else found & only)
                out = [(t, toxic, n) for toxic, c in counts.items() for t, n in c.items()]
                return dict(zip(("term", "toxic", "n"), map(list, zip(*out)))) if out else None

            return work

        return make

    schema = "term string, toxic int, n bigint"
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon({})
    least = max(3, conf.least_share * n_toxic)
    toxic = map_batches(rows.where("toxic = 1"), count_terms(None), schema).groupBy("term").agg(F.sum("n").alias("n"))
    often = {r["term"]: r["n"] for r in toxic.where(F.col("n") >= least).collect()}
    clean = map_batches(rows.where("toxic = 0"), count_terms(frozenset(often)), schema).groupBy("term").agg(F.sum("n").alias("n"))
    seldom = {r["term"]: r["n"] for r in clean.collect()}
    scored = []
    for term, a in often.items():
        b = seldom.get(term, 0)
        p, q = (a + 0.5) / (n_toxic + 1), (b + 0.5) / (n_clean + 1)
        if a >= 8 * (b + 0.5) * n_toxic / n_clean:
            scored.append((a * np.log(p / q), term, float(np.log(p / q))))
    return Lexicon({term: weight for _, term, weight in sorted(scored, reverse=True)[: conf.lexicon]})


@dataclass
class Trees:
    """Depth-limited regression trees on binned features; arrays are by tree and node, nodes in heap order."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)
        out, depth = np.full(len(x), self.base), int(np.log2(self.value.shape[1] + 1)) - 1
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            out += value[node]
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, conf: Boosting) -> Trees:
    """Newton boosting of the logistic loss; each split is the best over feature histograms."""
    n, d = x.shape
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, conf.bins + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    bins = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)
    nodes = 2 ** (conf.depth + 1) - 1
    margin = np.full(n, base)
    features, cuts, values = [], [], []
    for _ in range(conf.trees if n else 0):
        p = sigmoid(margin)
        g, h = y - p, p * (1 - p)
        feature, cut, value = np.zeros(nodes, np.int64), np.full(nodes, conf.bins + 1), np.zeros(nodes)
        node = np.zeros(n, np.int64)
        for level in range(conf.depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-6)
            for j in range(d):
                key = local * conf.bins + bins[:, j]
                shape = (width, conf.bins)
                gs, hs, cs = (np.bincount(key, weights=z, minlength=width * conf.bins).reshape(shape).cumsum(axis=1) for z in (g, h, np.ones(n)))
                g_all, h_all, c_all = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gs**2 / (hs + conf.ridge) + (g_all - gs) ** 2 / (h_all - hs + conf.ridge) - g_all**2 / (h_all + conf.ridge)
                gain[(cs < conf.least_rows) | (c_all - cs < conf.least_rows)] = -np.inf
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = j
                cut[first : first + width][better] = at[better]
            node = 2 * node + 1 + (bins[np.arange(n), feature[node]] > cut[node])
        leaf = node
        gs, hs = np.bincount(leaf, weights=g, minlength=nodes), np.bincount(leaf, weights=h, minlength=nodes)
        value = conf.rate * gs / (hs + conf.ridge)
        margin += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    pack = lambda a: np.array(a).reshape(len(a), nodes)
    return Trees(edges, pack(features), pack(cuts), pack(values), base)


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the ascending fit of labels to scores (pool adjacent violators), one for each pool."""
    blocks: list[list[float]] = []
    for s, value in sorted(zip(scores.tolist(), y.tolist())):
        blocks.append([value, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            merged = blocks[-1]
            merged[2] = (merged[2] * merged[1] + last[2] * last[1]) / (merged[1] + last[1])
            merged[0], merged[1] = merged[0] + last[0], merged[1] + last[1]
    return np.array([b[2] for b in blocks]), np.array([(b[0] + 0.01) / (b[1] + 0.02) for b in blocks])


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a hundredth of the raw score keeps the order inside a calibration step."""
        raw = self.trees.margin(x)
        at, value = self.knots
        fitted = np.interp(raw, at, value) if len(at) else sigmoid(raw)
        return np.clip(0.99 * fitted + 0.01 * sigmoid(raw), 0.0, 1.0)

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``score`` and ``predicted`` more; null texts are empty texts. All rows stay.

        Columns that have these names already are kept as ``score_in`` and ``predicted_in``.
        """

        def scores(texts: pd.Series) -> pd.Series:
            if not len(texts):
                return pd.Series([], dtype="float64")
            return pd.Series(self.probabilities(np.stack([self.lexicon.features(t or "") for t in texts])))

        scored = apart(docs, "score", "predicted").withColumn("score", F.pandas_udf(scores, "double")(F.col(text)))
        return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fit(docs: DataFrame, marks: DataFrame, conf: Boosting = Boosting()) -> ToxicityModel:
    """Fit on ``marks(doc_id, toxic)``, 0 or 1, of the texts of ``docs``.

    The sample's ids are broadcast (``conf.sample`` bounds them) and only its dense features
    come to the driver. A quarter of the sample calibrates what the rest has fitted. Null labels
    and ids are left out. A repeated id counts once, by its smallest text, and copies of one text count
    once, by their smallest id; either is toxic if one of its labels is. So the model does not depend
    on the order of rows. With no labelled row, or one class only, every text gets much the same score.
    """
    told = marks.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(conf.sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("first"))
    rows = rows.select("text", "toxic", (F.pmod(F.xxhash64("first", F.lit(4)), F.lit(4)) == 0).alias("calibrates"))
    rows = rows.cache()
    try:
        lexicon = learn_lexicon(rows.where("NOT calibrates").select("text", "toxic"), conf)

        def make():
            def work(batch):
                x = [lexicon.features(t) for t in texts_of(batch)]
                return {"toxic": batch.column("toxic"), "calibrates": batch.column("calibrates"), "x": x}

            return work

        got = map_batches(rows, make, "toxic int, calibrates boolean, x array<double>").toPandas()
    finally:
        rows.unpersist()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    y, late = got["toxic"].to_numpy(float), got["calibrates"].to_numpy(bool)
    order = np.lexsort((*x.T, y))
    x, y, late = x[order], y[order], late[order]
    trees = boost(x[~late], y[~late], conf)
    return ToxicityModel(lexicon, trees, isotonic(trees.margin(x[late]), y[late]) if late.any() else (np.zeros(0), np.zeros(0)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, marks = documents(spark, sf_dir), labels(spark, sf_dir)
    model = fit(docs, marks.where(~held_out(F.col("doc_id"))))
    scored = model.score(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
