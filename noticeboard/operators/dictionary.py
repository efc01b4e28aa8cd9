"""Large dictionaries over texts: containment, first rule, replacement, by one automaton a worker."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.phrases import Phrases, lowered

#: Characters of all keys and values up to which a dictionary travels to the workers.
MOST_CHARS = 32 << 20


def collected(dictionary: DataFrame, key: str, value: str) -> tuple[list[str], list[str]]:
    """Distinct keys in lower case with the least of their values, the longest first; its size is checked before it is fetched.

    Null and empty keys never match; a null value is an empty one. ValueError beyond ``MOST_CHARS``: such a dictionary is a table to join by token.
    """
    rows = dictionary.select(F.lower(F.col(key).cast("string")).alias("k"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("v")).where("k <> ''")
    rows = rows.groupBy("k").agg(F.min("v").alias("v"))
    chars = rows.agg(F.sum(F.length("k") + F.length("v"))).first()[0] or 0
    if chars > MOST_CHARS:
        raise ValueError(f"a dictionary of {chars} characters; the most is {MOST_CHARS}")
    found = sorted(((r["k"], r["v"]) for r in rows.collect()), key=lambda r: (-len(r[0]), r[0]))
    return [k for k, _ in found], [v for _, v in found]


def annotate(rows: DataFrame, text: str, dictionary: DataFrame, key: str = "key", value: str = "value", whole_words: bool = True, into: str = "found") -> DataFrame:
    """``rows`` with ``found array<struct<start, key, value>>``: the leftmost of a text's keys, the longest of one place, none overlapping.

    Time is linear in a text's length whatever the number of keys. Case is ignored. A null text has no keys; a
    column that is there already is replaced.
    """
    keys, values = collected(dictionary, key, value)

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        phrases = Phrases(keys, whole_words)
        for batch in batches:
            yield batch.map(lambda t: [{"start": a, "key": keys[i], "value": values[i]} for a, _, i in phrases.settled(lowered(t or ""))])

    return rows.withColumn(into, F.pandas_udf(find, "array<struct<start:int,key:string,value:string>>")(F.col(text).cast("string")))


def replaced(rows: DataFrame, text: str, dictionary: DataFrame, key: str = "key", value: str = "value", whole_words: bool = True, into: str = "localised") -> DataFrame:
    """``rows`` with ``localised``: each key of the dictionary replaced by its value, the longest first; what is put in is not read again. Null texts stay null."""
    keys, values = collected(dictionary, key, value)

    def put(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        phrases = Phrases(keys, whole_words)

        def one(t: str | None) -> str | None:
            if t is None:
                return None
            out, at = [], 0
            for start, end, i in phrases.settled(lowered(t)):
                out += [t[at:start], values[i]]
                at = end
            return "".join(out) + t[at:]

        for batch in batches:
            yield batch.map(one).astype(object)

    return rows.withColumn(into, F.pandas_udf(put, "string")(F.col(text).cast("string")))


def first_rule(rows: DataFrame, text: str, dictionary: DataFrame, order: str = "ord", key: str = "key", value: str = "value", into: str = "label") -> DataFrame:
    """``rows`` with ``label``: the value of the first key by ``order`` that a text contains anywhere, as a CASE over all keys gives it; null without one."""
    ranked = dictionary.groupBy(F.lower(F.col(key).cast("string")).alias("_k")).agg(F.min(F.struct(order, value)).alias("_r"))
    top = ranked.select(F.col("_k").alias("key"), F.to_json(F.struct(F.col(f"_r.{order}").alias("o"), F.coalesce(F.col(f"_r.{value}"), F.lit("")).alias("v"))).alias("value"))
    keys, told = collected(top, "key", "value")
    rank = [(json.loads(v)["o"], json.loads(v)["v"]) for v in told]

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        phrases = Phrases(keys, False)
        for batch in batches:
            yield batch.map(lambda t: min((rank[i] for _, _, i in phrases.occurrences(lowered(t or ""))), default=(0, None))[1]).astype(object)

    return rows.withColumn(into, F.pandas_udf(find, "string")(F.col(text).cast("string")))
