"""Corpus pipeline: documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of
``documents``. Every stage takes null, empty and very long texts, null and repeated ids, other columns
of any name and an empty table, which gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import given, labels, materialise, release, scratch, unused
from .lines import drop_boilerplate
from .near_dedup import NearDedup, near_duplicates, repeated_ids
from .packing import pack_documents
from .quality import quality_scores
from .secrets import redact


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose probability of grade 1 or better is under a half.

    Each row is judged by its own text, so rows of one id or without one may part; a null text is empty.
    """
    scored = quality_scores(docs, labels(spark, sf_dir)).where("selected")
    return scored.select(given(docs, "selected", "expected_grade", "tail_probability"))


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that over a tenth of their source's documents have; all documents stay.

    A null source is a site of its own; a null text stays null, a text may become empty; each repeated row counts.
    """
    return drop_boilerplate(docs).select(given(docs, "lines_dropped"))


def with_own_ids(docs: DataFrame, repeated: DataFrame, own: str) -> DataFrame:
    """``docs`` with an id ``own`` of each distinct row, where ids repeat.

    Identical rows of one id become one. The smallest text of a repeated id keeps the id; its
    other rows get ids behind all others, so that each text is compared.
    """
    key = F.col("doc_id").cast("bigint")
    ids = repeated.select(F.col("doc_id").alias(own))
    single = docs.join(ids, key == F.col(own), "left_anti").withColumn(own, key)
    rows = materialise(docs.join(ids, key == F.col(own), "left_semi").distinct())
    row = F.struct(*rows.columns)
    first = rows.groupBy(key.alias(own)).agg(F.min(F.struct(F.col("text").isNull(), "text", row.alias("row"))).alias("least"))
    first = materialise(first.select("least.row.*", own))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in rows.columns]
    rest = rows.alias("a").join(first.alias("b"), [F.col("a.doc_id") == F.col("b.doc_id"), *same], "left_anti")
    most = docs.agg(F.max(key)).first()[0]
    rest = materialise(rest.withColumn(own, F.lit(most) + 1 + F.monotonically_increasing_id()))
    return materialise(single.unionByName(first).unionByName(rest))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of near-duplicates: five words, 0.8 or more.

    Where ids repeat, one of identical rows stays, and different texts of one id are documents of their
    own. Rows without an id, and null, empty and blank texts, all stay.
    """
    own, columns = unused(docs, "_own"), docs.columns
    repeated = repeated_ids(docs)
    docs = docs.withColumn(own, F.col("doc_id").cast("bigint")) if repeated.isEmpty() else with_own_ids(docs, repeated, own)
    groups = near_duplicates(docs.select(F.col(own).alias("doc_id"), "text"), NearDedup())
    gone = groups.where("NOT kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, own, "left_anti").select(columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace live-looking credentials by a mark; all documents stay.

    Null texts stay null; rows of one id or without one are told apart by their texts.
    """
    return redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack what is left into sequences of 2048 tokens.

    A null or empty text is its end token alone; each repeated row is packed. Workers serve the
    other stages too, so they remember fewer pieces than when packing alone.
    """
    import public_tokenizers as P

    return pack_documents(docs, P.path("byte_bpe_50k.json"), remembered=600_000, chunk_chars=2_000_000)


STAGES = [
    ("quality classifier", select_quality),
    ("line dedup", drop_site_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("packing", pack),
]
#: The classifier is fitted, so SQL cannot state the rows; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's tables go once the next has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch() as keep:
            done = keep(stage(spark, docs, sf_dir))
        release(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
