"""Operator 2: byte-level BPE encoding and decoding with the tiktoken library."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, documents, map_batches, texts_of
from .tokens import forget, rank_encoding


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """ids of every whole text: ``id, ids array<int>, n_tokens``.

    Null text is the empty text and has no ids. Repeated rows and null ids stay. Texts of any
    length are cut at safe boundaries, never shortened.
    """

    def make():
        claim(__name__, forget)
        _, encoder = rank_encoding(rank_file, pattern)

        def work(batch):
            ids = [np.frombuffer(b, "<u4").astype(np.int32) for b in encoder.encode_all(texts_of(batch, "_text"))]
            return {"_id": batch.column("_id"), "ids": ids, "n_tokens": [len(x) for x in ids]}

        return work

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    return map_batches(rows, make, f"_id {kind}, ids array<int>, n_tokens bigint").withColumnRenamed("_id", id)


def decode_ids(encoded: DataFrame, rank_file: str, pattern: str, ids: str = "ids", id: str = "doc_id") -> DataFrame:
    """Raw bytes of id lists: ``id, bytes binary``; the bytes need not be valid UTF-8. Null ids give no bytes."""

    def make():
        claim(__name__, forget)
        encoding, _ = rank_encoding(rank_file, pattern)

        def work(batch):
            return {"_id": batch.column("_id"), "bytes": [encoding.decode_bytes(x or []) for x in batch.column("_ids").to_pylist()]}

        return work

    kind = encoded.schema[id].dataType.simpleString()
    rows = encoded.select(F.col(id).alias("_id"), F.col(ids).alias("_ids"))
    return map_batches(rows, make, f"_id {kind}, bytes binary").withColumnRenamed("_id", id)


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Digest of encoding and decoding again, in one pass: no ids leave the task.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, exact``; ``exact`` says whether
    the decoded bytes are the text's. Null and empty texts have no ids. Empty tables give no rows.
    """

    def make():
        claim(__name__, forget)
        encoding, encoder = rank_encoding(rank_file, pattern)

        def work(batch):
            out = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "exact")}
            texts = texts_of(batch)
            for text, raw in zip(texts, encoder.encode_all(texts)):
                ids = np.frombuffer(raw, "<u4").tolist()
                data = encoding.decode_bytes(ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(data).hexdigest())
                out["n_bytes"].append(len(data))
                out["exact"].append(data == text.encode())
            return out | {"doc_id": batch.column("doc_id")}

        return work

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint, exact boolean"
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), make, schema)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return round_trip(documents(spark, sf_dir), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
