"""Operator 1: cost-balanced packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _arrow_schema, claim, documents, texts_of, to_batch
from .tokens import CACHE_PIECES, CHUNK_CHARS, forget, json_encoder

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, sequence_cost double"
)


def attention_cost(length, linear: float, quadratic: float):
    """Estimated cost of a piece: projections and MLP grow with its tokens, attention with their square."""
    return linear * length + quadratic * length * length


def balance(lengths: np.ndarray, n_sequences: int, capacity: int, linear: float, quadratic: float):
    """Assign pieces to sequences; yields (piece, first token, tokens, sequence).

    Pieces go in descending cost order, each to the cheapest sequence that has room for it. A
    piece with no such sequence is cut: the cheapest sequence with any room takes what fits
    and the rest goes on as a piece of its own. Ties go to the earlier piece and sequence.
    """
    cost = np.zeros(n_sequences)
    free = np.full(n_sequences, capacity, np.int64)
    for piece in np.argsort(-lengths, kind="stable").tolist():
        at, left = 0, int(lengths[piece])
        while left:
            roomy = np.where(free >= left, cost, np.inf)
            k = int(roomy.argmin())
            if roomy[k] == np.inf:
                k = int(np.where(free > 0, cost, np.inf).argmin())
            take = min(left, int(free[k]))
            yield piece, at, take, k
            cost[k] += attention_cost(take, linear, quadratic)
            free[k] -= take
            at, left = at + take, left - take


class _Packer:
    """Packs a task's stream of tokenised documents, a window of whole sequences at a time."""

    def __init__(self, partition: int, capacity: int, window: int, linear: float, quadratic: float):
        self.capacity, self.window, self.linear, self.quadratic = capacity, window, linear, quadratic
        self.next_sequence = partition << 33
        self.doc, self.start, self.total, self.ids, self.tokens = [], [], [], [], 0

    def add(self, doc_id, ids: bytes) -> bool:
        """Adds a document, cut to pieces of at most a sequence; whether a window is full."""
        n = len(ids) // 4
        for at in range(0, n, self.capacity):
            self._keep(doc_id, at, n, ids[4 * at : 4 * (at + self.capacity)])
        return self.tokens >= self.window

    def _keep(self, doc_id, start: int, total: int, ids: bytes) -> None:
        self.doc.append(doc_id)
        self.start.append(start)
        self.total.append(total)
        self.ids.append(ids)
        self.tokens += len(ids) // 4

    def flush(self, last: bool) -> dict:
        """Rows of the sequences filled; what fills no whole sequence waits for the next window."""
        doc, start, total, ids = self.doc, self.start, self.total, self.ids
        lengths = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        n = -(-self.tokens // self.capacity) if last else self.tokens // self.capacity
        self.doc, self.start, self.total, self.ids, self.tokens = [], [], [], [], 0
        if not last:  # the smallest pieces, up to less than a sequence, go on to the next window
            over = int(lengths.sum()) - n * self.capacity
            for i in np.argsort(lengths, kind="stable").tolist():
                if not over:
                    break
                take = min(over, int(lengths[i]))
                keep = int(lengths[i]) - take
                self._keep(doc[i], start[i] + keep, total[i], ids[i][4 * keep :])
                lengths[i], over = keep, over - take
        out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_cost")}
        used, costs = np.zeros(n, np.int64), np.zeros(n)
        for piece, at, take, k in balance(lengths, n, self.capacity, self.linear, self.quadratic):
            out["doc_id"].append(doc[piece])
            out["start"].append(start[piece] + at)
            out["length"].append(take)
            out["ids_crc32"].append(zlib.crc32(ids[piece][4 * at : 4 * (at + take)]))
            out["doc_tokens"].append(total[piece])
            out["sequence_id"].append(self.next_sequence + k)
            out["offset"].append(int(used[k]))
            used[k] += take
            costs[k] += attention_cost(take, self.linear, self.quadratic)
        out["sequence_cost"] = costs[[s - self.next_sequence for s in out["sequence_id"]]] if n else []
        self.next_sequence += n
        return out


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    capacity: int = 2048,
    end_id: int = 1,
    window_tokens: int = 2048 * 1024,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    remembered: int = CACHE_PIECES,
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """Pack every document's ids, closed by ``end_id``, into sequences of at most ``capacity`` tokens.

    Each task packs the documents it reads, in windows of ``window_tokens``: no shuffle, memory
    of one window, and a task run again makes the same rows. A document longer than a sequence
    is cut; a window's last pieces are cut where that closes a gap, so that only the last
    sequences of a task have padding (less than ``capacity`` tokens in all). A worker remembers the
    ids of about ``remembered`` pieces and encodes ``chunk_chars`` characters at once.

    One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_cost`` (the estimate for its whole sequence). Null and empty texts are a document of
    the end id alone. Repeated rows are documents of their own; null ids stay null. An empty
    table has no pieces. Other columns are not read.
    """
    target = _arrow_schema(docs.sparkSession, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__, forget)
        encoder = json_encoder(tokenizer_file, remembered, chunk_chars)
        packer = _Packer(TaskContext.get().partitionId(), capacity, window_tokens, linear, quadratic)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(texts_of(batch))):
                if packer.add(doc_id, ids + end):
                    yield to_batch(packer.flush(last=False), target)
        yield to_batch(packer.flush(last=True), target)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack_documents(documents(spark, sf_dir), P.path("byte_bpe_50k.json"))
