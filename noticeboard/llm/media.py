"""Operator 10: media payload columns as content-defined chunks.

A payload is kept as 8-bit samples in a WAVE container. A gear hash cuts the media bytes
where their content says so; each distinct chunk is stored once, by the row that owns it
(the smallest id), and every media row is an ordered list of chunks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, documents, heavy_counted, map_batches, materialise, scratch, spread_join

#: Sample rate in the container's header; it has no effect on the samples.
RATE = 8000
#: Bits of the map of keys: it is 8 MB whatever the input.
KEY_BITS = 1 << 26
MIN_CHUNK, MASK_BITS, MAX_CHUNK = 1024, 12, 16384
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def pad(data: bytes, block: int = 64) -> bytes:
    """Zero bytes appended up to a positive multiple of ``block``."""
    return data + bytes(-len(data) % block if data else block)


def to_wave(payload: bytes) -> bytes:
    """One channel of 8-bit samples: header of 44 bytes, then the payload (even, so no pad byte)."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def from_wave(media: bytes) -> bytes:
    riff, _, wave, _, _, _, channels, _, _, _, bits, data, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, wave, data, channels, bits, len(media)) != (b"RIFF", b"WAVE", b"data", 1, 8, 44 + n):
        raise ValueError("not the stored form of a payload")
    return media[44:]


def gear_hash(data: bytes) -> np.ndarray:
    """Rolling gear hash behind each byte: sum of gear[byte j back] << j, of the last 32 bytes.

    The shift drops older bytes out of 32 bits, so five doubling steps give all of it.
    """
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def cut_points(data: bytes, least: int = MIN_CHUNK, bits: int = MASK_BITS, most: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks: behind a byte whose top hash bits are 0, ``least`` to ``most`` bytes on."""
    n, at, ends = len(data), 0, []
    marks = np.flatnonzero(gear_hash(data) >> np.uint32(32 - bits) == 0) + 1 if n > least else np.zeros(0, np.int64)
    while at < n:
        k = int(np.searchsorted(marks, at + least))
        end = min(int(marks[k]) if k < len(marks) else n, at + most, n)
        ends.append(end)
        at = end
    return ends


def split(data: bytes) -> list[bytes]:
    out, at = [], 0
    for end in cut_points(data):
        out.append(data[at:end])
        at = end
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=32).digest()


def feature(samples: bytes) -> str:
    """Mean, deviation, mean step and share of distinct levels of the 8-bit samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64)
    step = np.abs(np.diff(x)).mean() if len(x) > 1 else 0.0
    return f"mean={x.mean():.4f};std={x.std():.4f};step={step:.4f};levels={len(np.unique(x))}"


def row_keys(docs: DataFrame) -> DataFrame:
    """``key, doc_id, text``: the key is a digest of id and text, so repeated and null ids stay apart."""
    told = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))
    return docs.select(F.unhex(F.md5(told.cast("binary"))).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def chunk_lists(keyed: DataFrame) -> DataFrame:
    """``key, idx, digest`` of every chunk of every row's media."""

    def make():
        def work(batch):
            out = {"key": [], "idx": [], "digest": []}
            for key, data in zip(batch.column("key").to_pylist(), bytes_of(batch)):
                for i, chunk in enumerate(split(to_wave(pad(data)))):
                    out["key"].append(key)
                    out["idx"].append(i)
                    out["digest"].append(digest(chunk))
            return out

        return work

    return map_batches(keyed, make, "key binary, idx int, digest binary")


def key_bits(keys: DataFrame) -> np.ndarray:
    """A bitmap of ``KEY_BITS`` bits, one set for each key: its size does not depend on the keys' number."""
    place = F.conv(F.hex(F.substring("key", 1, 8)), 16, 10).cast("decimal(20,0)") % KEY_BITS
    spots = keys.select(place.cast("bigint").alias("p")).select((F.col("p") / 32).cast("bigint").alias("word"), (F.col("p") % 32).cast("int").alias("bit"))
    words = spots.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toPandas()
    out = np.zeros(KEY_BITS // 32, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def packs(keyed: DataFrame, bits, wanted: bool) -> DataFrame:
    """``key, doc_id, n_bytes, media_sha256, digests, chunks``: each row's ordered chunks, compressed one by one.

    Only rows whose bit in the broadcast bitmap is as ``wanted``.
    """

    def make():
        press = zstandard.ZstdCompressor(level=3)

        def work(batch):
            place = np.array([int.from_bytes(k[:8], "big") % KEY_BITS for k in batch.column("key").to_pylist()], np.int64)
            here = (bits.value[place // 32] >> (place % 32).astype(np.uint32)) & 1 == wanted
            if not here.any():
                return None
            batch = batch.filter(pa.array(here))
            data = bytes_of(batch)
            media = [to_wave(pad(x)) for x in data]
            chunks = [split(m) for m in media]
            return {
                "key": batch.column("key"),
                "doc_id": batch.column("doc_id"),
                "n_bytes": [len(x) for x in data],
                "media_sha256": [hashlib.sha256(m).hexdigest() for m in media],
                "digests": [[digest(c) for c in x] for x in chunks],
                "chunks": [[press.compress(c) for c in x] for x in chunks],
            }

        return work

    schema = "key binary, doc_id bigint, n_bytes bigint, media_sha256 string, digests array<binary>, chunks array<binary>"
    return map_batches(keyed, make, schema)


def store(docs: DataFrame) -> DataFrame:
    """Write the media of ``docs`` (``doc_id, text``) with every distinct chunk stored by one owner.

    Digests alone are shuffled to find each chunk's owner, the row with the smallest key, and
    the rows that borrow it. A bitmap of those rows' keys, of fixed size, tells which payloads
    must meet their lists by a join (compressed, once); the others are stored where they are
    read. A bit set by chance costs that move and no more. Returns the stored
    table, in the shared folder: ``key, doc_id, n_bytes, media_sha256, digests`` (the ordered
    list), ``own`` (a chunk or, where borrowed, null), ``lent`` and ``borrowed`` (positions that
    others refer to and that other rows own). The uses of a very common chunk are dealt to many tasks.
    """
    spark, keyed = docs.sparkSession, row_keys(docs)
    lists = chunk_lists(keyed)
    owner = lists.groupBy("digest").agg(F.min(F.struct("key", "idx")).alias("owner"), F.count("*").alias("uses"))
    owner = materialise(owner.where("uses > 1"))
    owned = (F.col("owner.key") == F.col("key")) & (F.col("owner.idx") == F.col("idx"))
    refs = spread_join(lists, owner, "digest", heavy_counted(owner, "digest", "uses")).select("key", "idx", owned.alias("owned"))
    per_row = refs.groupBy("key").agg(
        F.collect_set(F.when(~F.col("owned"), F.col("idx"))).alias("borrowed"),
        F.collect_set(F.when(F.col("owned"), F.col("idx"))).alias("lent"),
    )
    none = F.array().cast("array<int>")
    per_row = materialise(per_row)
    bits = spark.sparkContext.broadcast(key_bits(per_row))
    alone = packs(keyed, bits, False).withColumns({"borrowed": none, "lent": none})
    table = (
        packs(keyed, bits, True)
        .join(per_row.hint("merge"), "key", "left")
        .unionByName(alone)
        .withColumn("borrowed", F.coalesce("borrowed", none))
        .select(
            "key", "doc_id", "n_bytes", "media_sha256", "digests",
            F.expr("transform(chunks, (c, i) -> if(array_contains(borrowed, i), null, c))").alias("own"),
            F.coalesce("lent", none).alias("lent"), "borrowed",
        )
    )
    return materialise(table)


def read_back(table: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media_sha256, digests, chunks`` with borrowed chunks fetched from their owners.

    Rows that borrow nothing are read as they lie; for the others the lent chunks are joined
    by digest and gathered by row (a row's own chunk list bounds the group).
    """
    shelf = (
        table.where(F.size("lent") > 0)
        .select(F.explode("lent").alias("i"), "digests", "own")
        .select(F.element_at("digests", F.col("i") + 1).alias("digest"), F.element_at("own", F.col("i") + 1).alias("chunk"))
        .dropDuplicates(["digest"])
    )
    borrows = F.size("borrowed") > 0
    uses = table.where(borrows).select(F.explode("borrowed").alias("i"), "digests").groupBy(F.element_at("digests", F.col("i") + 1).alias("digest"))
    heavy = heavy_counted(uses.agg(F.count("*").alias("uses")), "digest", "uses")
    borrowers = table.where(borrows).withColumn("row", F.monotonically_increasing_id())
    wanted = borrowers.select("row", F.explode("borrowed").alias("idx"), "digests")
    wanted = wanted.select("row", "idx", F.element_at("digests", F.col("idx") + 1).alias("digest"))
    fetched = (
        spread_join(wanted, shelf, "digest", heavy)
        .groupBy("row")
        .agg(F.map_from_entries(F.collect_list(F.struct("idx", "chunk"))).alias("fetched"))
    )
    filled = borrowers.join(fetched, "row").withColumn("own", F.expr("transform(own, (c, i) -> coalesce(c, fetched[i]))"))
    columns = ["doc_id", "n_bytes", "media_sha256", "digests", F.col("own").alias("chunks")]
    return table.where(~borrows).select(columns).unionByName(filled.select(columns))


def reconstruct(rows: DataFrame) -> DataFrame:
    """Rebuild the media of :func:`read_back` and compute digests and features from the bytes read.

    A chunk whose digest, or media whose sha256, differs from what was stored is an error.
    """

    def make():
        open_ = zstandard.ZstdDecompressor()

        def work(batch):
            out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks")}
            columns = (batch.column(k).to_pylist() for k in ("chunks", "digests", "media_sha256"))
            for chunks, digests, told in zip(*columns):
                parts = [open_.decompress(c) for c in chunks]
                if [digest(p) for p in parts] != digests:
                    raise ValueError("a stored chunk is damaged")
                media = b"".join(parts)
                sha = hashlib.sha256(media).hexdigest()
                if sha != told:
                    raise ValueError("a chunk list does not give its media")
                payload = from_wave(media)
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-64:]))
                out["media_bytes"].append(len(media))
                out["media_sha256"].append(sha)
                out["feature"].append(feature(payload))
                out["n_chunks"].append(len(parts))
            return out | {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")}

        return work

    schema = (
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
        "media_bytes bigint, media_sha256 string, feature string, n_chunks int"
    )
    return map_batches(rows, make, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every whole text as media chunks, read the stored bytes back and compute features.

    Null and empty texts have a payload of 64 zero bytes. Rows with a repeated or null id each
    give a row. An empty table gives none. Other columns are not read. The stored table goes once
    it has been read back; :func:`store` keeps it.
    """
    with scratch() as keep:
        return keep(reconstruct(read_back(store(docs))))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))
