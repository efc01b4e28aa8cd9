"""Operator 4: MinHash near-dedup with sequential Bayesian verification."""

from __future__ import annotations

import functools
import hashlib
import math
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import (
    U64, bytes_of, copied, dealt, documents, heavy_counted, heavy_keys, map_batches, materialise, mix64, odd_constants, release, scratch, spread_join
)
from .components import connected_components

#: Shingle hashes that are permuted at once: the block stays in the processor's cache.
BLOCK = 2048


@dataclass(frozen=True)
class NearDedup:
    """What counts as a near-duplicate and how candidates are found.

    Sets of ``words``-word shingles are linked if 100 * intersection >= ``percent`` * union.
    ``bands`` bands of ``rows`` hashes make a pair at the threshold s candidates except with
    probability (1 - s ** rows) ** bands; a candidate is dropped early only if the posterior
    probability that it reaches the threshold is below ``miss``. What hubs
    leave apart is compared in blocks of ``block`` signatures, with one bit of each of ``fine``
    further hashes.
    """

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    batch: int = 16
    miss: float = 1e-7
    block: int = 256
    fine: int = 4096


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """The set of shingle hashes, ascending; A-Z lowered, words between ASCII white space.

    A text with fewer words than a shingle has its whole sequence as one; none without words.
    """
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, tokens)), np.uint64)
    k = min(words, len(h))
    total = np.zeros(len(h) - k + 1, np.uint64)
    for i, c in enumerate(odd_constants(k, 7)):
        total += mix64(h[i : len(h) - k + 1 + i]) * c
    return np.unique(mix64(total + U64(k)))


def signature(hashes: np.ndarray, n: int, seed: int = 11) -> np.ndarray:
    """The least of each of ``n`` permutations (32-bit multiply-add) over a set of shingle hashes."""
    x = (hashes >> U64(32)).astype(np.uint32)
    a = odd_constants(n, seed).astype(np.uint32)[:, None]
    b = odd_constants(n, seed + 2).astype(np.uint32)[:, None]
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), BLOCK):
        y = a * x[None, i : i + BLOCK] + b
        np.minimum(out, y.min(axis=1), out=out)
    return out


@functools.cache
def least_matches(threshold: float, n: int, miss: float) -> int:
    """Fewest equal hashes of ``n`` with which a pair may still reach ``threshold``.

    With a uniform prior the posterior of the similarity after m of n matches is
    Beta(m + 1, n - m + 1); its tail above the threshold is P(Binomial(n + 1, threshold) <= m).
    """
    if threshold >= 1:
        return n
    tail = 0.0
    for m in range(n + 1):
        ways = math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
        tail += math.exp(ways + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
        if tail >= miss:
            return m
    return n


def sketches(docs: DataFrame, conf: NearDedup) -> DataFrame:
    """``doc_id, n_shingles, set_hash, sig`` of every whole text; empty sets have a null ``set_hash``."""

    def make():
        def work(batch):
            out = {k: [] for k in ("n_shingles", "set_hash", "sig")}
            for text in bytes_of(batch):
                hashes = shingle_hashes(text, conf.words)
                out["n_shingles"].append(len(hashes))
                out["set_hash"].append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
                out["sig"].append(signature(hashes, conf.bands * conf.rows).astype("<u4").tobytes() if len(hashes) else None)
            return out | {"doc_id": batch.column("doc_id")}

        return work

    return map_batches(docs, make, "doc_id bigint, n_shingles bigint, set_hash binary, sig binary")


def keys_of(sigs: np.ndarray, conf: NearDedup) -> np.ndarray:
    """A hash of each band of each signature."""
    bands = sigs.reshape(len(sigs), conf.bands, conf.rows).astype(np.uint64)
    key = np.arange(conf.bands, dtype=np.uint64)[None, :] + U64(1)
    for r in range(conf.rows):
        key = mix64(key * U64(0x9E3779B97F4A7C15) + bands[:, :, r])
    return key.view(np.int64)


def band_keys(reps: DataFrame, conf: NearDedup) -> DataFrame:
    """``key, rep, band`` for each band of each representative's signature."""

    def make():
        def work(batch):
            if not len(batch):
                return None
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(len(batch), -1)
            band = np.tile(np.arange(conf.bands, dtype=np.int32), len(batch))
            return {"key": keys_of(sigs, conf).reshape(-1), "rep": np.repeat(batch.column("rep").to_numpy(), conf.bands), "band": band}

        return work

    return map_batches(reps, make, "key bigint, rep bigint, band int")


def surviving(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, batch: int, threshold: float, miss: float) -> np.ndarray:
    """Positions of the pairs ``a[i], b[j]`` of signatures that no batch of hashes rules out."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int64)
    for start in range(0, a.shape[1], batch):
        end = min(start + batch, a.shape[1])
        matches[alive] += (a[i[alive], start:end] == b[j[alive], start:end]).sum(axis=1)
        alive = alive[matches[alive] >= least_matches(threshold, end, miss)]
    return alive


def fine_signatures(reps: DataFrame, docs: DataFrame, conf: NearDedup) -> DataFrame:
    """``rep, fine``: a scrambled bit of each of further hashes of the documents ``reps(rep)``.

    A bit of the hash itself would be one of the shingle's, and not be drawn anew by each permutation.
    """

    def make():
        def bits(text: bytes) -> bytes:
            least = signature(shingle_hashes(text, conf.words), conf.fine, 17).astype(np.uint64)
            return np.packbits((mix64(least) >> U64(40)).astype(np.uint8) & 1).tobytes()

        def work(batch):
            return {"rep": batch.column("rep"), "fine": [bits(t) for t in bytes_of(batch)]}

        return work

    rows = docs.join(reps.select(F.col("rep").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("rep"), "text")
    return map_batches(rows, make, "rep bigint, fine binary").dropDuplicates(["rep"])


def prune(pairs: DataFrame, conf: NearDedup) -> DataFrame:
    """``a, b`` of the pairs ``a, b, sig_a, sig_b`` that survive every batch of hashes."""

    def make():
        def work(batch):
            if not len(batch):
                return None
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(len(batch), -1) for c in ("sig_a", "sig_b"))
            at = np.arange(len(batch))
            alive = surviving(a, b, at, at, conf.batch, conf.percent / 100, conf.miss)
            return {c: batch.column(c).to_numpy()[alive] for c in ("a", "b")}

        return work

    return map_batches(pairs.select("a", "b", "sig_a", "sig_b"), make, "a bigint, b bigint")


def with_signatures(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs ``a, b`` with ``sig_a, sig_b``; the pairs of a hub are dealt to many tasks."""
    left = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"))
    right = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))
    return spread_join(pairs, left, "a", heavy_keys(pairs, "a")).join(right, "b")


def verify(pairs: DataFrame, docs: DataFrame, conf: NearDedup) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets reach the threshold, from the documents' texts.

    Each first side's pairs lie together behind one row that carries its text, so its set is made
    once; the pairs of a hub that very many name are dealt to many tasks first.
    """
    heavy_a, heavy_b = heavy_keys(pairs, "a"), heavy_keys(pairs, "b")
    texts = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    hubs = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    rows = dealt(pairs.select("a", "b"), "a", heavy_a).withColumnRenamed("_part", "_deal")
    rows = spread_join(rows, texts, "b", heavy_b)
    rows = rows.join(copied(hubs, "a", heavy_a).withColumnRenamed("_part", "_deal"), ["a", "_deal"])
    first = F.row_number().over(Window.partitionBy("a", "_deal").orderBy("b")) == 1
    rows = rows.select("a", F.when(first, F.struct("text_a")).alias("hub"), "b", "text_b")

    def make():
        at, known = None, None

        def work(batch):
            nonlocal at, known
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            hub, keep = batch.column("hub"), []
            for i, (x, text_b) in enumerate(zip(a, bytes_of(batch, "text_b"))):
                if hub[i].is_valid:
                    at, known = x, shingle_hashes((hub[i].as_py()["text_a"] or "").encode(), conf.words)
                if at != x:
                    raise RuntimeError("a pair lies apart from its hub's text")
                other = shingle_hashes(text_b, conf.words)
                both = len(np.intersect1d(known, other, assume_unique=True))
                if 100 * both >= conf.percent * (len(known) + len(other) - both):
                    keep.append(i)
            return {"a": [a[i] for i in keep], "b": [b[i] for i in keep]}

        return work

    return map_batches(rows, make, "a bigint, b bigint")


def _hub_pairs(buckets: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """``a, b``: each bucket's hub with its other members; the hub meets most others in its buckets.

    Of texts edited from one original, each edited otherwise, the original meets most, so that
    one star joins them all. A hub's fame is larger than its members', so a pair has one order.
    """
    fame = buckets.groupBy("rep").agg(F.sum("n").alias("fame"))
    ranked = buckets.join(fame, "rep")
    hubs = ranked.groupBy("key").agg(F.max_by("rep", F.struct("fame", -F.col("rep"))).alias("hub"))
    pairs = spread_join(buckets.select("key", "rep"), hubs, "key", heavy).where("hub <> rep")
    return pairs.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()


def _blocks(torn: DataFrame, heavy: DataFrame | None, reps: DataFrame, docs: DataFrame, conf: NearDedup) -> DataFrame:
    """``key, block, members``: a bucket's largest component, and the rest of its members, in blocks.

    Blocks of the largest component have odd numbers; a bucket that fits in one block is one. A member knows the bucket's ``band`` and, as bits of
    ``met``, the bands of all its buckets that are compared.
    """
    sizes = torn.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    largest = F.col("component") == F.col("main")
    parts = F.ceil(F.when(largest, F.col("most")).otherwise(F.col("all") - F.col("most")) / conf.block)
    block = F.when(F.col("all") <= conf.block, F.lit(0)).otherwise(F.pmod(F.xxhash64("rep"), parts) * 2 + largest.cast("int")).cast("bigint")
    named = spread_join(torn, main, "key", heavy).select("key", "rep", "component", "band", block.alias("block"))
    fine = materialise(fine_signatures(torn.select("rep").distinct(), docs, conf))
    met = torn.groupBy("rep").agg(F.bit_or(F.expr("shiftleft(1L, band)")).alias("met"))
    member = F.struct("rep", "component", "n_shingles", "sig", "fine", "band", "met")
    return named.join(reps, "rep").join(fine, "rep").join(met, "rep").groupBy("key", "block").agg(F.collect_list(member).alias("members"))


def _block_survivors(met: DataFrame, blocks: DataFrame, conf: NearDedup, skip: int, width: int) -> DataFrame:
    """``a, b, x, y, key, block, other, left``: for each two components ``x, y`` of a pair of blocks
    ``met(key, block, other)``, the likeliest pairs of members, from number ``skip`` on, ``width`` at most.

    Each pair of blocks is one row, compared in one vectorised step: candidate pairs never become
    rows. A pair must be of two components and not be ruled out by the signatures; it is given by the
    first of its common buckets only. ``left`` tells how many more there are.
    """
    own = blocks.where("block % 2 = 0")  # in the first round each of them meets itself
    if skip:
        own = own.join(met.where("block = other").select("key", "block"), ["key", "block"], "left_semi")
    own = own.withColumns({"other": F.col("block"), "others": F.array().cast(blocks.schema["members"].dataType)})
    two = met.where("block <> other").join(blocks, ["key", "block"])
    two = two.join(blocks.select("key", F.col("block").alias("other"), F.col("members").alias("others")), ["key", "other"])
    rows = own.unionByName(two)
    threshold = conf.percent / 100
    by_bit = threshold + (1 - threshold) / 2  # two different hashes share a bit so often

    def columns(members: list[dict]):
        rep, component, n = (np.array([m[k] for m in members], np.int64) for k in ("rep", "component", "n_shingles"))
        table = lambda k, kind: np.frombuffer(b"".join(m[k] for m in members), kind).reshape(len(members), -1)
        return rep, component, n, table("sig", "<u4"), np.unpackbits(table("fine", np.uint8), axis=1)

    def compare(members: list[dict], others: list[dict]) -> np.ndarray | None:
        """Rows of a, b, x, y, left; without ``others`` the members are compared with each other."""
        rep_a, of_a, n_a, a, fine_a = columns(members)
        rep_b, of_b, n_b, b, fine_b = columns(others or members)
        few, many = np.minimum(n_a[:, None], n_b[None, :]), np.maximum(n_a[:, None], n_b[None, :])
        may = (of_a[:, None] != of_b[None, :]) & (100 * few >= conf.percent * many)
        if not others:
            may &= rep_a[:, None] < rep_b[None, :]
        i, j = np.nonzero(may)
        alive = surviving(a, b, i, j, conf.batch, threshold, conf.miss)
        i, j = i[alive], j[alive]
        alive = surviving(fine_a, fine_b, i, j, 256, by_bit, conf.miss)
        i, j = i[alive], j[alive]
        if not len(i):
            return None
        bands = np.arange(conf.bands)
        common = (a[i] == b[j]).reshape(len(i), conf.bands, conf.rows).all(axis=2)
        common &= ((np.array([m["met"] for m in members], np.int64)[i, None] >> bands) & 1).astype(bool)
        first = common.argmax(axis=1) == members[0]["band"]
        i, j = i[first], j[first]
        if not len(i):
            return None
        swap = rep_a[i] > rep_b[j]
        p, q = np.where(swap, rep_b[j], rep_a[i]), np.where(swap, rep_a[i], rep_b[j])
        x, y = np.where(swap, of_b[j], of_a[i]), np.where(swap, of_a[i], of_b[j])
        alike = np.zeros(len(i), np.int64)
        for at in range(0, len(i), BLOCK):
            part = slice(at, at + BLOCK)
            alike[part] = (fine_a[i[part]] == fine_b[j[part]]).sum(axis=1)
        u, v = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((q, p, -alike, v, u))
        p, q, u, v = p[order], q[order], u[order], v[order]
        start = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])))
        size = np.diff(np.append(start, len(u)))
        place = np.arange(len(u)) - np.repeat(start, size)
        left = np.maximum(np.repeat(size, size) - skip - width, 0)
        take = (place >= skip) & (place < skip + width)
        return np.stack([p[take], q[take], u[take], v[take], left[take]])

    def make():
        def work(batch):
            out = {k: [] for k in ("a", "b", "x", "y", "left", "key", "block", "other")}
            for key, block, other, members, others in zip(*(batch.column(c).to_pylist() for c in ("key", "block", "other", "members", "others"))):
                got = compare(members, others)
                if got is not None:
                    for k, values in zip(("a", "b", "x", "y", "left"), got):
                        out[k].append(values)
                    for k, value in (("key", key), ("block", block), ("other", other)):
                        out[k].append(np.full(got.shape[1], value, np.int64))
            return {k: np.concatenate(v) for k, v in out.items()} if out["a"] else None

        return work

    columns_ = "a bigint, b bigint, x bigint, y bigint, left bigint, key bigint, block bigint, other bigint"
    return map_batches(rows.select("key", "block", "other", "members", "others"), make, columns_)


def _join_torn(torn: DataFrame, labels: DataFrame, heavy: DataFrame | None, reps: DataFrame, docs: DataFrame, conf: NearDedup, width: int = 16) -> DataFrame:
    """``labels`` after all links between the components that one bucket of ``torn`` holds.

    One verified link joins two components, so their pairs are tried by rounds, the likeliest first:
    each round takes ``width`` times as many of the pairs of two components, and only of those that
    no link has joined by then. Every pair is tried in the end unless its components are one.
    """
    blocks = materialise(_blocks(torn, heavy, reps, docs, conf))
    ids = blocks.select("key", "block")
    met = ids.join(ids.withColumnRenamed("block", "other"), "key").where("block <= other AND (block % 2 = 0 OR other % 2 = 0)")
    links, now, skip, most = None, labels, 0, width
    while True:
        tried = materialise(_block_survivors(met, blocks, conf, skip, most))
        pairs = materialise(tried.select("a", "b").distinct())
        found = materialise(verify(pairs, docs, conf))
        links = found if links is None else links.unionByName(found)
        now = _joined(labels, links)
        more = tried.where("left > 0").select("key", "block", "other", "x", "y").distinct()
        name = now.select(F.col("node"), "component")
        for side in "xy":
            more = more.join(name.withColumnsRenamed({"node": side, "component": f"{side}_now"}), side, "left")
        open_ = more.where(F.coalesce("x_now", "x") != F.coalesce("y_now", "y")).select("key", "block", "other").distinct()
        met = materialise(open_)
        release(tried, pairs)
        if met.isEmpty():
            return now
        skip, most = skip + most, width * most


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: the links join whole components, so only those are walked again."""
    a, b = (labels.select(F.col("node").alias(side), "component") for side in "ab")
    named = links.join(a, "a", "left").select(F.coalesce("component", "a").alias("x"), "b").join(b, "b", "left")
    named = named.select(F.col("x").alias("a"), F.coalesce("component", "b").alias("b"))
    merged = materialise(connected_components(named))
    moved = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = merged.join(labels.select("node"), "node", "left_anti").select("node", "component")
    return materialise(old.union(fresh))


def _torn(buckets: DataFrame, labels: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """``key, rep, band, component`` of the buckets that hold more than one component.

    The one pair of a bucket of two was tried with its hub, and of buckets with the same members one is enough.
    """
    named = buckets.where("n > 2").select("key", "rep", "band").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("key", "rep", "band", F.coalesce("component", "rep").alias("component"))
    total = lambda seed: F.sum(F.xxhash64("rep", F.lit(seed)).cast("decimal(38,0)"))
    told = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), total(1).alias("p"), total(2).alias("q"), F.count("*").alias("n"))
    torn = told.where("x <> y").groupBy("p", "q", "n").agg(F.min("key").alias("key"))
    return spread_join(named, torn.select("key"), "key", heavy)


def repeated_ids(docs: DataFrame) -> DataFrame:
    """``doc_id, _rows`` of the ids that several rows have; only ids are shuffled to find them."""
    ids = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    return materialise(ids.agg(F.count("*").alias("_rows")).where("_rows > 1"))


def near_duplicates(docs: DataFrame, conf: NearDedup = NearDedup()) -> DataFrame:
    """Components of near-duplicate documents: ``doc_id, n_shingles, component_id, kept``.

    1. Documents with one set form a class, shown by its smallest id: copies are never compared.
    2. Each band bucket links its members to a hub, not to each other. Candidates are pruned by
       posterior bounds over signature batches and the survivors verified on full sets.
    3. What then still lies in different components of a bucket is compared block by block, and of
       the pairs of two components as many are verified, the likeliest first, as it takes to find a
       link; one is lost only if no band shows it. This is the one step whose comparisons are not
       linear: members outside a bucket's largest component times all. Rows are not made of them.

    ``component_id`` is the smallest id reachable. Null and empty texts, and texts without words,
    have an empty set, link with nothing and stay. A repeated id is one document of its
    smallest text that is not null, which each of its rows shows; rows with a null id stay as they
    are with a null component. An empty table gives no rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    with scratch() as keep:
        return keep(_near_duplicates(docs, conf))


def _near_duplicates(docs: DataFrame, conf: NearDedup) -> DataFrame:
    repeated = repeated_ids(docs)
    again = not repeated.isEmpty()
    if again:
        smallest = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        docs = docs.join(repeated, "doc_id", "left_anti").unionByName(materialise(smallest))
    sketch = materialise(sketches(docs, conf))
    known = sketch.where("set_hash IS NOT NULL AND doc_id IS NOT NULL")
    same = [F.any_value(c).alias(c) for c in ("n_shingles", "sig")]
    classes = materialise(known.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), *same))
    wide, sketch = sketch, materialise(sketch.select("doc_id", "n_shingles", "set_hash"))
    release(wide)
    reps = classes.select("rep", "n_shingles", "sig")
    all_keys = band_keys(reps, conf)
    shared = materialise(all_keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    heavy = heavy_counted(shared, "key", "n")
    buckets = materialise(spread_join(all_keys, shared, "key", heavy))

    docs = materialise(docs.join(buckets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    candidates = materialise(_hub_pairs(buckets, heavy))
    candidates = materialise(prune(with_signatures(candidates, reps), conf))
    labels = materialise(connected_components(verify(candidates, docs, conf)))
    torn = materialise(_torn(buckets, labels, heavy))
    if not torn.isEmpty():
        labels = _join_torn(torn, labels, heavy, reps, docs, conf)

    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("set_hash", F.coalesce("component", "rep").alias("component"))
    told = "set_hash IS NOT NULL"
    members = spread_join(sketch.where(told).select("set_hash", "doc_id", "n_shingles"), named, "set_hash", heavy_counted(classes, "set_hash", "n"), "left")
    alone = sketch.where(f"NOT ({told})").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    members = members.select("doc_id", "n_shingles", "component").unionByName(alone)
    if again:
        copies = F.explode(F.sequence(F.lit(1), F.coalesce("_rows", F.lit(1))))
        rows = members.where("doc_id IS NOT NULL").join(repeated, "doc_id", "left").withColumn("_copy", copies)
        members = rows.select("doc_id", "n_shingles", "component").unionByName(members.where("doc_id IS NULL"))
    # a row without an id links with nothing
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return members.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), NearDedup(words=3, percent=85, bands=28))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 3 THEN array_to_string(ws[i:i + 2], ' ') ELSE array_to_string(ws, ' ') END AS shingle
  FROM w, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1)) + 1)) AS u(i)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a
), c AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
