"""Operator 11: divergence of sources' vocabularies, counted by an automaton of each block's kept terms."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _arrow_schema, bytes_of, claim, documents, give_back, materialise, release, scratch

#: Bytes of text in a block. A block's vocabulary, its automaton and its counts are bounded by it.
BLOCK_BYTES = 32 << 20
#: Rows of a table up to which it is broadcast; beyond that, joins shuffle and AQE splits skewed parts.
BROADCAST_ROWS = 1 << 16
#: Pairs of postings expanded at once, and sums that a task holds before it gives them out.
EXPANDED, HELD = 1 << 20, 1 << 22
#: Parts to which a language's rows are dealt in joins by language.
PARTS = 32
#: Probabilities are in units of 1 / SCALE.
SCALE = 1_000_000_000
#: Of each byte: ASCII letters in lower case, bytes of other characters as they are, all else a delimiter.
NORMAL = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))


def staged(docs: DataFrame) -> DataFrame:
    """One pass over the texts: ``block, lang, source, payload`` of each group in a block, ``block, lang, term, n_docs`` of each term.

    A task cuts what it reads into blocks of ``BLOCK_BYTES``; a block holds whole documents, so one with a longer
    text is as large as that. The payload is the normalised texts, parted by delimiters and compressed;
    ``n_docs`` is the exact number of the block's documents of that language with the term.
    """
    schema = "block bigint, lang binary, source binary, payload binary, n_bytes bigint, term binary, n_docs bigint"
    target = _arrow_schema(docs.sparkSession, schema)

    def rows(block: int, texts: dict, found: dict) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        kinds = [{"block": block, "lang": lang, "source": source, "payload": codec.compress(b" " + b" ".join(t) + b" ", asbytes=True), "n_bytes": sum(map(len, t)) + len(t) + 1} for (lang, source), t in texts.items()]
        yield from pa.Table.from_pylist(kinds, schema=target).to_batches()
        for lang, counts in found.items():
            n = len(counts)
            columns = {"block": np.full(n, block), "lang": [lang] * n, "source": [None] * n, "payload": [None] * n, "n_bytes": [None] * n, "term": list(counts), "n_docs": list(counts.values())}
            yield from pa.table([pa.array(columns[f.name], f.type) for f in target], schema=target).to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        block, size, texts, found = TaskContext.get().partitionId() << 32, 0, defaultdict(list), defaultdict(Counter)
        for batch in batches:
            for lang, source, text in zip(bytes_of(batch, "lang"), bytes_of(batch, "source"), bytes_of(batch)):
                terms = text.translate(NORMAL).split()
                texts[lang, source].append(b" ".join(terms))
                found[lang].update(set(terms))
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield from rows(block, texts, found)
                    block, size, texts, found = block + 1, 0, defaultdict(list), defaultdict(Counter)
        if texts:
            yield from rows(block, texts, found)
        del texts, found
        give_back()

    return docs.select("lang", "source", "text").mapInArrow(run, schema)


def recount(payloads: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``lang, source, term, n``: occurrences of kept terms, by one automaton for each language of a block.

    Terms are padded with delimiters, so that a match is a whole term. Bytes stand as single characters, whatever they encode.
    """
    schema = "lang binary, source binary, term binary, n bigint"

    def count(texts: pa.Table, kept: pa.Table) -> pa.Table:
        import ahocorasick

        claim(__name__)
        out = {k: [] for k in ("lang", "source", "term", "n")}
        terms = defaultdict(list)
        for lang, term in zip(kept.column("lang").to_pylist(), kept.column("term").to_pylist()):
            terms[lang].append(term)
        rows = sorted(zip(*(texts.column(c).to_pylist() for c in ("lang", "source", "payload", "n_bytes"))), key=lambda r: r[0])
        automaton, of = None, None
        for lang, source, payload, n_bytes in rows:
            if lang not in terms:
                continue
            if of != lang:
                automaton, of = ahocorasick.Automaton(), lang
                for i, term in enumerate(terms[lang]):
                    automaton.add_word(" " + term.decode("latin-1") + " ", i)
                automaton.make_automaton()
            text = pa.Codec("zstd").decompress(payload, n_bytes, asbytes=True).decode("latin-1")
            counts = np.bincount(np.fromiter((i for _, i in automaton.iter(text)), np.int64), minlength=1)
            hit = counts.nonzero()[0]
            out["lang"] += [lang] * len(hit)
            out["source"] += [source] * len(hit)
            out["term"] += [terms[lang][i] for i in hit.tolist()]
            out["n"] += counts[hit].tolist()
        del automaton, terms
        give_back()
        return pa.table({k: pa.array(v, pa.int64() if k == "n" else pa.binary()) for k, v in out.items()})

    kept = vocabulary.select(F.col("block").alias("in_block"), F.col("lang").alias("lang"), F.col("term").alias("term"))
    return payloads.groupBy("block").cogroup(kept.groupBy("in_block")).applyInArrow(count, schema)


def probability(count, total, kept) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exact."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(20,0))) div cast({total} + {kept} as decimal(20,0))")


def gap(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / q)."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def sized(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def met(lists: DataFrame) -> DataFrame:
    """``lang, source, item, v``: for pairs of groups, what terms that both have add beyond their marginals.

    ``lists`` has a term's postings ``held`` (source, p, base). A task expands a term's pairs in memory and gives out sums by pair
    of groups, so rows do not grow with terms times pairs.
    """
    schema = "lang binary, source binary, item binary, v bigint"
    target = _arrow_schema(lists.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        place: dict[bytes, dict[bytes, int]] = defaultdict(dict)
        sums: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))

        def given() -> Iterator[pa.RecordBatch]:
            for lang, found in sums.items():
                names = list(place[lang])
                code = np.fromiter(found, np.int64, len(found))
                columns = [[lang] * len(code), [names[i] for i in (code >> 32).tolist()], [names[i] for i in (code & 0xFFFFFFFF).tolist()], list(found.values())]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, target)], schema=target)
            sums.clear()

        for batch in batches:
            held = batch.column("held")
            ends = held.offsets.to_numpy().astype(np.int64) - held.offsets[0].as_py()
            flat = held.flatten()
            p, base = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("p", "base"))
            sources = flat.field("source").to_pylist()
            langs = batch.column("lang").to_pylist()
            sizes = np.diff(ends)
            ix = np.empty(len(sources), np.int64)
            for t, lang in enumerate(langs):
                at = place[lang]
                for j in range(ends[t], ends[t + 1]):
                    ix[j] = at.setdefault(sources[j], len(at))
            of = defaultdict(list)
            for t, lang in enumerate(langs):
                if sizes[t] > 1:
                    of[lang].append(t)
            for lang, terms in of.items():
                for block, rows in _expanded(np.array(terms), sizes, ends):
                    a, b = block, rows
                    value = _gap(p[a], p[b]) - _gap(p[a], base[b]) - _gap(base[a], p[b]) + _gap(base[a], base[b])
                    code, inverse = np.unique(ix[a] << 32 | ix[b], return_inverse=True)
                    total = np.zeros(len(code), np.int64)
                    np.add.at(total, inverse, value)
                    add = sums[lang]
                    for c, v in zip(code.tolist(), total.tolist()):
                        add[c] += v
            if sum(map(len, sums.values())) > HELD:
                yield from given()
        yield from given()

    return lists.select("lang", "held").mapInArrow(run, schema)


def _expanded(terms: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of all ordered pairs of different postings of these terms, about ``EXPANDED`` at a time.

    A posting of a term that alone has more pairs is expanded in several steps.
    """
    first = np.repeat(ends[terms], sizes[terms])
    width = np.repeat(sizes[terms], sizes[terms])
    place = np.arange(len(first)) - np.repeat(np.cumsum(sizes[terms]) - sizes[terms], sizes[terms]) + first
    done = np.cumsum(width)
    at = 0
    while at < len(place):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + EXPANDED, "right")))
        a = np.repeat(place[at:to], width[at:to])
        step = np.arange(len(a)) - np.repeat(np.cumsum(width[at:to]) - width[at:to], width[at:to])
        b = np.repeat(first[at:to], width[at:to]) + step
        keep = a != b
        yield a[keep], b[keep]
        at = to


def source_divergence(docs: DataFrame, least_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far the vocabularies of a language's sources are apart.

    Each language keeps the terms of ``least_docs`` of its documents. With p of a group (language and source) and q of
    another source, part ``pair`` has the sum of floor((p - q)^2 / q) over all kept terms; part ``term`` has it for the terms in
    which a group exceeds its language, the first ``top_terms`` of a group.

    Two passes: exact document frequencies by block, summed; then each block's own kept terms, an automaton bounded by the
    block whatever the corpus, count all occurrences. A group's p is one value, ``base``, for every term that it lacks,
    so a pair's sum over all terms is that of the bases, plus marginal sums over a histogram of each group's p, plus what terms add that both
    have. All sums are exact integers. Counts combine in tasks before each shuffle, so frequent terms and large groups are a row a task.

    Null texts, languages and sources are empty ones; each repeated row is a document. A language without kept
    terms has pairs of value 0. A source alone in its language has no pairs. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    with scratch() as keep:
        stage = materialise(staged(rows))
        texts, terms = stage.where("payload IS NOT NULL"), stage.where("term IS NOT NULL")
        same = Window.partitionBy("lang", "term")  # a row a block, so few rows a term; it spills
        known = terms.select("block", "lang", "term", F.sum("n_docs").over(same).alias("n"), (F.col("block") == F.min("block").over(same)).alias("first"))
        vocabulary = materialise(known.where(F.col("n") >= least_docs).drop("n"))
        counted = recount(texts.select("block", "lang", "source", "payload", "n_bytes"), vocabulary)
        postings = materialise(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")))
        members = texts.select("lang", "source").distinct()
        sizes = vocabulary.where("first").groupBy("lang").agg(F.count("*").alias("v"))
        totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = members.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "v"])
        groups = materialise(groups.withColumn("base", F.when(F.col("v") > 0, probability("0", "total", "v"))))
        release(stage, vocabulary)
        of = sized(groups)
        posted = postings.join(of, ["lang", "source"]).withColumn("p", probability("n", "total", "v"))
        held = F.collect_list(F.struct("source", "p", "base")).alias("held")
        lists = materialise(posted.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.first("v").alias("v"), held))

        langs = groups.groupBy("lang").agg(F.sum("total").alias("total"))
        each = lists.join(sized(langs), "lang").withColumn("q", probability("n", "total", "v"))
        each = each.select("lang", F.col("term").alias("item"), "q", F.inline("held")).where("p > q")
        best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        top = each.select("lang", "source", F.lit("term").alias("part"), "item", F.expr(gap("p", "q")).alias("value"))
        top = top.withColumn("_part", F.pmod(F.xxhash64("item"), F.lit(PARTS)))  # first of a group's parts, so that a large group is not one task's
        some = Window.partitionBy("lang", "source", "_part").orderBy(F.desc("value"), "item")
        top = top.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top_terms).drop("_part")
        top = top.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)

        wide = F.col("value").cast("decimal(38,0)")
        other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("base_b"))
        other = other.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        spread = lambda x, *by: x.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(PARTS)).cast("int"))
        plain = spread(groups, "source").join(other, ["lang", "_part"]).where("source <> item")
        plain = plain.select("lang", "source", "item", F.expr(f"coalesce(cast(v as decimal(20,0)) * ({gap('base', 'base_b')}), 0)").alias("value"))
        hist = posted.groupBy("lang", "source", "base", "p").agg(F.count("*").alias("m"))
        ours, theirs = (f"m * (({gap(p, q)}) - ({gap(a, b)}))" for p, q, a, b in (("p", "base_b", "base", "base_b"), ("base_b", "p", "base_b", "base")))
        edge = spread(hist, "source", "p").join(other, ["lang", "_part"]).where("source <> item")
        edge = edge.select("lang", "source", "item", F.expr(ours).cast("decimal(38,0)").alias("x"), F.expr(theirs).cast("decimal(38,0)").alias("y"))
        edge = edge.groupBy("lang", "source", "item").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
        both = F.array(F.struct("source", "item", F.col("x").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("y").alias("value")))
        edge = edge.select("lang", F.inline(both))
        common = met(lists).select("lang", "source", "item", F.col("v").alias("value"))
        parts = [x.select("lang", "source", "item", wide.alias("value")) for x in (plain, edge, common)]
        pairs = parts[0].union(parts[1]).union(parts[2]).groupBy("lang", "source", "item").agg(F.sum("value").cast("bigint").alias("value"))
        pairs = pairs.withColumn("rank", F.row_number().over(best))
        pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
        text = [F.col(c).cast("string").alias(c) for c in ("lang", "source", "part", "item")]
        return keep(pairs.union(top).select(*text, "value", "rank"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), occurrences AS (
  SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term FROM occurrences GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM occurrences JOIN kept USING (lang, term) GROUP BY 1, 2, 3
), members AS (
  SELECT DISTINCT lang, source FROM docs
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY 1
), totals AS (
  SELECT m.lang, m.source, coalesce(sum(c.n), 0) AS total FROM members m LEFT JOIN counts c USING (lang, source) GROUP BY 1, 2
), dense AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + 1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT // (t.total + s.v)::HUGEINT AS BIGINT) AS p
  FROM totals t JOIN sizes s USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), whole AS (
  SELECT lang, term, CAST(1 + 1000000000 * (n + 1)::HUGEINT // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))::HUGEINT AS BIGINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY 1, 2)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM members a JOIN members b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
             FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3) x
    ON x.lang = a.lang AND x.source = a.source AND x.other = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
  FROM dense JOIN whole USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
WHERE part = 'pair' OR rank <= 200
"""
