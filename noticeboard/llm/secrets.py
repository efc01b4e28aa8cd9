"""Operator 7: secret scan with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, heavy_counted, map_batches, materialise, scratch, spread_join, texts_of, unused

# Fixed patterns of the base kinds and of the kinds that the method adds, in the order of the listing.
BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I),
    "access": re.compile(r"AKIA[A-Z0-9]{12,}"),
    "hex": re.compile(r"[0-9a-f]{32,}"),
}
MORE = {
    "private": re.compile(
        r"""-----BEGIN\x20(?:[A-Z]+\x20)*PRIVATE\x20KEY-----
        (?: ((?:(?!-----).)*+) -----END\x20(?:[A-Z]+\x20)*PRIVATE\x20KEY-----
          | ( (?: (?:\s|\\[nr])*+ (?:Proc-Type|DEK-Info|Comment):[^\n\\]*+ )*+
              (?: (?:\s|\\[nr]|["'>\#])*+ [A-Za-z0-9+/]{16,}+ ={0,2} (?![\w.+/=-]) )*+
              (?: (?<=[A-Za-z0-9+/=]{16}) \x20*+ (?:\r?\n|(?:\\r)?\\n) [\x20"'>\#]*+ [A-Za-z0-9+/]{1,15}+ ={0,2} (?=["']?\s*+(?:$|\n|\\[nr])) )? ) )""",
        re.A | re.S | re.X,
    ),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "prefixed": re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"),
}
KINDS = [*BASE, *MORE]
#: White space in a key's body, also as the escapes of a quoted string.
BLANKS = re.compile(r"\s|\\[nr]")
#: What must be in a text for the costlier patterns to match at all.
ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.A | re.I)


def key_value(m: re.Match) -> str:
    """A private key's body without white space; the header where no body follows."""
    return BLANKS.sub("", m[1] or m[2] or "") or m[0]


def find_spans(text: str) -> list[tuple[int, int, str, str]]:
    """All candidates ``(start, kind index, end, value)`` by start, then kind; code points, end exclusive.

    A private key reaches from its BEGIN line to its END line, or to its last line of base64 where
    END is missing; its value is the body, so that two keys under one header are two values.
    """
    found = []
    if ASSIGN_HINT.search(text):
        found += [(m.start(), 0, m.end(), m[2]) for m in BASE["assign"].finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in BASE["access"].finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in BASE["hex"].finditer(text)]
    for k, (kind, hint) in enumerate((("private", "-----BEGIN "), ("jwt", "eyJ"), ("prefixed", "")), 3):
        if hint in text and (hint or any(x in text for x in ("gh", "xox", "sk_live_"))):
            found += [(m.start(), k, m.end(), key_value(m) if kind == "private" else m[0]) for m in MORE[kind].finditer(text)]
    return sorted(found)


def entropy(value: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def value_hash(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end, _ in spans)


def scan(docs: DataFrame, repository: str = "source", owner: str = "lang") -> DataFrame:
    """Candidates of every whole text, one row a document.

    ``row, doc_id, told, n_assign, n_access, n_hex, base_sha256, spans, repository, owner, found``;
    ``row`` numbers the rows read, ``told`` is a hash of the text, ``found`` lists each candidate's
    hash, span and entropy, never its value.
    """

    def make():
        row = itertools.count(TaskContext.get().partitionId() << 33)

        def work(batch):
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "found")}
            for text in texts_of(batch):
                spans = find_spans(text)
                base = [s for s in spans if s[1] < 3]
                counts = Counter(s[1] for s in base)
                for k, kind in enumerate(BASE):
                    out[f"n_{kind}"].append(counts[k])
                out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
                out["spans"].append(listed(spans))
                out["found"].append(
                    [
                        {"hash": value_hash(v), "kind": KINDS[k], "start": a, "end": b, "entropy": entropy(v)}
                        for a, k, b, v in spans
                    ]
                )
            return out | {k: batch.column(k) for k in ("doc_id", "told", "repository", "owner")} | {"row": [next(row) for _ in range(len(batch))]}

        return work

    schema = (
        "row bigint, doc_id bigint, told bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, repository string, "
        "owner string, found array<struct<hash:string,kind:string,start:int,end:int,entropy:double>>"
    )
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.xxhash64("text").alias("told"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
    )
    return map_batches(rows, make, schema)


def ownership(found: DataFrame) -> DataFrame:
    """``hash, n_repositories, n_owners, n_uses`` of every candidate over the whole corpus.

    Uses are first counted per (hash, repository, owner), so a value that a third of all rows
    hold shrinks to one row per task and place before it is shuffled.
    """
    places = found.groupBy("hash", "repository", "owner").agg(F.count("*").alias("uses"))
    return places.groupBy("hash").agg(
        F.countDistinct("repository").alias("n_repositories"),
        F.countDistinct("owner").alias("n_owners"),
        F.sum("uses").alias("n_uses"),
    )


def classify(most_repositories: int, most_owners: int, least_entropy: float) -> F.Column:
    """A candidate's class from how widely its value is copied and how random it looks."""
    wide = (F.col("n_repositories") > most_repositories) | (F.col("n_owners") > most_owners)
    return F.when(wide, "example").when(F.col("entropy") < least_entropy, "weak").otherwise("live")


def judged_candidates(rows: DataFrame, most_repositories: int, most_owners: int, least_entropy: float) -> DataFrame:
    """Every candidate of :func:`scan` with its ownership and ``class``.

    The uses of a widely copied value are dealt to many tasks.
    """
    flat = rows.where(F.size("found") > 0).select("row", "doc_id", "told", "repository", "owner", F.explode("found").alias("f"))
    flat = flat.select("row", "doc_id", "told", "repository", "owner", "f.*")
    owned = materialise(ownership(flat))
    return spread_join(flat, owned, "hash", heavy_counted(owned, "hash", "n_uses")).withColumn("class", classify(most_repositories, most_owners, least_entropy))


def scan_secrets(
    docs: DataFrame,
    repository: str = "source",
    owner: str = "lang",
    most_repositories: int = 2,
    most_owners: int = 1,
    least_entropy: float = 2.5,
) -> DataFrame:
    """Secrets of every whole text with their ownership over the corpus.

    A candidate value in more than ``most_repositories`` repositories or ``most_owners`` owners
    is a widely copied ``example``; an owner-specific one is ``live`` if its entropy reaches
    ``least_entropy`` bits a character, else ``weak``.

    One row a document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live,
    n_example, n_weak, live_spans``. Null and empty texts, and texts without candidates, have
    no spans. Repeated rows and null ids each keep a row; null repositories or owners count as
    one unnamed place. An empty table gives no rows. Other columns are not read.
    """
    with scratch() as keep:
        return keep(_scan_secrets(docs, repository, owner, most_repositories, most_owners, least_entropy))


def _scan_secrets(docs: DataFrame, repository: str, owner: str, most_repositories: int, most_owners: int, least_entropy: float) -> DataFrame:
    rows = materialise(scan(docs, repository, owner))
    judged = judged_candidates(rows, most_repositories, most_owners, least_entropy)
    one = lambda name: F.count_if(F.col("class") == name)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", order.alias("k"), F.concat_ws(":", "kind", "start", "end").alias("told"))
    live = F.sort_array(F.collect_list(F.when(F.col("class") == "live", span)))
    per_row = judged.groupBy("row").agg(
        one("live").alias("n_live"),
        one("example").alias("n_example"),
        one("weak").alias("n_weak"),
        F.array_join(live["told"], ",").alias("live_spans"),
    )
    number = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return rows.drop("found").join(per_row, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans",
        number("n_live"), number("n_example"), number("n_weak"), F.coalesce("live_spans", F.lit("")).alias("live_spans"),
    )


def redact(
    docs: DataFrame,
    mark: str = "[secret]",
    repository: str = "source",
    owner: str = "lang",
    most_repositories: int = 2,
    most_owners: int = 1,
    least_entropy: float = 2.5,
) -> DataFrame:
    """``docs`` with live-looking credentials replaced by ``mark``; all rows and columns stay.

    Widely copied examples and weak candidates stay as they are. Null texts stay null. Rows
    with a null or repeated id are told apart by their texts. An empty table gives no rows.
    """
    key, told, found = unused(docs, "_id"), unused(docs, "_told"), unused(docs, "_hashes")
    with scratch() as keep:
        rows = materialise(scan(docs, repository, owner).where(F.size("found") > 0))
        judged = judged_candidates(rows, most_repositories, most_owners, least_entropy).where(F.col("class") == "live")
        hashes = judged.groupBy(F.col("doc_id").alias(key), F.col("told").alias(told)).agg(F.collect_set("hash").alias(found))
        hashes = keep(hashes)
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(told))
    joined = docs.join(hashes, same, "left")
    redacted = F.when(F.col(found).isNull(), F.col("text")).otherwise(F.pandas_udf(_blank_all, "string")(F.col("text"), F.col(found), F.lit(mark)))
    return joined.select(*(redacted.alias("text") if c == "text" else F.col(c) for c in docs.columns))


def blank(text: str, hashes: set[str], mark: str) -> str:
    """The text with the candidates of these hashes replaced; spans that overlap become one mark."""
    out, at = [], 0
    for start, _, end, value in find_spans(text):
        if value_hash(value) in hashes and end > at:
            if start >= at:
                out += [text[at:start], mark]
            at = end
    return "".join([*out, text[at:]])


def _blank_all(text: pd.Series, hashes: pd.Series, mark: pd.Series) -> pd.Series:
    return pd.Series([blank(t, set(h), m) if t and h is not None else t for t, h, m in zip(text, hashes, mark)], dtype=object)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


#: A match's start is the length of all before it: the pieces that the pattern parts and the matches between them.
OP7_SQL = r"""
WITH kinds(kind, k, pattern, part, least) AS (VALUES
  ('assign', 0, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 16), ('hex', 2, '[0-9a-f]+', 0, 32),
  ('private', 3, '-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----', 0, 0),
  ('jwt', 4, 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0, 0),
  ('prefixed', 5, '(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})', 0, 0)
), docs AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS repository, coalesce(lang, '') AS owner FROM documents
), lists AS (
  SELECT doc_id, repository, owner, kind, k, least, string_split_regex(t, pattern) AS ps, regexp_extract_all(t, pattern, 0) AS ms,
    CASE WHEN part = 2 THEN regexp_extract_all(t, pattern, 2) ELSE regexp_extract_all(t, pattern, 0) END AS vs
  FROM docs, kinds
), matches AS (
  SELECT doc_id, repository, owner, kind, k, least, unnest(range(1, len(ms) + 1)) AS i, unnest(ps[1:len(ms)]) AS p, unnest(ms) AS m, unnest(vs) AS v
  FROM lists WHERE len(ms) > 0
), placed AS (
  SELECT *, CAST(sum(length(p) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM matches
), spans AS (
  SELECT doc_id, repository, owner, kind, k, v, stop - length(m) AS start, kind || ':' || (stop - length(m)) || ':' || stop AS told
  FROM placed WHERE length(v) >= least
), held AS (
  SELECT v, count(DISTINCT repository) AS repositories, count(DISTINCT owner) AS owners FROM spans GROUP BY v
), spread AS (
  SELECT v, -sum(n / length(v) * log2(n / length(v))) AS entropy
  FROM (SELECT v, ch, count(*) AS n FROM (SELECT v, unnest(string_split(v, '')) AS ch FROM held) GROUP BY v, ch) GROUP BY v
), judged AS (
  SELECT s.*, CASE WHEN repositories > 2 OR owners > 1 THEN 'example' WHEN entropy < 2.5 THEN 'weak' ELSE 'live' END AS class
  FROM spans s JOIN held USING (v) JOIN spread USING (v)
), found AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(told, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(told, ',' ORDER BY start, k) AS spans,
    count(*) FILTER (class = 'live') AS n_live, count(*) FILTER (class = 'example') AS n_example, count(*) FILTER (class = 'weak') AS n_weak,
    string_agg(told, ',' ORDER BY start, k) FILTER (class = 'live') AS live_spans
  FROM judged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(n_weak, 0) AS n_weak, coalesce(live_spans, '') AS live_spans
FROM docs LEFT JOIN found USING (doc_id)
"""
