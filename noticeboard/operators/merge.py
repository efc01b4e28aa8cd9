"""Incremental batches: upsert merge, change detection and anti-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import placeholder, text
from ..functions.wordlists import DETAIL_FIELDS, IDENTITY_FIELDS, PLACEHOLDERS, SOURCE_DATES
from . import dedupe, keys


def real(x: Column) -> Column:
    return ~placeholder(x, PLACEHOLDERS)


def merged_value(old: Column, new: Column) -> Column:
    """New if real, else old if real, else what is new."""
    return F.when(real(new), new).when(real(old), old).otherwise(F.coalesce(new, old))


def changed(old: str, new: str, fields: Sequence[str]) -> Column:
    """Whether one of the fields differs between two aliased sides; null and empty are the same."""
    out = F.lit(False)
    for k in fields:
        out = out | (text(F.col(f"{old}.{k}")) != text(F.col(f"{new}.{k}")))
    return out


def one_per_key(df: DataFrame, key: str, last: bool = False, valid: bool = False) -> DataFrame:
    """One row of each key that is given: the first by ``ord``, or the last; without ``ord`` by the values of the row.

    With ``valid`` only rows that are not marked invalid. It is an aggregate on the key that a join on it reuses.
    """
    rows = df.where(text(key) != "")
    if valid and "is_valid_post" in df.columns:
        rows = rows.where(F.coalesce(F.col("is_valid_post"), F.lit(True)))
    row = F.struct(*df.columns)
    pick = F.max_by if last else F.min_by
    return rows.groupBy(F.col(key).alias("_key")).agg(pick(row, F.struct("ord") if "ord" in df.columns else row).alias("_row")).select("_row.*")


def upsert(old: DataFrame, new: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """Merge a batch into the live table: one full outer join on the key.

    Identity fields come from the batch where it has them, detail fields by :func:`merged_value`. The
    publication date is the batch's own source date, else the old one, else the batch's. Other
    fields stay. The merged row replaces the old one only if a compared field differs, so a change
    of other fields alone is left out. ``change`` is added, updated or kept. Each side is first
    reduced to one row a key: the last of the live table, the first of the batch; rows without a key
    go, and those of the batch that are marked invalid. Both sides have the same columns.
    """
    o, n = one_per_key(old, key, last=True).alias("o"), one_per_key(new, key, valid=True).alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    dated = [F.nullif(text(F.col(f"n.{k}")), F.lit("")) for k in (*SOURCE_DATES, "date") if k in new.columns]

    def combined(k: str) -> Column:
        a, b = F.col(f"o.{k}"), F.col(f"n.{k}")
        if k in DETAIL_FIELDS:
            value = merged_value(a, b)
            if k in ("apply_link", "notification_pdf"):
                value = F.when(F.lower(value).startswith("javascript:"), "").otherwise(value)
            return value
        if k == "publish_date":
            return F.coalesce(*dated, F.nullif(text(a), F.lit("")), b)
        return F.coalesce(b, a) if k in IDENTITY_FIELDS else a

    differs = F.lit(False)
    for k in compared:
        differs = differs | (text(F.col(f"o.{k}")) != text(combined(k)))
    added, absent = F.col(f"o.{key}").isNull(), F.col(f"n.{key}").isNull()
    # told once a row in a projection of its own, as all columns read it
    both = both.withColumn("_change", F.when(added, "added").when(absent | ~differs, "kept").otherwise("updated"))
    state = F.col("_change")
    pick = lambda k: F.when(state == "added", F.col(f"n.{k}")).when(state == "kept", F.col(f"o.{k}")).otherwise(combined(k))
    return both.select(*(pick(k).alias(k) for k in old.columns), state.alias("change"))


def new_or_changed(old: DataFrame, new: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """Rows of the batch that are absent from the live table or differ from it in a compared field."""
    o, n = old.alias("o"), new.alias("n")
    joined = n.join(o, F.col(f"o.{key}") == F.col(f"n.{key}"), "left")
    return joined.where(F.col(f"o.{key}").isNull() | changed("o", "n", compared)).select("n.*")


def new_only(batch: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key no known row has; of the batch's own repeats the first by ``ord``, or without that column the least row."""
    rows = batch.join(known.select(key).distinct(), key, "left_anti").select(batch.columns)
    if "ord" in batch.columns:
        return dedupe.first_per_key(rows, key)
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*rows.columns)).alias("_row")).select("_row.*")


def union_known(live: DataFrame, archive: DataFrame) -> DataFrame:
    """Live and archive as one known set: of rows with one id, address or title the live one stays, else the first by ``ord``."""
    both = live.withColumn("_side", F.lit(0)).unionByName(archive.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rows = both.withColumn("_ord", F.struct("_side", "ord")).withColumn("_key", keys.publisher(live.columns)).where("_key <> ''")
    return dedupe.first_per_key(rows, "_key", ord="_ord").select(live.columns)


def changed_outputs(pages: DataFrame, stored: DataFrame, page: str = "page", html: str = "html") -> DataFrame:
    """Rendered pages that differ from what is stored, by digest: ``pages(page, html)``, ``stored(page, digest)``."""
    made = pages.withColumn("digest", F.sha2(text(html), 256))
    return made.join(stored.select(page, "digest"), [page, "digest"], "left_anti").select(*pages.columns, "digest")


def existing(rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Rows whose key some file has."""
    return rows.join(files.select(key), key, "left_semi").select(rows.columns)


def stale(everything: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """Distinct keys with no active row."""
    return everything.select(key).distinct().join(active.select(key), key, "left_anti")
