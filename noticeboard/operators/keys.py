"""Identity keys of notices: deliberately different, one for each use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import key_text, simple_slug, strip, text


def job_id(title: Column | str, url: Column | str) -> Column:
    """Hash of normalised title and url; of the merge and its dedupe."""
    return F.md5(F.concat_ws("|", key_text(title), key_text(url)))


def title_url(title: Column | str, url: Column | str) -> Column:
    return F.struct(F.lower(strip(title)).alias("t"), F.lower(strip(url)).alias("u"))


def publisher(columns: list[str]) -> Column:
    """First non-empty of id, url and title, lower-case."""
    given = [F.nullif(F.lower(strip(k)), F.lit("")) for k in ("job_id", "url", "title") if k in columns]
    return F.coalesce(*given, F.lit(""))


def page_slug(title: Column | str) -> Column:
    return simple_slug(title)


def processed(columns: list[str]) -> Column:
    """Hash of all identifying fields, of the processed set."""
    return F.sha2(F.concat_ws("|", *(F.lower(text(k)) if k in columns else F.lit("") for k in ("url", "source_url", "link", "title", "job_id"))), 256)
