"""Orders of notices, each by name: the largest first, missing values last, ties to the earlier ``ord``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.records import field, first_given
from ..functions.text import strip
from .dedupe import rank_all

#: Columns that may hold a publication day, in order of trial.
PUBLISHED = ("publish_date", "notification_date", "published_date", "date_published", "posted_date", "date")


def values(columns: list[str], order: str, by_date: bool = False) -> list[Column]:
    """What an order compares.

    ``priority``: priority, then title. ``discovery``: day seen, day published, lower-case title.
    ``category``: the publication date as a string, or with ``by_date`` as ``discovery``. ``index``,
    ``legacy`` and ``archive``: a date string, the first given of the order's columns.
    """
    title = field(columns, "title")
    if order == "priority":
        return [F.coalesce(F.col("priority").cast("double"), F.lit(0.0)) if "priority" in columns else F.lit(0.0), title]
    if order == "discovery" or (order == "category" and by_date):
        day = lambda names: F.coalesce(*(dates.anywhere(k) for k in names if k in columns), F.lit(None).cast("date"))
        return [day(("scraped_at",)), day(PUBLISHED), F.lower(strip(title))]
    names = {"category": ("publish_date",), "index": ("publish_date", "date"), "legacy": ("date",), "archive": ("site_published_at", "publish_date", "notification_date")}
    return [first_given(columns, names[order])]


def sort_columns(columns: list[str], order: str, by_date: bool = False) -> list[Column]:
    """Sort columns, for ``orderBy`` and for capped windows."""
    return [F.desc_nulls_last(v) for v in values(columns, order, by_date)] + [F.col("ord").asc()]


def placed(df: DataFrame, order: str, by_date: bool = False) -> DataFrame:
    """``df`` with ``rank``, the place of each row in the named order, from 1; no task sorts all rows."""
    made = {f"_v{i}": v for i, v in enumerate(values(df.columns, order, by_date))}
    signs = [F.desc_nulls_last(k) for k in made] + [F.col("ord").asc()]
    return rank_all(df.withColumns(made), signs).select(*df.columns, "rank")
