"""Status, archive split and candidate choice of notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, dates
from ..functions import wordlists as W
from ..functions.text import has_any, strip, text
from . import dedupe, keys


def with_status(df: DataFrame, as_of: str) -> DataFrame:
    """``status`` and ``is_expired`` from the first readable deadline; none means active."""
    gone = dates.is_expired(dates.deadline(df.columns), as_of)
    return df.withColumn("status", F.when(gone, "Application Closed").otherwise("Active")).withColumn("is_expired", gone)


def split(df: DataFrame, expired: Column, publishable: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Live, hidden archive (not publishable) and visible archive (expired): every row in one of them."""
    good, gone = F.coalesce(publishable, F.lit(False)), F.coalesce(expired, F.lit(False))
    return df.where(good & ~gone), df.where(~good), df.where(good & gone)


def strict_active(last: Column, as_of: str) -> Column:
    """Active only with a readable deadline that has not passed."""
    return F.coalesce(last >= F.to_date(F.lit(as_of)), F.lit(False))


def rank_score(title: Column | str, pdf: Column | str, last: Column | str, vacancy: Column | str) -> Column:
    """Four for each phrase, two for a PDF, two for a last date, one for a vacancy number."""
    t = F.lower(text(title))
    out = sum((F.when(t.contains(p), 4).otherwise(0) for p in W.RANK_PHRASES), F.lit(0))
    return out + F.when(text(pdf) != "", 2).otherwise(0) + F.when(text(last) != "", 2).otherwise(0) + F.when(text(vacancy) != "", 1).otherwise(0)


def recent_candidate(title: Column | str, as_of: str) -> Column:
    """A fresh opening: twelve characters, application language, no other kind of notice, no appointment news, no past year."""
    t = F.lower(strip(title))
    newest = F.array_max(dates.years(t))
    news = has_any(t, W.APPOINTMENT_NEWS) & ~has_any(t, W.APPOINTMENT_OPEN)
    return (
        (F.length(t) >= 12) & ~has_any(t, W.CANDIDATE_BLOCKED) & ~news
        & F.coalesce(newest >= F.year(F.to_date(F.lit(as_of))), F.lit(True)) & has_any(t, W.CANDIDATE_TERMS)
    )


def active_recruitment(columns: list[str], as_of: str) -> Column:
    """Strict activity: a recruitment whose last date is readable and has not passed; a missing date is inactive."""
    get = lambda k: text(k) if k in columns else F.lit("")
    return classify.is_recruitment(get("title"), get("category"), get("post_type")) & strict_active(dates.last_day(get("last_date")), as_of)


def new_candidates(fresh: DataFrame, known: DataFrame, as_of: str, cap: int = 120) -> DataFrame:
    """The candidates of a run: fresh openings that no known row names, the first of each key, by rank; ``cap`` at most.

    The key is the first of id, address and title. Known keys are made distinct before the join.
    """
    rows = fresh.where(recent_candidate("title", as_of)).withColumn("_key", keys.publisher(fresh.columns)).where("_key <> ''")
    rows = dedupe.first_per_key(rows, "_key")
    rows = rows.join(known.select(keys.publisher(known.columns).alias("_key")).distinct(), "_key", "left_anti")
    get = lambda k: k if k in fresh.columns else F.lit("")
    ranked = rows.withColumn("rank_score", rank_score("title", get("notification_pdf"), get("last_date"), get("vacancy")))
    return ranked.orderBy(F.desc("rank_score"), "ord").limit(cap).select(*fresh.columns, "rank_score")
