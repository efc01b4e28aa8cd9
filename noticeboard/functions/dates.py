"""Date readers. Each gives null for text it cannot read; today is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c, clean, squeeze, text

# Month names.
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
HINDI_MONTHS = ("जनवरी", "फरवरी", "मार्च", "अप्रैल", "मई", "जून", "जुलाई", "अगस्त", "सितंबर", "अक्टूबर", "नवंबर", "दिसंबर")


def make(y: Column, m: Column, d: Column) -> Column:
    """The date of numeric strings, or null."""
    return F.to_date(F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("y-M-d")))


def month_number(name: Column) -> Column:
    """1 to 12 from an English month name or its first letters."""
    short = F.substring(F.lower(name), 1, 3)
    return F.array_position(F.array(*map(F.lit, "jan feb mar apr may jun jul aug sep oct nov dec".split())), short).cast("string")


def _parts(x: Column, pattern: str, order: tuple[int, int, int], named: bool = False) -> Column:
    """The date of the first match: what was found is cut at its signs once, as the value of a lambda."""

    def read(bits: Column) -> Column:
        y, m, d = (F.get(bits, F.lit(i - 1)) for i in order)
        return make(y, month_number(m) if named else m, d)

    found = F.split(F.regexp_extract(x, pattern, 0), r"[^\p{L}\p{N}]+")
    return F.when(x.rlike(pattern), F.get(F.transform(F.array(found), read), F.lit(0)))


def anchored(x: Column | str) -> Column:
    """DD-MM-20YY or DD/MM/20YY as the whole text, or a leading 20YY-MM-DD."""
    t = F.trim(text(x))
    return F.coalesce(
        _parts(t, r"^(\d{2})-(\d{2})-(20\d{2})$", (3, 2, 1)),
        _parts(t, r"^(\d{2})/(\d{2})/(20\d{2})$", (3, 2, 1)),
        _parts(t, r"^(20\d{2})-(\d{2})-(\d{2})", (1, 2, 3)),
    )


def strict(x: Column | str) -> Column:
    """Six whole-text formats, then a day, month name and year anywhere."""
    t = F.lower(F.trim(text(x)))
    return F.coalesce(
        _parts(t, r"^(\d{1,2})-(\d{1,2})-(\d{4})$", (3, 2, 1)),
        _parts(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", (3, 2, 1)),
        _parts(t, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", (3, 2, 1)),
        _parts(t, r"^(\d{4})-(\d{1,2})-(\d{1,2})$", (1, 2, 3)),
        _parts(t, rf"(\d{{1,2}})\s+({MONTHS})[a-z]*\s+(\d{{4}})", (3, 2, 1), named=True),
    )


def last_day(x: Column | str) -> Column:
    """Whole-text day-first dates with two- or four-digit years, ISO or a named month; any separator."""
    t = F.regexp_replace(F.lower(squeeze(x)), "[/.]", "-")
    two = r"^(\d{1,2})-(\d{1,2})-(\d{2})$"
    century = F.when(F.regexp_extract(t, two, 3).try_cast("int") < 69, "20").otherwise("19")
    return F.coalesce(
        _parts(t, r"^(\d{1,2})-(\d{1,2})-(\d{4})$", (3, 2, 1)),
        F.when(t.rlike(two), make(F.concat(century, F.regexp_extract(t, two, 3)), F.regexp_extract(t, two, 2), F.regexp_extract(t, two, 1))),
        _parts(t, r"^(\d{4})-(\d{1,2})-(\d{1,2})$", (1, 2, 3)),
        _parts(t, rf"^(\d{{1,2}}) ({MONTHS}) (\d{{4}})$", (3, 2, 1), named=True),
    )


def anywhere(x: Column | str) -> Column:
    """First of: year-first, day-first, named month; a form found but impossible gives way to the next."""
    t = F.lower(squeeze(x))
    return F.coalesce(
        _parts(t, r"(?<!\w)(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?!\w)", (1, 2, 3)),
        _parts(t, r"(?<!\w)(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?!\w)", (3, 2, 1)),
        _parts(t, rf"(?<!\w)(\d{{1,2}})\s+({MONTHS})\s+(\d{{4}})(?!\w)", (3, 2, 1), named=True),
        _parts(t, rf"(?<!\w)({MONTHS})\s+(\d{{1,2}}),?\s+(\d{{4}})(?!\w)", (3, 1, 2), named=True),
    )


def adapter(x: Column | str) -> Column:
    """Day-first forms with two- or four-digit years, named months in English or Hindi, ordinals; no ISO."""
    t = F.regexp_replace(F.regexp_replace(clean(x), "[–—]", "-"), r"(?<!\w)(\d{1,2})(st|nd|rd|th)(?!\w)", "$1")
    hindi = t
    for i, name in enumerate(HINDI_MONTHS, 1):
        hindi = F.replace(hindi, F.lit(name), F.lit(f"{i:02d}"))
    short = lambda sep: F.when(
        t.rlike(rf"^\d{{1,2}}{sep}\d{{1,2}}{sep}\d{{2}}$"),
        make(F.concat(F.lit("20"), F.regexp_extract(t, r"(\d{2})$", 1)), F.regexp_extract(t, rf"{sep}(\d+){sep}", 1), F.regexp_extract(t, r"^(\d+)", 1)),
    )
    plain = F.replace(t, F.lit(","), F.lit(""))
    return F.coalesce(
        _parts(hindi, r"^(\d{1,2})\s+(\d{2})\s+(\d{4})$", (3, 2, 1)),
        _parts(t, r"^(\d{1,2})-(\d{1,2})-(\d{4})$", (3, 2, 1)),
        _parts(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", (3, 2, 1)),
        _parts(t, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", (3, 2, 1)),
        short("-"),
        short("/"),
        _parts(plain, rf"^(\d{{1,2}}) ({MONTHS}) (\d{{4}})$", (3, 2, 1), named=True),
        _parts(plain, rf"^({MONTHS}) (\d{{1,2}}) (\d{{4}})$", (3, 1, 2), named=True),
    )


def display(x: Column | str, pattern: str = "dd-MM-yyyy") -> Column:
    """A readable date as DD-MM-YYYY, anything else empty; day and month change places if the month can't be one."""
    t = F.trim(text(x))
    swapped = _parts(t, r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$", (3, 1, 2))
    return F.coalesce(F.date_format(F.coalesce(anywhere(t), swapped), pattern), F.lit(""))


def year(x: Column | str) -> Column:
    return F.regexp_extract(text(x), r"(20\d{2})", 1)


def years(x: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(text(x), F.lit(r"(?<!\w)(20\d{2})(?!\w)"), 1), lambda y: y.cast("int"))


#: Columns that may hold a deadline, in order of trial.
DEADLINES = ("last_date", "deadline", "application_last_date", "last_date_to_apply", "closing_date", "application_deadline")


def deadline(columns: list[str], read=anchored) -> Column:
    """The first readable of the deadline columns that the table has."""
    found = [read(k) for k in DEADLINES if k in columns]
    return F.coalesce(*found) if found else F.lit(None).cast("date")


def labelled_deadline(x: Column | str) -> Column:
    """A day-first date right behind an explicit deadline label."""
    # fixed values: deadline labels
    label = r"(?:last\s*date|last\s*date\s*to\s*apply|application\s*(?:last\s*)?date|deadline|closing\s*date|apply\s*(?:online\s*)?(?:till|by|before)|अंतिम\s*तिथि|अंतिम\s*तारीख)"
    return anywhere(F.regexp_extract(F.lower(text(x)), label + r"\s*[:\-]?\s*(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})", 1))


#: Where a record tells its publication, in order of trial, and the labels of an advertisement's date.
PUBLISHED = ("notification_date", "publish_date", "published_date", "date_published", "source_date")
ADVERTISED = r"(?i)(?:dated|date\s*of\s*advertisement|advertisement\s*dated|notification\s*dated|दिनांकित|विज्ञापन\s*दिनांक|अधिसूचना\s*दिनांक|दिनांक)\s*[:\-–]?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"
LAST_LABELS = (
    r"(?i)(?:last\s*date(?:\s*to\s*apply)?|application\s+(?:last\s*)?date|closing\s*date|deadline|registration\s+(?:last\s*)?date"
    r"|आवेदन\s*की\s*अंतिम\s*तिथि|अंतिम\s*तिथि|अंतिम\s*तारीख)\s*[:\-–]?\s*([^\n|;]{1,80})"
)
WRITTEN = rf"(?i)\b(?:0?[1-9]|[12]\d|3[01])(?:[-/. ](?:0?[1-9]|1[0-2])[-/. ]20\d{{2}}|\s+(?:{MONTHS})\s+20\d{{2}})\b"


def _spelled(x: Column) -> Column:
    """YYYY-MM-DD of a year-first text, whose separators may be missing, or of a day-first one; null without either."""
    first, second = r"(\d{4})[-/]?(\d{1,2})[-/]?(\d{1,2})", r"(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})"
    whole = lambda p, i: F.regexp_extract(x, p, i).cast("int")
    short = F.when(whole(second, 3) < 100, whole(second, 3) + 2000).otherwise(whole(second, 3))
    told = lambda y, m, d: F.format_string("%04d-%02d-%02d", y, m, d)
    return F.when(x.rlike(first), told(whole(first, 1), whole(first, 2), whole(first, 3))).when(x.rlike(second), told(short, whole(second, 2), whole(second, 1)))


def published_day(columns: list[str], default: str = "उपलब्ध नहीं") -> Column:
    """Publication day as YYYY-MM-DD: the first date column that holds one, else a labelled date of the texts; never today."""
    found = [_spelled(F.trim(text(k))) for k in PUBLISHED if k in columns]
    texts = F.concat_ws(" ", *(text(k) for k in ("title", "description", "content") if k in columns))
    return F.coalesce(*found, _spelled(F.regexp_extract(texts, ADVERTISED, 1)), F.lit(default))


def first_date(x: Column | str) -> Column:
    """As written: the date behind the first deadline label, else the first date of the text, else empty."""
    behind = F.regexp_extract(F.regexp_extract(text(x), LAST_LABELS, 1), WRITTEN, 0)
    return F.coalesce(F.nullif(behind, F.lit("")), F.regexp_extract(text(x), WRITTEN, 0))


def shown_day(columns: list[str]) -> Column:
    """"05 Jan 2026" of the first readable publication column, else of the day seen, else empty."""
    names = ("publish_date", "notification_date", "published_date", "date_published", "posted_date", "date", "scraped_at")
    found = [anywhere(k) for k in names if k in columns]
    return F.coalesce(F.date_format(F.coalesce(*found, F.lit(None).cast("date")), "dd MMM yyyy"), F.lit(""))


def archive_day(x: Column | str) -> Column:
    """A year-first date as DD-MM-YYYY; anything else as it is."""
    pattern = r"(20\d{2})[-/.](\d{1,2})[-/.](\d{1,2})"
    whole = lambda i: F.regexp_extract(text(x), pattern, i).cast("int")
    return F.when(text(x).rlike(pattern), F.format_string("%02d-%02d-%04d", whole(3), whole(2), whole(1))).otherwise(text(x))


def newest_year(x: Column | str) -> Column:
    return F.array_max(years(x))


def last_year(x: Column | str) -> Column:
    """The year that stands last, or null."""
    return F.try_element_at(years(x), F.lit(-1))


def is_expired(last: Column, as_of: Column | str) -> Column:
    """Before the day ``as_of``; no readable date is not expired."""
    day = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    return F.coalesce(last < day, F.lit(False))


def is_fresh(last: Column, in_title: Column, seen: Column, published: Column, as_of: str) -> Column:
    """Deadline, else year, else seen within 90 days, else published within 120; else stale."""
    day = F.to_date(F.lit(as_of))
    newest = F.array_max(years(in_title))
    return (
        F.when(last.isNotNull(), last >= day)
        .when(newest < F.year(day), F.lit(False))
        .when(newest == F.year(day), F.lit(True))
        .when(seen.isNotNull(), seen >= F.date_sub(day, 90))
        .when(published.isNotNull(), published >= F.date_sub(day, 120))
        .otherwise(F.lit(False))
    )
