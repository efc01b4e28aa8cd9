"""The few functions without a built-in: Arrow-batched, applied after built-in filters."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from difflib import SequenceMatcher
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wordlists as W
from .text import c, clean


def _vector(fn, kind: str = "string", once: bool = False):
    """A column function from a row function of strings; nulls come in as empty strings. Equal inputs in a batch are told once."""

    def told(*columns: pd.Series) -> pd.Series:
        known: dict[tuple, object] = {}
        out = []
        for row in zip(*columns):
            if row not in known:
                known[row] = fn(*(x or "" for x in row))
            out.append(known[row])
        return pd.Series(out, dtype=object if kind == "string" else None)

    def apply(*columns) -> Column:
        def one(a: pd.Series) -> pd.Series:
            return told(a)

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return told(a, b)

        def many(a: pd.Series, b: pd.Series, d: pd.Series, e: pd.Series) -> pd.Series:
            return told(a, b, d, e)

        made = F.pandas_udf({1: one, 2: two, 4: many}[len(columns)], kind)
        return (made.asNondeterministic() if once else made)(*map(c, columns))

    return apply


def ratio(a: str, b: str) -> float:
    """Ratcliff/Obershelp similarity; not symmetric, as the matcher isn't."""
    return SequenceMatcher(None, a, b).ratio()


_similar = _vector(ratio, "double", once=True)


def similarity(a: Column | str, b: Column | str) -> Column:
    """Told once: without the mark the optimiser copies it into a filter on the result, below the column itself."""
    return _similar(clean(a), clean(b))


def similarities(queries: list[str], text: Column) -> Column:
    """The similarity of each of some cleaned queries to a cleaned text, in their order; a text is read once for all of them."""

    def all_of(texts: pd.Series) -> pd.Series:
        known: dict[str, list[float]] = {}
        matcher = SequenceMatcher(None)
        for t in texts.fillna("").unique():
            matcher.set_seq2(t)
            known[t] = []
            for q in queries:
                matcher.set_seq1(q)
                known[t].append(matcher.ratio())
        return texts.fillna("").map(known)

    return F.pandas_udf(all_of, "array<double>").asNondeterministic()(text)


def ratio_bound(a: Column, b: Column) -> Column:
    """No pair is more similar than its lengths allow: a filter to apply before :func:`similarity`."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2 * F.least(F.length(a), F.length(b)) / total)


absolute = _vector(lambda base, link: urljoin(base, link.strip()) if link.strip() else "")


_SLUG_WORDS = re.compile("|".join(sorted(W.SLUG_WORDS, key=len, reverse=True)))


def _dashed(x: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", x).strip("-")


def slug_text(title: str) -> str:
    """ASCII slug: template braces go, & becomes a word, Hindi terms become English ones, accents are folded."""
    s = re.sub(r"\{\{.*?\}\}", "", title).strip().lower().replace("&", " and ")
    s = _SLUG_WORDS.sub(lambda m: W.SLUG_WORDS[m[0]], s)
    return _dashed(unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())


def slug_of(title: str, job_id: str, category: str = "", year: str = "") -> str:
    """Slug of at most 150 characters that ends with the id's last ten, or a hash where the title is not ASCII.

    Without Latin letters or digits it is made of category, year and id, or a hash in place of the id.
    """
    title = title.strip() or "update"
    base, tail = slug_text(title)[:130].rstrip("-"), re.sub(r"[^a-z0-9]", "", job_id.lower())[-10:]
    if base:
        mark = tail or ("" if title.isascii() else hashlib.sha1(title.encode()).hexdigest()[:8])
        return (f"{base}-{mark}" if mark else base)[:150].rstrip("-")
    told = re.findall(r"20\d{2}", f"{title} {year}")
    mark = tail or hashlib.sha1(f"{title}|{job_id.strip()}".encode()).hexdigest()[:10]
    return f"{_dashed(category.strip().lower()) or 'update'}-{told[-1] if told else '2026'}-{mark}"[:150].rstrip("-")


slug = _vector(slug_of)


_DEVANAGARI = re.compile(r"[\u0900-\u097F]")


def _devanagari(token: str) -> str:
    return re.sub(r"[^\u0900-\u097F]", "", token)


def _belongs(left: str, right: str) -> bool:
    """Whether two tokens are parts of one Devanagari word: by a known beginning or ending, or both being very short."""
    a, b = _devanagari(left), _devanagari(right)
    if not a or not b or len(a) > 8 or len(b) > 10 or left[0].isdigit() or a in W.HINDI_WORDS or b in W.HINDI_WORDS:
        return False
    return (a in W.HINDI_BEGINNINGS and len(a) <= 5) or b in W.HINDI_ENDINGS or (len(b) <= 2 and len(a) <= 4)


def join_glyphs(line: str) -> str:
    """Devanagari words that text extraction has set apart, joined from the left; whole words stay apart. A line without Devanagari has none."""
    if not _DEVANAGARI.search(line):
        return " ".join(line.split())
    out: list[str] = []
    for token in line.split():
        if out and _belongs(out[-1], token):
            out[-1] += token
        else:
            out.append(token)
    return " ".join(out)


glyphs = _vector(join_glyphs)


def json_object_of(raw: str) -> str | None:
    """The first balanced JSON object of a text, fences and trailing commas forgiven; null if there is none."""
    start = raw.find("{")
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(raw)) if start >= 0 else ():
        ch = raw[i]
        if quoted:
            escaped, quoted = (not escaped and ch == "\\"), escaped or ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "{}":
            depth += 1 if ch == "{" else -1
            if not depth:
                try:
                    found = json.loads(re.sub(r",\s*([}\]])", r"\1", raw[start : i + 1]))
                except ValueError:
                    return None
                return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) else None
    return None


json_object = _vector(json_object_of)
nfkc = _vector(lambda s: unicodedata.normalize("NFKC", s))
