"""Texts of documents as readers see them: clean lines, no page furniture, no repeats."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import read_line, repaired, single_spaced, squeeze, strip, text
from .udfs import join_glyphs, nfkc

#: Of the characters of a line, the least share of letters and digits, and the most characters of a text.
DENSITY, MOST = 0.35, 9000
#: Lines that a worker holds as Python's at once.
AT_ONCE = 1000
#: The dashes that a search takes for a hyphen.
DASHES = "–—"


@cache
def _glyph_lines():
    def join(texts: pa.Array) -> pa.Array:
        """Lines are Python's for a thousand at a time, whatever the batch: an array of all lines of a batch takes many times its bytes."""
        lines, sizes = texts.flatten(), pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
        done = [pa.array([x if x is None else join_glyphs(x) for x in lines.slice(at, AT_ONCE).to_pylist()], pa.string()) for at in range(0, len(lines), AT_ONCE)]
        starts = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        return pa.ListArray.from_arrays(starts, pa.concat_arrays(done) if done else pa.array([], pa.string()), mask=texts.is_null())

    return F.arrow_udf(join, ArrayType(StringType()))


def without_repeats(lines: Column) -> Column:
    """Of equal neighbours the first; each line is looked at beside the one before it, so time is linear."""
    before = F.concat(F.array(F.lit(None).cast("string")), lines)
    pairs = F.arrays_zip(lines.alias("v"), before.alias("w"))
    return F.transform(F.filter(pairs, lambda p: p["v"].isNotNull() & ~p["v"].eqNullSafe(p["w"])), lambda p: p["v"])


@cache
def _solid_lines():
    def solid(texts: pa.Array) -> pa.Array:
        """Mostly decorative lines are empty."""
        lines = texts.flatten()
        size, good = pc.utf8_length(lines), pc.utf8_length(pc.replace_substring_regex(lines, "[^A-Za-zऀ-෿0-9]+", ""))
        kept = pc.or_(pc.less_equal(size, 2), pc.greater_equal(pc.cast(good, pa.float64()), pc.multiply(pc.cast(size, pa.float64()), DENSITY)))
        sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
        starts = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        return pa.ListArray.from_arrays(starts, pc.if_else(kept, lines, ""), mask=texts.is_null())

    return F.arrow_udf(solid, ArrayType(StringType()))


def document_lines(x: Column | str) -> Column:
    """The clean lines of an extracted text, in order: Devanagari words joined, mostly decorative lines and repeats gone.

    No repair crosses lines, so a whole text is repaired at once; a step's result is told once for each line, as a lambda's expressions are told wherever they stand.
    """
    raw = F.split(repaired(F.regexp_replace(text(x), r"\r\n?", "\n")), "\n")
    pairs = F.transform(F.transform(raw, single_spaced), lambda t: F.struct(t.alias("t"), F.lower(t).alias("low")))
    lines = _solid_lines()(_glyph_lines()(F.transform(pairs, lambda p: read_line(p["t"], p["low"]))))
    return without_repeats(F.filter(lines, lambda v: v != ""))


def document_text(x: Column | str, most: int = MOST) -> Column:
    """The clean lines joined; a text of the page, so it is cut to ``most`` characters. A missing text is empty."""
    return strip(F.left(F.array_join(document_lines(x), "\n"), F.lit(most)))


def search_text(x: Column | str) -> Column:
    """A text as the browser's search compares it: compatibility forms folded, long dashes hyphens, lower case, single spaces."""
    return squeeze(F.translate(nfkc(F.lower(text(x))), DASHES, "-" * len(DASHES)))
