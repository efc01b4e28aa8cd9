"""Arrow functions of texts and pages: what a batch gives, and that few of its rows are Python's at once."""

import tracemalloc

import pyarrow as pa

from noticeboard.functions import reading
from noticeboard.functions.udfs import join_glyphs
from noticeboard.operators import blocks


def peak(fn, batch) -> int:
    tracemalloc.start()
    try:
        fn(batch)
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_glyph_lines():
    join = reading._glyph_lines().func
    rows = [["विज्ञा पन संख्या", None, ""], [], None, ["a  b"] * 2500, ["पद में म"]]
    want = [None if x is None else [v if v is None else join_glyphs(v) for v in x] for x in rows]
    batch = pa.array(rows, pa.list_(pa.string()))
    assert join(batch).to_pylist() == want and join(batch.slice(1, 3)).to_pylist() == want[1:4] and join(batch.slice(0, 0)).to_pylist() == []
    big = pa.array([[f"line {i} {k}" for k in range(50)] for i in range(1000)], pa.list_(pa.string()))
    assert peak(join, big) < 2_000_000  # all 50,000 lines take more than that


def test_elements_of_a_batch():
    told = blocks._intervals().func
    pages = ["<div><p>a<br>b</p></div>" * 40, None, "", "no tags"] * 100
    batch = pa.array(pages, pa.string())
    assert told(batch).to_pylist() == [blocks.intervals(h or "") for h in pages] and told(batch.slice(3, 60)).to_pylist() == [blocks.intervals(h or "") for h in pages[3:63]]
    assert told(batch.slice(0, 0)).to_pylist() == [] and peak(told, batch) < 2_000_000  # 16,000 elements take more than that
