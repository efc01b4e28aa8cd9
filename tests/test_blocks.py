"""Elements against a plain stack, contexts and cards by hand, the bounded crawl against a plain queue."""

import random
from collections import deque
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from noticeboard.operators import blocks


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.stack, self.tree = [], []

    def handle_starttag(self, tag, attrs):
        self.tree.append((tag, tuple(t for t in self.stack)))
        if tag not in blocks.VOID:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.tree.append((tag, tuple(self.stack)))

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass


@pytest.mark.parametrize("seed", range(6))
def test_nesting_equals_a_parser(seed):
    r = random.Random(seed)
    pieces = ["<div>", "</div>", "<p class='a>b'>", "</p>", "<br>", "<li>", "</li>", "<a href=\"x\">", "</a>", "<img/>", "text", "</b>", "<!-- <div> -->", "<DIV id=1>", "<script>if (a<b) '<div>'</script>"]
    html = "".join(r.choice(pieces) for _ in range(80))
    plain = Plain()
    plain.feed(html)
    found = blocks.intervals(html)
    around = [tuple(e["tag"] for e in found if e["start"] < f["start"] < e["stop"]) for f in found]
    assert [(f["tag"], a) for f, a in zip(found, around)] == plain.tree


def test_contexts_of_links(spark):
    html = "<html><body><a href='/top'>Top</a><div>Out <ul><li>One <a href='a.pdf'>A</a><li>Two <b><a href=\"b\">B</a></b></li></ul> end</div><a>none</a></body></html>"
    rows = blocks.link_contexts(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).orderBy("pos").collect()
    assert [(r.tag, r.href, r.label) for r in rows] == [(None, "/top", "Top"), ("li", "a.pdf", "A"), ("li", "b", "B")]
    assert [r.context for r in rows] == ["", "One A Two B", "Two B"]


def card(no, extra="", long=""):
    return f"<div class=c><h3>Recruitment of officers</h3><p>Apply online from 11.08.2026 to 31.08.2026 {long}</p><div><span>ADVERTISEMENT NO: {no}</span>{extra}<a href='/d/{no.lower().replace('/', '-')}.pdf'>Download Advertisement</a><a href='/apply/{no[-1]}'>Apply Online</a></div></div>"


def test_cards_have_their_own_links(spark):
    english = "<a href='/e.pdf'>Advertisement (English)</a>"
    html = "<html><body><div id=all>" + card("CRPD/A/01") + card("CRPD/B/02", english) + card("CRPD/A/01") + "<p>Advertisement No: ZZZZ/9 without link</p>" + card("CRPD/C/03", long="x" * 4600) + "</div>" + "filler " * 900 + "</body></html>"
    got = blocks.cards(spark.createDataFrame([(1, "https://x.in/careers/", html), (2, "https://x.in/", None)], "page_id long, url string, html string")).orderBy("pos").collect()
    assert [(r.advertisement_no, r.pdf, r.apply) for r in got] == [
        ("CRPD/A/01", "https://x.in/d/crpd-a-01.pdf", "https://x.in/apply/1"), ("CRPD/B/02", "https://x.in/e.pdf", "https://x.in/apply/2"),
    ]
    assert got[0].title.startswith("Recruitment of officers Apply online") and len({r.pos for r in got}) == 2


def plain_crawl(edges, src, depth, pages, tried, least):
    best = {}
    for a, b, s in edges:
        best[a, b] = max(best.get((a, b), s), s)
    links = {}
    for (a, b), s in best.items():
        links.setdefault(a, []).append((-s, -len(b), b))
    queue, seen, visit = deque([(src, 0)]), set(), 0
    while queue and visit < pages:
        at, hops = queue.popleft()
        if at in seen:
            continue
        seen.add(at)
        visit += 1
        ranked = sorted(links.get(at, []))
        for _, _, b in ranked[:tried]:
            if b.lower().split("#")[0].endswith(".pdf"):
                return at, b, hops, visit
        if hops < depth:
            queue.extend((b, hops + 1) for s, _, b in ranked if not b.lower().split("#")[0].endswith(".pdf") and -s >= least)
    return None


@pytest.mark.parametrize("depth, pages, tried", [(3, 8, 8), (2, 4, 4), (3, 5, 2)])
def test_crawl_equals_a_queue(spark, depth, pages, tried):
    r = random.Random(pages)
    nodes = [f"n{i}" for i in range(60)]
    edges = [(r.choice(nodes), r.choice(nodes) if r.random() < 0.9 else f"d{r.randrange(9)}.pdf#x", r.randrange(4, 40)) for _ in range(260)]
    got = blocks.crawl(spark.createDataFrame(edges, "src string, dst string, score int"), spark.createDataFrame([(n,) for n in [*nodes, "alone"]], "src string"), depth, pages, tried)
    want = {n: w for n in [*nodes, "alone"] if (w := plain_crawl(edges, n, depth, pages, tried, 10))}
    assert {g.src: (g.page, g.pdf, g.hops, g.visit) for g in got.collect()} == want and 3 < len(want) < 61
