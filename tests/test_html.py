"""HTML blocks against the standard library's parser on nested markup, and odd pages."""

import random
from html.parser import HTMLParser

from lotwise.sources.html import VOID, listing_blocks_from_html


class Nested(HTMLParser):
    """Texts of article elements in document order, matched by the depth of their own name."""

    def __init__(self):
        super().__init__()
        self.open, self.done = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.done.append([])
            self.open.append(self.done[-1])

    def handle_endtag(self, tag):
        if tag == "article" and self.open:
            self.open.pop()

    def handle_data(self, data):
        for texts in self.open:
            texts.append(data)


def test_nested_blocks_equal_a_parser(spark):
    rng, pages = random.Random(8), []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 40)):
            tag = rng.choice(["article", "ARTICLE", "div", "p", "br", "b"])
            parts.append(rng.choice([f"<{tag} title='a>b'>", f"<{tag}>", "" if tag.lower() in VOID else f"</{tag}>", f" w{rng.randint(0, 99)} ", "&amp;"]))
        pages.append((i, None, "".join(parts)))
    got = {}
    for r in listing_blocks_from_html(spark.createDataFrame(pages, "page_id int, url string, html string")).collect():
        got.setdefault(r.page_id, {})[r.block_no] = r.listing_text
    for i, _, html in pages:
        p = Nested()
        p.feed(html)
        p.close()
        want = [" ".join(" ".join(t).split()) for t in p.done]
        assert got.get(i, {}) == {n: t for n, t in enumerate(want) if t}


def test_odd_pages(spark):
    pages = [(1, "u", None), (1, "u", ""), (None, None, "<article>x</article>"), (None, None, "<article>x</article>"), (2, "u", "<article"), (3, "u", "<article>" * 300 + "deep"), (4, "u", "< article>x</article>")]
    rows = listing_blocks_from_html(spark.createDataFrame([(*p, 7) for p in pages], "page_id int, url string, html string, kind int")).collect()
    assert sorted((str(r.page_id), r.listing_text) for r in rows if r.page_id != 3) == [("None", "x")] * 2
    assert [r.block_no for r in rows if r.page_id == 3] == list(range(300)) and {r.listing_text for r in rows if r.page_id == 3} == {"deep"}
