"""Registered queries of HTML sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.html import listing_blocks_from_html
from .queries import query, table
from .segments import _choice, _values

_FIELDS = ("block_no", "kind", "listing_text", "seller", "seller_phone", "posted_date", "image_url", "source_url")
#: (page, its blocks) with NAME for a part's name.
MARKUP = [
    ('<div class="wrap"><div data-listing="1"><div><div data-field="listing-text">NAME <b>blau</b><div>inner</div></div></div><span data-field="seller">Tom &amp; Co</span>'
     '<i data-field="phone" content="+852 9123 4567">x</i><time>2026</time><img src="/i.jpg"><a name=q>no</a><a href=\'/l/1\'>go</a></div><div data-listing><p>NAME zwei</div></div>',
     [("[data-listing]", "NAME blau inner", "Tom & Co", "85291234567", "2026", "/i.jpg", "/l/1"), ("[data-listing]", "NAME zwei", None, None, None, None, None)]),
    ("<article>NAME a<ARTICLE>NAME b</ARTICLE>c</article>", [("article", "NAME a NAME b c", None, None, None, None, None), ("article", "NAME b", None, None, None, None, None)]),
    ('<ul><li class="big listing"><div class="product-description"><a class="title-link" href="https://wa.me/4915112345678">NAME titel</a></div><p class="text">other</p>'
     '<div class="product-rate-removed"><em class="blur-premium">Händler</em></div><div id="countDownText77"><span class="text-dark">May 8, 2026</span></div><img data-src=" /lazy.png "></li></ul>',
     [("listing", "NAME titel", "Händler", "4915112345678", "May 8, 2026", "/lazy.png", "https://wa.me/4915112345678")]),
    ('<div class="listing-card"><h1 class=title>NAME</h1><em class="blur-premium">out</em><span data-field="seller"> </span><span class="seller">S</span></div><div class="listing-card"> </div>',
     [("listing-card", "NAME", None, None, None, None, None)]),
    ('<p>x<section class="watch-listing">NAME offen <p>und weiter', [("watch-listing", "NAME offen und weiter", None, None, None, None, None)]),
    ("<!-- <div data-listing>no</div> --><script>var a=\"<article>\";</script><div class='product'>NAME<br/>gut<img alt=\"a > b\" src=\"/x.gif\"></div>",
     [("product", "NAME gut", None, None, None, "/x.gif", None)]),
    ("<div>NAME</div>", []),
]
_ROWS = [(k, i, *b) for k, (_, blocks) in enumerate(MARKUP) for i, b in enumerate(blocks)]


@query(r"""WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article.*?</article>') AS block FROM pages WHERE html LIKE '%<article%')
SELECT page_id, CAST(0 AS INT) AS block_no, 'article' AS kind, replace(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(block, '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') AS listing_text,
nullif(regexp_extract(block, '<a [^>]*href="([^"]*)"', 1), '') AS source_url FROM a""")
def s3_listing_blocks(s, d):
    return listing_blocks_from_html(table(s, d, "pages")).select("page_id", "block_no", "kind", "listing_text", "source_url")


@query(f"""WITH w(k, {", ".join(_FIELDS)}) AS {_values(_ROWS)}
SELECT p_partkey AS page_id, CAST(block_no AS INT) AS block_no, kind, replace(listing_text, 'NAME', p_name) AS listing_text, seller, seller_phone, posted_date, image_url, source_url
FROM part JOIN w ON p_partkey % {len(MARKUP)} = k""")
def s3_block_fields(s, d):
    """Nested, unclosed and marked-up blocks of every kind with all their fields, around every part's name."""
    html = F.replace(_choice([x[0] for x in MARKUP], "p_partkey"), F.lit("NAME"), F.col("p_name"))
    pages = table(s, d, "part").select(F.col("p_partkey").alias("page_id"), F.lit(None).cast("string").alias("url"), html.alias("html"))
    return listing_blocks_from_html(pages).drop("url")
