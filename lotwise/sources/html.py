"""Listing blocks of HTML pages: elements matched by the running depth of their tags, fields by name, then by class.

A page stays one row. Its tags and the texts between them are two arrays; an element ends where the depth of its own tag
name, counted from its opening tag, falls below zero, so elements of one name nest. Only elements that a selector asks
for are followed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SKIP = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>"
TAG = r"""(?s)<[a-zA-Z/](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]

# What marks a listing, its fields and the elements they fall back to ((around, class) or one class).
BLOCKS = ["[data-listing]", "article", "listing", "listing-card", "watch-listing", "product"]
TEXT_CLASSES = [("product-description", "title-link"), "listing-text", "text", "title"]
SELLER_CLASSES = [("product-rate-removed", "blur-premium"), "seller", "seller-name"]
DATE_CLASSES = [("#countDownText", "text-dark"), "posted-date", "date", "<time>"]
PHONE_FIELDS = ["seller-phone", "phone"]
PHONE_LINKS = "^https?://wa[.]me/|api[.]whatsapp[.]com/send|^whatsapp:"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescape(c: Column) -> Column:
    for name, sign in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's attribute, quoted or not; null without it."""
    pattern = rf"""(?i)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return F.when(tag.rlike(pattern), unescape(value))


def _elements(df: DataFrame) -> DataFrame:
    """df (with html) with texts (one more than tags) and elements, an array of what selectors may ask for."""
    clean = F.regexp_replace(F.coalesce(F.col("html").cast("string"), F.lit("")), SKIP, " ")
    df = df.withColumn("__clean", clean).withColumns({"texts": F.split("__clean", TAG, -1), "tags": F.regexp_extract_all("__clean", F.lit(TAG), F.lit(0))})
    name = lambda t: F.lower(F.regexp_extract(t, "^</?([a-zA-Z][a-zA-Z0-9-]*)", 1))
    step = lambda t, n: F.when(t.startswith("</"), -1).when(n.isin(VOID) | t.endswith("/>"), 0).otherwise(1)
    df = df.withColumn("names", F.transform("tags", name))
    df = df.withColumn("steps", F.transform("tags", lambda t, i: F.struct(i.alias("pos"), F.get("names", i).alias("name"), step(t, F.get("names", i)).alias("step"))))

    def element(t: Column, i: Column) -> Column:
        own = F.get("steps", i)
        same = F.filter("steps", lambda s: (s.pos > i) & (s["name"] == own["name"]))
        start = F.struct(F.lit(0).alias("depth"), F.size("tags").alias("end"))
        walk = lambda acc, s: F.when(acc.depth < 0, acc).otherwise(F.struct((acc.depth + s.step).alias("depth"), F.when(acc.depth + s.step < 0, s.pos).otherwise(acc.end).alias("end")))
        end = F.when(own.step == 0, i).otherwise(F.aggregate(same, start, walk).end)
        classes = F.filter(F.split(F.coalesce(attribute(t, "class"), F.lit("")), r"\s+"), lambda x: x != "")
        return F.struct(
            i.alias("pos"), end.alias("end"), own["name"].alias("name"), classes.alias("classes"), t.rlike(r"(?i)\sdata-listing\b").alias("marked"),
            *[attribute(t, a).alias(a.replace("-", "_")) for a in ("id", "data-field", "content", "href", "src", "data-src")],
        )

    asked = lambda t: ~t.startswith("</") & t.rlike(r"(?i)^<(?:article|img|a|time)\b|[\s\"'](?:data-listing\b|data-field|class|id)")
    found = F.filter(F.transform("tags", lambda t, i: F.when(asked(t), element(t, i))), lambda e: e.isNotNull())
    return df.withColumn("elements", found).drop("__clean", "tags", "names", "steps")


def _is(e: Column, what: str) -> Column:
    if what.startswith("<"):
        return e["name"] == what.strip("<>")
    if what.startswith("#"):
        return F.coalesce(F.startswith(e["id"], F.lit(what[1:])), F.lit(False))
    return F.array_contains(e.classes, what)


def _within(e: Column, around: str) -> Column:
    return F.exists("elements", lambda p: _is(p, around) & (p.pos < e.pos) & (e.pos < p.end))


def _blocks_of(kind: str) -> Column:
    """Elements that make blocks of a kind."""
    return F.filter("elements", lambda e: e.marked if kind == "[data-listing]" else e["name"] == kind if kind == "article" else F.array_contains(e.classes, kind))


def _any_of(e: Column, selectors: list) -> Column:
    """Whether an element is one that selectors name; of a pair, it must stand in an element of the first kind."""
    out = F.lit(False)
    for s in selectors:
        around, own = s if isinstance(s, tuple) else (None, s)
        hit = _is(e, own)
        if around:
            hit = hit & _within(e, around)
        out = out | hit
    return out


def _text(e: Column) -> Column:
    """An element's text, tags as blanks, squeezed; null where nothing is left."""
    return T.squeeze(unescape(F.array_join(F.slice("texts", e.pos + 2, F.greatest(e.end - e.pos, F.lit(0))), " ")))


def listing_blocks_from_html(pages: DataFrame) -> DataFrame:
    """page_id, url, block_no, kind, listing_text, seller, seller_phone, posted_date, image_url, source_url of every block.

    kind is the first of BLOCKS that a page has; blocks in blocks are blocks too. A field is the block's first element
    of that data-field, else the first one of its classes; an empty field is null. The text falls back to the whole
    block's; blocks without any text are left out. Unclosed elements reach the page's end. Null and empty pages have no
    blocks; repeated rows are judged one by one.
    """
    df = _elements(pages.select("page_id", "url", "html"))
    hits = {k: _blocks_of(k) for k in BLOCKS}
    df = df.withColumn("kind", F.coalesce(*[F.when(F.size(h) > 0, k) for k, h in hits.items()]))
    blocks = F.coalesce(*[F.when(F.col("kind") == k, h) for k, h in hits.items()])

    def block(b: Column, i: Column) -> Column:
        inside = F.filter("elements", lambda e: (e.pos > b.pos) & (e.pos < b.end))
        first = lambda test: F.get(F.filter(inside, test), F.lit(0))
        field = lambda name, classes: F.coalesce(first(lambda e: e.data_field == name), first(lambda e: _any_of(e, classes)))
        phone, link = first(lambda e: e.data_field.isin(PHONE_FIELDS)), first(lambda e: (e["name"] == "a") & e.href.rlike(PHONE_LINKS))
        image, source = first(lambda e: e["name"] == "img"), first(lambda e: (e["name"] == "a") & e.href.isNotNull())
        filled = lambda c: F.when(c != "", c)
        return F.struct(
            i.alias("block_no"), F.coalesce(_text(field("listing-text", TEXT_CLASSES)), _text(b)).alias("listing_text"), _text(field("seller", SELLER_CLASSES)).alias("seller"),
            T.clean_phone(F.coalesce(filled(phone.content), _text(phone)), link.href).alias("seller_phone"), _text(field("posted-date", DATE_CLASSES)).alias("posted_date"),
            T.squeeze(F.coalesce(filled(image.src), image.data_src)).alias("image_url"), T.squeeze(source.href).alias("source_url"),
        )

    rows = df.select("page_id", "url", "kind", F.explode_outer(F.transform(blocks, block)).alias("b")).where("b.listing_text IS NOT NULL")
    return rows.select("page_id", "url", "b.block_no", "kind", *[f"b.{c}" for c in ("listing_text", "seller", "seller_phone", "posted_date", "image_url", "source_url")])
