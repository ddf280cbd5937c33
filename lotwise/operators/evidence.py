"""Evidence columns of matched listings: price, scope, image, suspicious texts, scores and their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import scratch
from . import suspicious
from .suspicious import with_issues

# What counts as a visible price, karat gold that does not, stock-list markers.
PRICE_SEEN = (
    r"(?i)(?:[$€£¥]\s*[0-9]|\b(?:hkd|usd|usdt|eur|aed|chf)\s*[0-9]|\b[0-9]{1,3}(?:[,\s.][0-9]{3})+\s*(?:hkd|usd|usdt|eur|aed|chf)?\b"
    r"|\b[0-9]+(?:[,.][0-9]+)?[km]\b|\b[0-9]+(?:[,.][0-9]+)?[km]?\s*[$€£¥](?:[^a-zA-Z0-9_]|$)|\b[0-9]{5,8}\s*(?:hkd|usd|usdt|eur|aed|chf)?\b)"
)
KARAT, STOCK_LIST = f"(?i){suspicious.KARAT}", f"(?i){suspicious.STOCK_LIST}"
SCOPE_SCORE = {"scope.full_listing": 2, "scope.scoped": 1, "scope.stock_list": 0}


def has_price(c: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(T.col(c), F.lit("")), KARAT, " ").rlike(PRICE_SEEN)


def price_reason(text: str, raw: str) -> Column:
    other = T.col(raw).isNotNull() & (T.normalize_text(raw) != T.normalize_text(text))
    return F.when(has_price(text), "price.visible").when(other & has_price(raw), "price.ambiguous_neighbor").otherwise("price.missing_visible")


def scope_references(c: str | Column) -> Column:
    """Distinct product references of a raw post: with a digit, not only digits, no date, amount or currency."""
    toks = F.regexp_extract_all(F.lower(F.coalesce(T.col(c), F.lit(""))), F.lit(T.TOKEN), F.lit(0))
    keep = lambda t: (
        t.rlike("[0-9]") & ~t.rlike("^[0-9]+$") & ~t.rlike(r"^[0-9]+(\.[0-9]+)?[km]$") & ~t.rlike(T.CURRENCIES)
        & ~t.rlike(r"^((n?[0-9]{1,2}|[0-9]{1,2}n)[/-][0-9]{2,4}y?|[0-9]{2,4}[/-](n?[0-9]{1,2}|[0-9]{1,2}n)y?|[0-9]{4}\.[0-9]{1,2}y?)$")
        & ((F.length(t) >= 4) | t.contains("/"))
    )
    return F.array_distinct(F.filter(toks, keep))


def scope_reason(text: str, raw: str) -> Column:
    squeezed = lambda c: F.trim(F.regexp_replace(F.coalesce(T.col(c), F.lit("")), r"\s+", " "))
    same = (squeezed(raw) == "") | (squeezed(raw) == squeezed(text))
    many = T.col(raw).rlike(STOCK_LIST) | (F.size(scope_references(raw)) > 1)
    return F.when(same, "scope.full_listing").when(many, "scope.stock_list").otherwise("scope.scoped")


def image_reason(image: str, scope: Column) -> Column:
    return (
        F.when(T.col(image).isNotNull() & (T.col(image) != ""), "image.direct")
        .when(scope == "scope.stock_list", "image.omitted_bundle_ambiguous").otherwise("image.missing_source")
    )


def attribute_image(text: str, raw: str, image: str) -> Column:
    """Whether a bundle's image may stand for a segment: only the first reference of the parent inherits it."""
    before = F.expr(f"substring({raw}, 1, position({text}, {raw}) - 1)")
    first = F.size(scope_references(before)) == 0
    has = T.col(image).isNotNull()
    return (
        F.when(~has, "image.missing_source").when(T.col(raw).isNull() | (T.col(raw) == T.col(text)), "image.direct")
        .when(first & (F.expr(f"position({text}, {raw})") > 0), "image.inherited_parent_first_item").otherwise("image.omitted_bundle_ambiguous")
    )


def quality(issues: Column) -> tuple[Column, Column]:
    """(group, severity): 0 clean, 1 only the price is missing, 2 suspicious."""
    severity = F.coalesce(F.array_max(F.transform(issues, lambda i: i.severity)), F.lit(0))
    only = F.forall(issues, lambda i: i.reason == "missing_price_evidence")
    return F.when(F.size(issues) == 0, 0).when(only, 1).otherwise(2), severity


def fuzzy_score(query: str, listing: str) -> tuple[Column, Column]:
    """(text, reference) scores of 0 to 100: containment of the query's tokens, closeness of its first reference.

    Our own formula: a set containment and an edit distance, not a library's ratio.
    """
    q = fuzzy_words(query)
    return fuzzy_score_of(q, first_reference(q), fuzzy_words(listing))


def fuzzy_words(c: str) -> Column:
    """What fuzzy_score needs of a text."""
    return F.array_distinct(T.tokens(c))


def first_reference(words: Column) -> Column:
    return F.get(F.filter(words, lambda t: t.rlike("[0-9]")), F.lit(0))


def fuzzy_score_of(q: Column, ref: Column, listing_tokens: Column) -> tuple[Column, Column]:
    """fuzzy_score of fuzzy_words that are at hand, and of the search's first_reference: distances are measured only where it isn't among them."""
    text = F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, listing_tokens)) * 100 / F.size(q))).otherwise(0).cast("int")
    close = F.array_max(
        F.transform(
            F.filter(listing_tokens, lambda t: t.rlike("[0-9]")),
            lambda t: F.round(100 * (1 - F.levenshtein(t, ref) / F.greatest(F.length(t), F.length(ref)))).cast("int"),
        )
    )
    return text, F.when(F.array_contains(listing_tokens, ref), 100).otherwise(F.coalesce(close, F.lit(0)))


def weak_match_reasons(reference: str, overlap: str, text: str) -> Column:
    return F.array_compact(
        F.array(
            F.when(F.col(reference) < 60, F.lit("weak.reference")),
            F.when(F.col(overlap) < 100, F.lit("weak.descriptor_overlap")),
            F.when(F.col(text) < 45, F.lit("weak.text")),
        )
    )


def raw_context(text: str, raw: str, n: int = 1200) -> tuple[Column, Column, Column]:
    """(window, cut before, cut after): at most n characters of the raw post around the shown text."""
    at = F.greatest(F.expr(f"position({text}, {raw})"), F.lit(1))
    mid = at + F.floor(F.length(text) / 2)
    start = F.greatest(F.least(mid - n // 2, F.length(raw) - n + 1), F.lit(1)).cast("int")
    return F.substring(F.col(raw), start, F.lit(n)), start > 1, start + n - 1 < F.length(raw)


def snippet(query: str, raw: str) -> Column:
    """The part of a post (between ` - [ ] `, bullets or bars) that shares most tokens with the query; then the shortest."""
    parts = F.filter(F.transform(F.split(F.col(raw), r" - \[ \] | • | \| "), lambda p: F.trim(p)), lambda p: p != "")
    q = F.array_distinct(T.tokens(query))
    ranked = F.transform(parts, lambda p, i: F.struct(F.size(F.array_intersect(q, T.tokens(p))).alias("o"), (-F.length(p)).alias("l"), (-i).alias("i"), p.alias("p")))
    return F.array_max(ranked).p


def search_parts(queries: DataFrame) -> DataFrame:
    """queries with what score_components needs of query_text, worked out once a query (SEARCH_PARTS)."""
    refs, descs = T.parse_query_terms("query_text")
    return queries.withColumns({"__refs": refs, "__descs": descs, "__colors": T.color_set("query_text")})


SEARCH_PARTS = ["__refs", "__descs", "__colors"]
#: score_components' columns.
COMPONENTS = [
    "quality_group", "severity", "conflict", "date_group", "reference_score", "descriptor_score", "price_score", "scope_score", "image_score",
]


def score_components(matches: DataFrame) -> DataFrame:
    """matches (query_text, listing_text, raw_listing_text, image_url, posted_date, ...) with the ranking's components.

    Rows with search_parts' columns need no query_text and lose those.
    """
    scope = scope_reason("listing_text", "raw_listing_text")
    group, severity = quality(F.col("issues"))
    rows = matches if set(SEARCH_PARTS) <= set(matches.columns) else search_parts(matches)
    rows = rows.withColumn("__words", T.canonical_words(T.normalize_text("listing_text")))  # once for three components
    q, seen = F.col("__colors"), F.array_intersect("__words", F.array(*map(F.lit, T.COLORS)))
    out = with_issues(rows, "listing_text", "raw_listing_text")
    return out.withColumns(
        {
            "quality_group": group, "severity": severity,
            "conflict": ((F.size(q) > 0) & (F.size(seen) > 0) & ~F.arrays_overlap(q, seen)).cast("int"),
            "date_group": F.col("posted_date").isNull().cast("int"),
            "reference_score": (F.size(F.array_intersect("__refs", "__words")) > 0).cast("int"),
            "descriptor_score": F.size(F.array_intersect("__descs", "__words")),
            "price_score": has_price("listing_text").cast("int"),
            "scope_score": F.element_at(F.create_map(*[F.lit(x) for kv in SCOPE_SCORE.items() for x in kv]), scope),
            "image_score": F.when(image_reason("image_url", scope) == "image.direct", 2).otherwise(0),
        }
    ).drop("issues", "__words", *SEARCH_PARTS)


def with_plan_scores(scored: DataFrame, guarded: DataFrame, keys: list[str]) -> DataFrame:
    """score_components' rows with what guardrails.with_guardrails says of them: demoted ones join quality group 1, only
    conflicts inside the segment count, and the brand's claim is the twelfth component."""
    plan = guarded.select(*[F.col(k).alias(f"__{k}") for k in keys], "guardrail_group", "guardrail_reasons", F.col("alias_score").alias("__alias"))
    rows = scored.join(plan.dropDuplicates([f"__{k}" for k in keys]), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left")
    return plan_scores(rows.withColumn("alias_score", F.col("__alias"))).drop("__alias", *[f"__{k}" for k in keys])


def plan_scores(rows: DataFrame) -> DataFrame:
    """with_plan_scores of rows that have both."""
    return rows.withColumns({
        "quality_group": F.greatest("quality_group", "guardrail_group"), "alias_score": F.coalesce("alias_score", F.lit(0)),
        "conflict": F.coalesce(F.array_contains("guardrail_reasons", "guardrail.descriptor_conflict"), F.lit(False)).cast("int"),
    })


RANK_ORDER = [
    "quality_group", "conflict", "severity", "date_group", "-posted_date", "-alias_score", "-reference_score", "-descriptor_score",
    "-price_score", "-scope_score", "-image_score", "rank_in",
]


def rank_by_quality(scored: DataFrame, query: str | list[str] = "query_id") -> DataFrame:
    """rank: position in the query's quality order (conflicts before severity), ties by input order; keys that scored lacks are left out."""
    order = [F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c).asc() for c in RANK_ORDER if c.strip("-") in scored.columns]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)))


def top_k(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.col("rank") <= k)


def page(ranked: DataFrame, offset: int, limit: int, query: str = "query_id") -> DataFrame:
    """One page of every query's ranked rows with total, has_more and next_offset."""
    total = F.count("*").over(Window.partitionBy(query))
    rows = ranked.withColumn("total_count", total).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    more = F.col("total_count") > offset + limit
    return rows.withColumns({"has_more": more, "next_offset": F.when(more, F.lit(offset + limit))})


def order_results(rows: DataFrame, mode: str, rank: str = "rank_in", id_: str = "listing_id") -> DataFrame:
    """rows with place, from 1 over all rows, by rank, posted_desc, seller (code points), price_asc or price_desc.

    Priceless and undated rows come last either way, ties go by rank and id. Rows are dealt by ranges and sorted inside
    them; only a count for each range meets in one task. The sorted rows are written once.
    """
    first = {
        "rank": [], "posted_desc": [F.col("posted_date").desc_nulls_last()], "seller": [F.coalesce("seller", F.lit("")).asc()],
        "price_asc": [F.col("price").asc_nulls_last()], "price_desc": [F.col("price").desc_nulls_last()],
    }
    order = [*first[mode], F.col(rank).asc(), F.col(id_).asc()]
    path = scratch(rows.sparkSession, "ordered")
    at = F.monotonically_increasing_id()  # the task's number from bit 33, the row's inside it below
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at)
    sorted_.write.parquet(path)
    out = rows.sparkSession.read.schema(sorted_.schema).parquet(path)
    out = out.withColumns({"__range": F.shiftright("__at", 33), "__inside": F.col("__at").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = out.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__start") + F.col("__inside") + 1
    return out.join(F.broadcast(starts), "__range").withColumn("place", place).drop("__at", "__range", "__inside", "__start")
