"""What a match must keep to: prefilters, guardrails, spans and prices, and the gates of suggested texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..sources.shared import written
from . import match as M
from . import rulebook as R


# Descriptors that a source's filter widens, and those it must not lose; how many images stand in.
WIDENED, STRICT_ALIASES, IMAGE_LIMIT = ["panda"], ["choco"], 6
STRICT = ["strict_non_color_descriptor", "strict_color_alias"]


def prefilter_policy(queries: DataFrame) -> DataFrame:
    """queries with refs, descs, policy (how far a filtered source is trusted), matching_text and allows_image.

    A widened descriptor is left to the source. Without descriptors, with a widened one only, or with colours beside no
    specific reference the source's rows pass; any other descriptor, and colours of a specific reference, must match.
    """
    q = R.classify_intent(queries)
    words = lambda xs: F.array(*map(F.lit, xs))
    q = q.withColumn("own", F.array_except("descs", words(WIDENED))).withColumn("strange", F.array_except("own", T.color_set("query_text")))
    specific = F.exists("refs", lambda r: r.rlike("[a-z/]") | (F.length(r) >= 5))
    policy = (
        F.when(F.size("descs") == 0, "coarse_no_descriptor").when(F.size("strange") > 0, STRICT[0])
        .when((F.size("own") > 0) & ~specific, "coarse_color_only").when((F.size("own") > 0) & F.arrays_overlap("own", words(STRICT_ALIASES)), STRICT[1])
        .when(F.size("own") > 0, STRICT[0]).otherwise("coarse_pass_through_alias")
    )
    kept = F.filter("descs", lambda t: ~t.isin(WIDENED))
    text = F.when(policy.isin(STRICT) & (F.size(kept) < F.size("descs")), F.array_join(F.concat("refs", kept), " ")).otherwise(F.col("query_text"))
    few = F.size(F.array_except("required", words(WIDENED))) <= 1
    return q.withColumns({"policy": policy, "matching_text": text, "allows_image": few}).drop("own", "strange")


def prefiltered_match(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, listing_id, policy, kept_by) of a filtered source's candidates that stay.

    candidates: query_id, listing_id, rank_in, listing_text, image_url; queries: query_id, query_text. Requests and
    listings of other colours go first. Searches for a reference alone keep its matches where there are any, else all;
    coarse policies keep all; strict ones keep the matches, or, where there is none and one descriptor at most is asked
    for, the first IMAGE_LIMIT listings with an image that match the reference.
    """
    offers = candidate_offers(candidates, "query_id")
    return kept_candidates(lambda searches: offers.join(searches, "query_id"), queries)


def candidate_offers(listings: DataFrame, *by: str) -> DataFrame:
    """What kept_candidates needs of listings, worked out once a listing, and the columns by which searches meet them."""
    rows = listings.select(*by, "listing_id", "rank_in", (F.coalesce("image_url", F.lit("")) != "").alias("pictured"), T.tokens("listing_text").alias("toks"))
    rows = rows.withColumns({"shown": F.array_join("toks", " "), "plain": M.plain_text("toks")})
    hues = F.array_intersect(T.canonical_words(F.col("shown")), F.array(*map(F.lit, T.COLORS)))
    return rows.withColumns({"hues": hues, "non_sale": T.reads_non_sale(F.col("shown"))}).drop("shown")


def kept_candidates(meet: Callable[[DataFrame], DataFrame], queries: DataFrame, *by: str) -> DataFrame:
    """prefiltered_match of the candidates that meet joins: candidate_offers with searches (query_id, *by and others).

    A pair is judged where it meets, once, and written by its ids if it is kept, or would be if its search had no match.
    """
    of = lambda text, name: [F.array_distinct(x).alias(f"{name}_{c}") for x, c in zip(T.parse_query_terms(text), ("refs", "descs"), strict=True)]
    q = prefilter_policy(queries).withColumns({"strict": F.col("policy").isin(STRICT), "alone": F.array_join("refs", " ")})
    asked = F.col("strict") | ((F.size("descs") == 0) & (F.size("refs") > 0))
    terms = [*of("matching_text", "asked"), *of("alone", "named")]
    q = q.select("query_id", *by, "policy", "strict", (F.col("strict") & F.col("allows_image")).alias("stood_for"), asked.alias("asked"), T.color_set("query_text").alias("colors"), *terms)

    other = (F.size("colors") > 0) & (F.size("hues") > 0) & ~F.arrays_overlap("colors", "hues")
    rows = meet(written(q, "policies")).where(F.when(F.col("non_sale"), False).otherwise(~other))  # as one test of both sides: it isn't worked out twice
    rows = rows.withColumn("hit", F.col("asked") & M.pair_matches("asked_refs", "asked_descs", "toks", "plain"))
    image = F.col("stood_for") & F.col("pictured") & M.pair_matches("named_refs", "named_descs", "toks", "plain")
    by_what = F.when(F.col("hit"), "match").when(~F.col("asked"), "source").when(~F.col("strict"), "alone").when(image, "image")
    rows = rows.select("query_id", "listing_id", "policy", "rank_in", F.explode_outer(F.array(by_what)).alias("kept_by")).where("kept_by IS NOT NULL")
    rows = written(rows.withColumn("rank_in", F.when(F.col("kept_by") == "image", F.col("rank_in"))), "judged")

    out = ["query_id", "listing_id", "policy"]
    answered = rows.where("kept_by = 'match'").select("query_id").distinct()
    rest = rows.where("kept_by IN ('alone', 'image')").join(M.sent(answered), "query_id", "left_anti")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("rank_in", "listing_id"))
    shown = rest.where("kept_by = 'image'").withColumn("n", first).where(F.col("n") <= IMAGE_LIMIT).select(*out, "kept_by")
    alone = rest.where("kept_by = 'alone'").select(*out, F.lit("source").alias("kept_by"))
    return rows.where("kept_by IN ('match', 'source')").select(*out, "kept_by").unionByName(alone).unionByName(shown)


def image_layout(text: str, raw: str, scope: Column) -> Column:
    """Why a listing has no image."""
    refs = F.regexp_extract_all(F.lower(F.coalesce(F.col(raw), F.lit(""))), F.lit(r"[a-z0-9/.-]*[0-9][a-z0-9/.-]*"), F.lit(0))
    long = F.filter(refs, lambda r: F.length(r) >= 4)
    return (
        F.when(scope == "scope.stock_list", "stock_list").when(F.size(long) > F.size(F.array_distinct(long)), "repeated_reference")
        .when(F.size(F.array_distinct(long)) > 1, "multi_reference_bundle").when(scope == "scope.scoped", "scoped_parent").otherwise("unknown")
    )


def descriptor_span(matches: DataFrame, span: int = 12) -> DataFrame:
    """(query_id, listing_id, start, len): shortest window of at most span tokens holding all descriptors, then leftmost."""
    rows = matches.select("query_id", "listing_id", F.array_distinct(T.parse_query_terms("query_text")[1]).alias("descs"), T.canonical_tokens(T.tokens("listing_text")).alias("toks"))
    ends = "transform(descs, d -> array_position(slice(toks, s + 1, %d), d))" % span
    cand = F.expr(f"transform(sequence(0, size(toks) - 1), s -> named_struct('len', if(exists({ends}, p -> p = 0), null, array_max({ends})), 'start', s))")
    best = F.array_min(F.filter(cand, lambda c: c.len.isNotNull()))
    return rows.where("size(descs) > 0 AND size(toks) > 0").withColumn("b", best).where("b IS NOT NULL").select("query_id", "listing_id", "b.start", "b.len")


def display_price(text: str, raw: str) -> Column:
    """Highest amount next to a currency (k, m, mil, million, u), from the shown text, else from the raw one; null without any."""
    cur = r"(?:hkd|usdt|usd|eur|aed|chf|[$€£¥])"
    num = r"[0-9][0-9,. ]*[0-9]|[0-9]"
    unit = r"\s*(?:k|million|mil|m|u)?"

    def amounts(c: str) -> Column:
        t = F.lower(F.coalesce(F.col(c), F.lit("")))
        found = F.concat(F.regexp_extract_all(t, F.lit(rf"{cur}\s*(?:{num}){unit}\b"), F.lit(0)), F.regexp_extract_all(t, F.lit(rf"(?:{num}){unit}\s*{cur}"), F.lit(0)))

        def value(m: Column) -> Column:
            digits = F.regexp_extract(m, num, 0)
            times = F.when(m.rlike(r"[0-9]\s*k"), 1_000).when(m.rlike(r"[0-9]\s*(m|u\b|u\s*[^s])"), 1_000_000).otherwise(1)
            grouped = digits.rlike("[,. ][0-9]{3}($|[,. ])") & (times == 1)
            plain = F.when(grouped, F.regexp_replace(digits, "[,. ]", "")).otherwise(F.regexp_replace(digits, "[, ]", ""))
            return F.floor(plain.cast("double") * times).cast("long")

        return F.array_max(F.transform(found, value))

    return F.coalesce(amounts(text), amounts(raw))


def gate_suggestions(rows: DataFrame, mode: str = "guarded") -> DataFrame:
    """gate_status and gate_reasons of suggested texts: non-empty, part of the raw post, short, one item, naming the query's references."""
    s = F.trim(F.coalesce("suggested_text", F.lit("")))
    refs = T.parse_query_terms("query_text")[0]
    reasons = F.array_compact(F.array(
        F.when(s == "", F.lit("empty")), F.when(~F.coalesce(F.col("raw_listing_text").contains(s), F.lit(False)), F.lit("not_in_raw")),
        F.when(F.length(s) > 1024, F.lit("too_long")), F.when(s.rlike(r" \| | • |->"), F.lit("several_items")),
        F.when(F.size(F.array_except(refs, T.tokens(s))) > 0, F.lit("query_mismatch")),
    ))
    status = F.when(F.lit(mode == "off"), "off").when(F.size(reasons) > 0, "rejected").otherwise("accepted" if mode == "guarded" else mode)
    return rows.withColumn("gate_reasons", reasons).withColumn("gate_status", status)


def validate_responses(replies: DataFrame, column: str = "reply", least: float = 0.7) -> DataFrame:
    """Model replies as JSON: typed fields, and reasons why one can't be used."""
    r = F.from_json(column, "struct<text:string,confidence:double,risk_flags:array<string>>")
    out = replies.withColumn("r", r)
    reasons = F.array_compact(F.array(
        F.when(F.col("r.text").isNull(), F.lit("no_text")), F.when(~F.coalesce(F.col("r.confidence").between(least, 1), F.lit(False)), F.lit("low_confidence")),
        F.when(F.size(F.coalesce("r.risk_flags", F.array().cast("array<string>"))) > 0, F.lit("risk_flags")),
    ))
    return out.select("*", F.col("r.text").alias("text"), F.col("r.confidence").alias("confidence"), reasons.alias("reasons")).drop("r")


def refine_with(rows: DataFrame, cached: DataFrame, fn, keys: list[str]) -> DataFrame:
    """Refined texts: cached ones first; fn maps Arrow batches of the others (pandas frames to pandas frames with refined_text)."""
    known = rows.join(cached, keys)
    todo = rows.join(cached, keys, "left_anti")
    schema = StructType([*todo.schema.fields, StructField("refined_text", StringType())])
    return known.unionByName(todo.mapInPandas(fn, schema), allowMissingColumns=True)
