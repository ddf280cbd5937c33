"""Guardrails of a match: evidence in its segment for what the query's plan requires, and matches that must not be shown.

A plan (rulebook.annotate_query_plan) says what is required; the words of the match's segment are compared with it by
their places: a colour beside a card or tag is no dial, a nickname needs its phrase, a model's one-digit suffix its model.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .evidence import scope_reason
from .rulebook import has_phrase
from .segments import extract_segments

# Words that make a colour an accessory's, phrases that stand for a nickname, grades of brand claims.
ACCESSORY_WORDS = ["card", "cards", "label", "labels", "paper", "papers", "sticker", "stickers", "tag", "tags"]
ACCESSORY_COLORS = ["white"]
NICKNAME_PHRASES = {"panda": ["white dial", "white dials", "white face"]}
CLAIM_SCORES = {"reference": 3, "explicit": 2, "collection": 1, "nickname": 1}
CONTEXT_KINDS = ["reference_with_descriptor", "reference_with_year"]

PLAN = ["query_id", "brands", "nicknames", "required", "conflicts", "intent_kind", "refs"]


def _words(xs: list[str]) -> Column:
    return F.array(*map(F.lit, xs))


def _suffix_phrases(required: str) -> Column:
    """(pattern, length) of every phrase of a required model word and a one-digit suffix."""
    suffixes = F.filter(required, lambda t: t.rlike("^[0-9]$"))
    models = F.filter(required, lambda t: ~t.rlike("^[0-9]+$"))
    phrase = lambda m, s: F.struct(F.concat(F.lit(r"\b\Q"), m, F.lit(r"\E\s+"), s, F.lit(r"\b")).alias("pattern"), (F.length(m) + 2).alias("length"))
    return F.flatten(F.transform(models, lambda m: F.transform(suffixes, lambda s: phrase(m, s))))


def _shows(nickname: str, words: Column) -> Column:
    """A nickname or one of its phrases among words."""
    out = F.array_contains(words, nickname)
    for phrase in NICKNAME_PHRASES[nickname]:
        out = out | has_phrase(words, phrase)
    return out


def with_guardrails(matches: DataFrame, plans: DataFrame, keys: list[str]) -> DataFrame:
    """matches with guardrail_group (1: demoted), guardrail_reasons, alias_score, alias_reason and local_words.

    matches: keys, query_id, query_text, listing_text, raw_listing_text. In order, the first that holds decides: a model's
    suffix phrase is missing; a nickname has no evidence; a required colour stands beside accessories only (unless the
    raw post names its product and is no stock list); a required descriptor or colour is missing while a conflicting one
    stands in the segment. The last two need a query of references with descriptors. A query whose reference isn't in the
    text has no segment, so only the first counts. Matches without a plan have no guardrails.
    """
    plan = asked_plans(plans)
    segments = extract_segments(matches, keys).select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.col("segment").alias("__segment"), F.col("reference").alias("__reference"))
    same = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]
    rows = matches.join(segments.dropDuplicates([f"__key_{k}" for k in keys]), same, "left").join(plan, "query_id", "left")
    rows = _guarded(rows)
    return rows.drop(*[c for c in rows.columns if c.startswith("__") and c not in matches.columns])


def asked_plans(plans: DataFrame) -> DataFrame:
    """(query_id, *ASKED): what guardrails need of a plan, worked out once a query."""
    plan = plans.select("query_id", *[F.col(c).alias(f"__{c}") for c in PLAN[1:]]).dropDuplicates(["query_id"])
    return plan.withColumns({"__asked": T.canonical_tokens(F.col("__required")), "__phrases": _suffix_phrases("__required")})


ASKED = [f"__{c}" for c in PLAN[1:]] + ["__asked", "__phrases"]


def _hues(c: str) -> Column:
    """Colours and conflicting descriptors that may stand in any part of a text: of their spellings, one is in it."""
    spelt = {x: [x] for x in [*T.COLORS, *T.CONFLICTS]}
    for spelling, name in (T.ALIASES | T.PHRASES).items():
        if name in spelt:
            spelt[name].append(spelling.split(" ")[0])
    text = F.lower(c)
    held = lambda words: functools.reduce(operator.or_, [F.contains(text, F.lit(w)) for w in words])
    return F.array_compact(F.array(*[F.when(held(words), F.lit(name)) for name, words in spelt.items()]))


def _looked_into() -> Column:
    """Whether a guardrail may look into a match's segment: its plan names a nickname, an accessory's colour, or a descriptor
    or colour beside which a conflicting one may stand in the text. Letters with accents are not told by their bytes."""
    asked = F.col("__asked")
    special = F.arrays_overlap("__nicknames", _words(list(NICKNAME_PHRASES))) | F.arrays_overlap(asked, _words(ACCESSORY_COLORS))
    graded = F.arrays_overlap(asked, _words([*T.CONFLICTS, *T.COLORS]))
    plain = F.octet_length("listing_text") == F.length("listing_text")
    beside = F.size(F.array_except(F.when(graded, _hues("listing_text")), asked)) > 0
    return F.coalesce(special | (graded & (~plain | beside)), F.lit(False))


def guard_matches(rows: DataFrame) -> DataFrame:
    """rows (query_text, listing_text, raw_listing_text, ASKED, ...) with with_guardrails' columns but local_words, row by row.

    Segments are cut only where a guardrail may look into them; nothing is joined or shuffled. The columns of ASKED stay.
    """
    packed = rows.select(F.struct("*").alias("__row"), "query_text", F.when(_looked_into(), F.col("listing_text")).otherwise("").alias("__text"))
    cut = extract_segments(packed, ["__row"], text="__text").select("__row.*", F.col("segment").alias("__segment"), F.col("reference").alias("__reference"))
    out = ["guardrail_group", "guardrail_reasons", "alias_score", "alias_reason"]
    return _guarded(cut).select(*rows.columns, *out)


def _guarded(rows: DataFrame) -> DataFrame:
    """with_guardrails of rows with ASKED, __segment and __reference."""
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("__nicknames", "__required", "__conflicts", "__refs", "__asked")})
    rows = rows.withColumn("__phrases", F.coalesce("__phrases", F.array().cast(rows.schema["__phrases"].dataType)))
    lost = (F.size("__refs") > 0) & F.col("__reference").isNull()
    rows = rows.withColumns({
        "local_words": F.when(lost, none).otherwise(T.tokens("__segment")), "__shown": F.when(F.size("__phrases") > 0, T.normalize_text("listing_text")),
        "__raw": T.tokens("raw_listing_text"), "__scope": F.when(F.arrays_overlap("__asked", _words(ACCESSORY_COLORS)), scope_reason("listing_text", "raw_listing_text")),
    })
    rows = rows.withColumns({"__words": F.transform("local_words", T.canonical_token), "__merged": T.canonical_tokens(F.col("local_words"))})
    words, local = F.col("__words"), F.size("local_words") > 0
    holds = lambda d: F.array_contains(words, d) | F.array_contains("__merged", d)

    phrase_missing = (F.size("__phrases") > 0) & ~F.exists("__phrases", lambda p: F.regexp_like("__shown", p.pattern))
    unproved = [F.when(F.array_contains("__nicknames", n) & local & ~_shows(n, words), F.lit(f"nickname.missing:{n}")) for n in NICKNAME_PHRASES]
    accessory_query = F.arrays_overlap(T.tokens("query_text"), _words(ACCESSORY_WORDS))

    def context(color: str) -> tuple[Column, Column]:
        """(the colour stands beside accessories only, evidence codes)."""
        beside = lambda i: F.get("__words", i - 1).isin(ACCESSORY_WORDS) | F.get("__words", i + 1).isin(ACCESSORY_WORDS)
        places = F.filter(F.transform(words, lambda w, i: F.when(w == color, F.coalesce(beside(i), F.get("__words", i + 1).isin(ACCESSORY_WORDS), F.lit(False)))), lambda x: x.isNotNull())
        product, accessory = F.exists(places, lambda x: ~x), F.exists(places, lambda x: x)
        in_raw = F.lit(False) if color != "white" else _shows("panda", F.transform("__raw", T.canonical_token))
        lone = accessory & ~product
        codes = F.array(
            F.when(product, F.lit(f"evidence.product_color:{color}")), F.when(accessory, F.lit(f"evidence.accessory_color:{color}")),
            F.when(lone & in_raw & (F.col("__scope") != "scope.stock_list"), F.lit("evidence.raw_scoped_product:panda")),
            F.when(lone & in_raw & (F.col("__scope") == "scope.stock_list"), F.lit("evidence.stock_list_excluded:panda")),
        )
        asked = F.array_contains("__asked", color) & ~accessory_query & local
        return asked & lone & ~(in_raw & (F.col("__scope") != "scope.stock_list")), F.when(asked, F.array_compact(codes)).otherwise(none)

    contexts = {c: context(c) for c in ACCESSORY_COLORS}
    evidence = F.concat(*[codes for _, codes in contexts.values()])
    lone = F.array_compact(F.array(*[F.when(only, F.lit(f"context.accessory_color_only:{c}")) for c, (only, _) in contexts.items()]))
    missing = F.exists("__asked", lambda d: (F.size(T.conflict_descriptors(F.array(d))) > 0) & ~holds(d))
    gold = F.when(missing, F.filter("__conflicts", holds)).otherwise(none)
    asked_colors = F.array_intersect("__asked", _words(T.COLORS))
    colors = F.array_sort(F.array_except(F.array_intersect("__merged", _words(T.COLORS)), asked_colors))
    colors = F.when((F.size(asked_colors) > 0) & ~F.exists(asked_colors, holds), colors).otherwise(none)
    conflict = F.transform(F.array_distinct(F.concat(gold, colors)), lambda d: F.concat(F.lit("conflict.local_descriptor:"), d))

    rows = rows.withColumns({"__nick": F.array_compact(F.array(*unproved)), "__evidence": evidence, "__lone": lone, "__conflict": F.when(local, conflict).otherwise(none)})
    strict = F.coalesce(F.col("__intent_kind").isin(CONTEXT_KINDS), F.lit(False)) & (F.size("__required") > 0)
    head = lambda code, *more: F.concat(F.array(F.lit(code)), *more)
    reasons = (
        F.when(phrase_missing, F.array(F.lit("guardrail.brand_model_phrase_missing")))
        .when(F.size("__nick") > 0, head("guardrail.nickname_evidence_missing", "__nick"))
        .when(strict & (F.size("__lone") > 0), head("guardrail.descriptor_context", "__lone", "__evidence"))
        .when(strict & (F.size("__conflict") > 0), head("guardrail.descriptor_conflict", "__conflict")).otherwise(F.col("__evidence"))
    )
    claims = F.transform(F.coalesce("__brands", F.array().cast(rows.schema["__brands"].dataType)), lambda b: b.confidence)
    by_score = [F.when(F.array_contains(claims, c), F.lit(c)) for c in CLAIM_SCORES if c not in ("collection", "nickname")]
    weak = F.get(F.filter(claims, lambda c: c.isin("collection", "nickname")), F.lit(0))
    best = F.coalesce(*by_score, weak)
    score = F.element_at(F.create_map(*[F.lit(x) for kv in CLAIM_SCORES.items() for x in kv]), best)
    rows = rows.withColumns({"guardrail_reasons": reasons, "alias_score": F.coalesce(score, F.lit(0)), "alias_reason": F.concat(F.lit("alias."), best)})
    group = F.exists("guardrail_reasons", lambda r: r.startswith("guardrail.")).cast("int")
    return rows.withColumn("guardrail_group", group)


def block_final(matches: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, blocked) of matches with guardrail_reasons: those without their model's suffix phrase are blocked.

    A match stays if its raw post has such a phrase that reaches into the place of the shown text or begins in it. The
    blocked ones carry the reasons and the action for the audit.
    """
    plan = plans.select("query_id", F.col("required").alias("__required")).dropDuplicates(["query_id"])
    rows = matches.join(plan, "query_id", "left").withColumn("__required", F.coalesce("__required", F.array().cast("array<string>")))
    rows = rows.withColumns({"__phrases": _suffix_phrases("__required"), "__raw": T.normalize_text("raw_listing_text"), "__shown": T.normalize_text("listing_text")})
    at = F.instr("__raw", F.col("__shown"))  # from 1, 0 where the shown text isn't part of the post

    def reaches(p: Column) -> Column:
        ahead = F.greatest(at - p.length, F.lit(1))
        before = F.regexp_instr(F.substr("__raw", ahead, p.length + p.length), p.pattern)
        inside = F.regexp_instr(F.substr("__raw", at, F.length("__shown") + p.length), p.pattern)
        return ((before > 0) & (before <= at - ahead + 1)) | ((inside > 0) & (inside <= F.length("__shown")))

    whole = F.coalesce(F.col("raw_listing_text"), F.lit("")) != ""
    other = whole & (F.col("raw_listing_text") != F.col("listing_text"))
    near = other & (at > 0) & (F.col("__shown") != "") & F.exists("__phrases", reaches)
    blocked = F.array_contains("guardrail_reasons", "guardrail.brand_model_phrase_missing") & ~F.coalesce(near, F.lit(False))
    rows = rows.withColumn("__blocked", F.coalesce(blocked, F.lit(False)))
    drop = ["__required", "__phrases", "__raw", "__shown", "__blocked"]
    side = rows.where("__blocked").drop(*drop).withColumns({
        "stage": F.lit("blocked_final"), "decision": F.lit("exclude"), "guardrail_action": F.lit("block_from_final"),
        "reason_codes": F.array(F.lit("guardrail.brand_model_phrase_missing"), F.lit("blocked.short_model_phrase_missing")),
    })
    return rows.where("NOT __blocked").drop(*drop), side
