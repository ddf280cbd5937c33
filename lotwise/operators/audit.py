"""Analytics of audit events, benchmark runs and result tables: plain aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(0.0)


def search_quality(queries: DataFrame) -> DataFrame:
    """Totals and rates over (results, image_missing, server_filtered, fallback) of query runs; one row, 0 when empty."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n = F.count("*")
    return queries.agg(
        n.alias("queries"), total("results").alias("results"), total("image_missing").alias("image_missing"),
        rate(total("image_missing"), total("results")).alias("image_missing_rate"),
        rate(total(F.col("server_filtered").cast("int")), n).alias("server_filtered_rate"),
        rate(total(F.col("fallback").cast("int")), n).alias("fallback_rate"),
    )


def audit_stage_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("query", "stage").agg(F.count("*").alias("n"))


def audit_rates(events: DataFrame) -> DataFrame:
    """Rates of weak matches, ambiguity, drops, missing images and stock lists; null scores count as 100."""
    n = lambda s: F.count_if(F.col("stage") == s)
    final = F.col("stage") == "final"
    matched = F.greatest(n("matched"), n("final"), F.lit(1))
    finals = F.greatest(n("final"), F.lit(1))
    return events.agg(
        (n("weak_match") / matched).alias("weak_rate"), (n("ambiguous_candidate") / matched).alias("ambiguous_rate"),
        (n("dedupe_drop") / matched).alias("dedupe_drop_rate"),
        F.count_if(final & (F.coalesce("fuzzy_score", F.lit(100)) < 60)).alias("low_fuzzy"),
        (F.count_if(final & ~F.coalesce("has_image", F.lit(False))) / finals).alias("missing_image_rate"),
        (F.count_if(final & (F.col("scope_reason") == "scope.stock_list")) / finals).alias("stock_list_rate"),
    )


def reason_counts(events: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Top k reasons of several array columns by count, ties by name."""
    codes = events.select(F.explode(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns])).alias("reason"))
    return codes.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def suspicious_summary(issues: DataFrame) -> DataFrame:
    """Per reason and severity: issues, distinct queries, latest id and its query."""
    return issues.groupBy("reason", "severity").agg(
        F.count("*").alias("n"), F.countDistinct("query_text").alias("queries"), F.max("id").alias("latest_id"),
        F.max_by("query_text", "id").alias("latest_query"),
    )


def alias_recall(runs: DataFrame, limit: float = 0.10) -> DataFrame:
    """Per canonical query and pass with two or more spellings: lowest and highest total, delta, whether within limit."""
    last = runs.where("ok").groupBy("canonical_query", "run_number", "query").agg(F.max_by("total_count", "event_id").alias("total"))
    out = last.groupBy("canonical_query", "run_number").agg(F.count("*").alias("spellings"), F.min("total").alias("low"), F.max("total").alias("high"))
    out = out.where("spellings >= 2").withColumn("delta", F.col("high") - F.col("low"))
    return out.withColumn("ok", rate(F.col("delta"), F.col("high")) <= limit)


def latency_summary(runs: DataFrame) -> DataFrame:
    """Counts and latencies of ok runs; p95 is the value at int(0.95 n), capped at the last.

    Ranks come from counts of each latency, so no task sorts all runs.
    """
    ok = runs.where("ok")
    by_value = ok.groupBy("elapsed_ms").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.orderBy("elapsed_ms"))  # one row per distinct millisecond
    n = F.sum("c").over(Window.partitionBy(F.lit(1)))
    ranked = by_value.select("elapsed_ms", "c", upto.alias("upto"), n.alias("n"))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("elapsed_ms")))
    p = ranked.agg(
        at(F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))).alias("p95"),
        at(F.floor((F.col("n") - 1) / 2)).alias("m1"), at(F.floor(F.col("n") / 2)).alias("m2"),
    )
    s = runs.agg(
        F.count_if("ok").alias("passed"), F.count("*").alias("total"), F.count_if(F.col("ok") & F.col("cache_hit")).alias("hits"),
        F.count_if(F.col("ok") & ~F.col("cache_hit")).alias("misses"),
        F.floor(F.avg(F.when(F.col("ok"), F.col("elapsed_ms")))).cast("long").alias("mean_ms"),
        F.min(F.when(F.col("ok"), F.col("elapsed_ms"))).alias("min_ms"), F.max(F.when(F.col("ok"), F.col("elapsed_ms"))).alias("max_ms"),
    )
    return s.crossJoin(p.select(F.floor((F.col("m1") + F.col("m2")) / 2).cast("long").alias("median_ms"), F.col("p95").alias("p95_ms")))


def case_expectations(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """Runs joined with their case: least total reached, expected fragments found in the top texts, and reasons."""
    both = runs.join(cases, "query")
    low = F.col("total_count") < F.coalesce("expected_min_total_count", F.lit(0))
    texts = F.lower(F.concat_ws("\n", "top_results"))
    missing = F.filter(F.coalesce("expected_fragments", F.array().cast("array<string>")), lambda f: ~texts.contains(F.lower(f)))
    reasons = F.array_compact(F.concat(F.array(F.when(low, F.lit("min_total"))), F.transform(missing, lambda f: F.concat(F.lit("missing:"), f))))
    return both.withColumn("reasons", reasons).withColumn("case_ok", F.size("reasons") == 0)


def query_audit_summary(rows: DataFrame) -> DataFrame:
    """Per query: audited rows, missing images and their rate, stock lists, and a map of stages to counts."""
    stages = rows.groupBy("query", "stage").agg(
        F.count("*").alias("n"), F.count_if(~F.coalesce("has_image", F.lit(False))).alias("gone"),
        F.count_if(F.col("scope_reason") == "scope.stock_list").alias("stock"),
    )
    out = stages.groupBy("query").agg(
        F.sum("n").alias("rows"), F.sum("gone").alias("image_missing"), F.sum("stock").alias("stock_list"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "n")))).alias("stages"),
    )
    return out.withColumn("image_missing_rate", rate(F.col("image_missing"), F.col("rows")))


STAGES = ["raw", "parsed", "matched", "weak_match", "ambiguous_candidate", "converted", "dedupe_drop", "refined", "blocked_final", "final"]
EVENT = {
    "listing_id": "string", "rank": "int", "decision": "string", "reason_codes": "array<string>", "fuzzy_score": "int", "guardrail_action": "string",
}
DECISIONS = {"weak_match": "warn", "ambiguous_candidate": "reject", "dedupe_drop": "drop", "blocked_final": "exclude"}


def funnel_events(stages: dict[str, DataFrame], key: str = "query_id") -> DataFrame:
    """(key, stage, EVENT's columns): the rows of every stage in one table; columns that a stage lacks are null.

    A stage's decision is its own column, else DECISIONS, else `keep`; reason codes default to none. Stages are named as
    in STAGES; anything else is refused.
    """
    if unknown := set(stages) - set(STAGES):
        raise ValueError(f"no such stage: {sorted(unknown)}")
    parts = []
    for stage, df in stages.items():
        own = {c: F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t) for c, t in EVENT.items()}
        own["decision"] = F.coalesce(own["decision"], F.lit(DECISIONS.get(stage, "keep")))
        own["reason_codes"] = F.coalesce(own["reason_codes"], F.array().cast("array<string>"))
        own["guardrail_action"] = F.coalesce(own["guardrail_action"], F.lit("none"))
        parts.append(df.select(key, F.lit(stage).alias("stage"), *[c.alias(n) for n, c in own.items()]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def funnel(events: DataFrame, key: str = "query", cut: int = 200) -> DataFrame:
    """Per key: raw, parsed, matched, converted, unique_latest, unique_text, final, dropped, weak, ambiguous, blocked,
    truncated (the parse reached ``cut``) and rejections, a map of reason codes to the rows that they turned away.

    unique_latest are converted rows that no `dedupe.latest` drop took, unique_text those that no other drop took either.
    Counts are summed by (key, stage, codes) before keys meet, and the map by (key, code).
    """
    none = F.array().cast("array<string>")
    codes = F.coalesce(F.col("reason_codes"), none) if "reason_codes" in events.columns else none
    decision = F.col("decision") if "decision" in events.columns else F.lit(None).cast("string")
    rows = events.select(key, "stage", codes.alias("codes"), decision.alias("decision")).groupBy(key, "stage", "codes", "decision").agg(F.count("*").alias("n"))
    n = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    at = lambda stage: n(F.col("stage") == stage)
    latest = n((F.col("stage") == "dedupe_drop") & F.array_contains("codes", "dedupe.latest"))
    out = rows.groupBy(key).agg(
        *[at(s).alias(s) for s in ("raw", "parsed", "matched", "converted")], (at("converted") - latest).alias("unique_latest"),
        (at("converted") - at("dedupe_drop")).alias("unique_text"), at("final").alias("final"), at("dedupe_drop").alias("dropped"), at("weak_match").alias("weak"),
        at("ambiguous_candidate").alias("ambiguous"), at("blocked_final").alias("blocked"),
    )
    away = rows.where(F.col("decision").isin("reject", "drop", "exclude") | (F.col("decision").isNull() & F.col("stage").isin("dedupe_drop", "ambiguous_candidate", "blocked_final")))
    away = away.select(key, F.explode_outer("codes").alias("code"), "n").where("code IS NOT NULL").groupBy(key, "code").agg(F.sum("n").alias("n"))
    away = away.groupBy(F.col(key).alias("__key")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("rejections"))
    out = out.join(away, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    return out.withColumns({"truncated": F.col("parsed") >= cut, "rejections": F.coalesce("rejections", F.create_map().cast("map<string,bigint>"))})


def branch_contribution(final: DataFrame, branches: DataFrame) -> DataFrame:
    """The first branch that found a listing owns it: results and top-3 results of each branch."""
    own = branches.groupBy("query_id", "listing_id").agg(F.min("branch").alias("branch"))
    both = final.join(own, ["query_id", "listing_id"])
    return both.groupBy("branch").agg(F.count("*").alias("results"), F.count_if(F.col("rank") <= 3).alias("top3"))


def fuzzy_summary(final: DataFrame) -> DataFrame:
    return final.groupBy("query").agg(F.min("fuzzy_score").alias("low"), F.round(F.avg("fuzzy_score"), 2).alias("mean"))


def action_counts(events: DataFrame, column: str, skip: str = "none") -> DataFrame:
    return events.where(F.col(column) != skip).groupBy(column).agg(F.count("*").alias("n"))


def result_summary(grouped: DataFrame, limit: int) -> DataFrame:
    """Per query: main results, similar ones grouped under them, size of the first batch."""
    out = grouped.groupBy("query_id").agg(F.count_if("is_primary").alias("main"), F.count_if(~F.col("is_primary")).alias("similar"))
    return out.withColumn("first_batch", F.least("main", F.lit(limit)))


def artifact_triage(events: DataFrame) -> DataFrame:
    """One row: events, queries, weak and dropped events, and a map of stages to counts."""
    stages = events.groupBy("stage").agg(F.count("*").alias("n"))
    stages = stages.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "n")))).alias("stages"))
    counts = events.agg(
        F.count("*").alias("events"), F.countDistinct("query").alias("queries"),
        F.count_if(F.col("stage") == "weak_match").alias("weak"), F.count_if(F.col("stage") == "dedupe_drop").alias("dropped"),
    )
    return counts.crossJoin(stages)


def missing_fields(results: DataFrame, key: str) -> DataFrame:
    return results.groupBy(key).agg(
        F.count("*").alias("results"), F.count_if(F.col("image_url").isNull()).alias("image_missing"), F.count_if(F.col("source_url").isNull()).alias("source_missing")
    )


def compare_audits(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per query and stage: counts before and after, and their difference."""
    a, b = (audit_stage_counts(x).withColumnRenamed("n", name) for x, name in ((before, "n_before"), (after, "n_after")))
    out = a.join(b, ["query", "stage"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("query", "stage", zero("n_before").alias("n_before"), zero("n_after").alias("n_after"), (zero("n_after") - zero("n_before")).alias("delta"))


def dominant_branch(times: DataFrame) -> DataFrame:
    """First branch with the largest time of each query (query, branch, ms)."""
    w = Window.partitionBy("query").orderBy(F.desc("ms"), "branch")
    return times.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
