"""Issue queues and keyed table maintenance: upserts, status changes, snapshots with a lifetime, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def issue_filter(issues: DataFrame, status: str = "open", min_severity: int = 0) -> DataFrame:
    """Issues of a status (or `all`) at or above a severity."""
    kept = issues.where(F.col("severity") >= min_severity)
    return kept if status == "all" else kept.where(F.col("issue_status") == status)


def feedback_queue(issues: DataFrame, n: int) -> DataFrame:
    return issues.orderBy(F.desc("report_count"), F.desc("updated_at"), F.desc("id")).limit(n)


def suspicious_queue(issues: DataFrame, n: int) -> DataFrame:
    return issues.orderBy(F.desc("severity"), F.desc("id")).limit(n)


def all_issues(feedback: DataFrame, suspicious: DataFrame, n: int) -> DataFrame:
    """Both queues in one table, feedback first; columns of only one of them are null in the other."""
    rows = feedback.withColumn("issue_type", F.lit("feedback")).unionByName(suspicious.withColumn("issue_type", F.lit("suspicious")), allowMissingColumns=True)
    return rows.orderBy("issue_type", F.desc("report_count"), F.desc("severity"), F.desc("id")).limit(n)


def upsert_listings(store: DataFrame, batch: DataFrame, key: list[str], seen: str) -> DataFrame:
    """Newest fields of each key with first_seen and last_seen; store rows already have both."""
    new = batch.withColumns({"first_seen": F.col(seen), "last_seen": F.col(seen)})
    fields = [c for c in new.columns if c not in (*key, "first_seen", "last_seen")]
    rows = new.select(*key, *fields, "first_seen", "last_seen").unionByName(store, allowMissingColumns=True)
    out = rows.groupBy(*key).agg(
        F.max_by(F.struct(*fields), F.struct("last_seen", *fields)).alias("s"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
    return out.select(*key, "s.*", "first_seen", "last_seen")


def upsert_feedback(reports: DataFrame) -> DataFrame:
    """Reports merged by (query, rank, reason, reporter, text), null reporters being equal: count and newest notes."""
    return reports.groupBy("query_text", "result_rank", "reason", "reporter_id", "listing_text").agg(
        F.count("*").alias("report_count"),
        F.expr("max_by(notes, report_id) FILTER (WHERE notes IS NOT NULL)").alias("notes"),
        F.max("reported_at").alias("updated_at"), F.min("report_id").alias("id"),
    ).withColumn("issue_status", F.lit("open"))


def upsert_suspicious(store: DataFrame, found: DataFrame) -> DataFrame:
    """Findings merged by (query, rank, reason, text): highest severity, reopened unless the stored one is ignored."""
    key = ["query_text", "result_rank", "reason", "listing_text"]
    new = found.groupBy(*key).agg(F.max("severity").alias("new_severity"), F.max("id").alias("new_id"))
    old = store.groupBy(*key).agg(F.max("severity").alias("severity"), F.min("id").alias("id"), F.max_by("issue_status", "id").alias("issue_status"))
    out = old.join(new, key, "full_outer")
    status = F.when(F.col("new_id").isNull() | (F.col("issue_status") == "ignored"), F.col("issue_status")).otherwise("open")
    return out.select(*key, F.coalesce("id", "new_id").alias("id"), F.greatest("severity", "new_severity").alias("severity"), status.alias("issue_status"))


def suggestion_key(query: str, raw: str, suggestion: str, model: str, version: str):
    parts = [F.col(query), F.sha2(F.col(raw), 256), F.sha2(F.col(suggestion), 256), F.col(model), F.col(version)]
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def upsert_suggestions(store: DataFrame, new: DataFrame) -> DataFrame:
    """Suggestions by key: a new row's fields win, an issue link stays if the new one is null."""
    old = store.select("key", *[F.col(c).alias(f"old_{c}") for c in store.columns if c != "key"])
    fields = [c for c in store.columns if c not in ("key", "issue_id")]
    both = old.join(new.withColumn("is_new", F.lit(True)), "key", "full_outer")
    return both.select(
        "key", *[F.when(F.col("is_new"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in fields], F.coalesce("issue_id", "old_issue_id").alias("issue_id")
    )


def apply_status(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest status of each id; reviewed_at is null for open issues."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("issue_status", "changed_at"), F.struct("changed_at", "issue_status")).alias("c"))
    out = store.join(last, "id", "left")
    status = F.coalesce("c.issue_status", "issue_status")
    return out.withColumns({"issue_status": status, "reviewed_at": F.when(status != "open", F.col("c.changed_at"))}).drop("c")


def replace_snapshots(store: DataFrame, new: DataFrame, now) -> DataFrame:
    """Live snapshots of other keys plus the new ones."""
    return store.where(F.col("expires_at") > now).join(new.select("cache_key"), "cache_key", "left_anti").unionByName(new)


def upsert_refinements(store: DataFrame, new: DataFrame) -> DataFrame:
    """Refined texts by (query, listing hash, model): the newest text and latency."""
    key = ["normalized_query", "listing_hash", "model"]
    rows = store.unionByName(new)
    out = rows.groupBy(*key).agg(F.max_by(F.struct("refined_text", "latency_ms"), F.struct("last_used", "refined_text")).alias("s"), F.max("last_used").alias("last_used"))
    return out.select(*key, "s.*", "last_used")


def export_cases(issues: DataFrame, status: str, n: int) -> DataFrame:
    return issues.where(F.col("issue_status") == status).select("id", "query_text", "result_rank", "reason", "listing_text").orderBy("id").limit(n)


def related_issue(suggestions: DataFrame, feedback: DataFrame, suspicious: DataFrame) -> DataFrame:
    """For each suggestion the newest feedback issue of its (query, rank, text), else the newest suspicious one."""
    key = ["query_text", "result_rank", "listing_text"]
    newest = lambda df, name: df.groupBy(*key).agg(F.max("id").alias(name))
    out = suggestions.join(newest(feedback, "fb"), key, "left").join(newest(suspicious, "sus"), key, "left")
    return out.withColumns(
        {"issue_type": F.when(F.col("fb").isNotNull(), "feedback").when(F.col("sus").isNotNull(), "suspicious"), "issue_id": F.coalesce("fb", "sus")}
    ).drop("fb", "sus")


def snapshot_asof(log: DataFrame, snapshots: DataFrame, minutes: int = 30) -> DataFrame:
    """For each logged query the latest snapshot of its key that is alive at its time; null is a miss.

    Both sides meet in time slots of the snapshots' lifetime: a live snapshot lies in the query's slot or the one before.
    """
    slot = lambda c: F.floor(F.unix_timestamp(c) / (minutes * 60))
    left = log.withColumn("slot", F.explode(F.array(slot("ts"), slot("ts") - 1)))
    right = snapshots.select(F.col("cache_key"), "snapshot_id", "created_at", "expires_at", slot("created_at").alias("slot"))
    live = (F.col("created_at") <= F.col("ts")) & (F.col("ts") < F.col("expires_at"))
    hit = left.join(right, ["cache_key", "slot"]).where(live)
    hit = hit.groupBy("event_id").agg(F.max_by("snapshot_id", F.struct("created_at", "snapshot_id")).alias("snapshot_id"))
    return log.join(hit, "event_id", "left")


def resolve_reference(refs: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored result of each reference: by result id, else stable id, else (query, rank); the most recently used one."""
    pick = lambda *key: stored.groupBy(*key).agg(F.max_by("row_id", F.struct("last_used", "row_id")).alias("r_" + "_".join(key)))
    out = refs.join(pick("result_id"), "result_id", "left").join(pick("stable_id"), "stable_id", "left").join(pick("query_text", "result_rank"), ["query_text", "result_rank"], "left")
    return out.withColumn("row_id", F.coalesce("r_result_id", "r_stable_id", "r_query_text_result_rank")).drop("r_result_id", "r_stable_id", "r_query_text_result_rank")


def query_result_facts(ranked: DataFrame, listings: DataFrame | None = None, key: list[str] = []) -> DataFrame:
    """Bridge (query_id, listing_key, rank) from ranked rows and the stored listings' keys, unless the rows carry theirs."""
    rows = ranked if listings is None else ranked.join(listings.select(*key, "listing_key"), key)
    return rows.select("query_id", "listing_key", "rank")


def pack_snapshot(ranked: DataFrame, query: str = "query_id") -> DataFrame:
    """A query's ranked results as one JSON text, in order of rank."""
    row = F.struct("rank", "listing_id", "listing_text")
    return ranked.groupBy(query).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("results"), F.count("*").alias("result_count"))


def unpack_snapshot(packed: DataFrame, query: str = "query_id") -> DataFrame:
    """Rows of pack_snapshot's JSON; wrongly typed values become null."""
    rows = F.from_json("results", "array<struct<rank:int,listing_id:string,listing_text:string>>")
    return packed.select(query, F.explode(rows).alias("r")).select(query, "r.*")


def refine_quota(rows: DataFrame, eligible, n: int = 3) -> DataFrame:
    """First n eligible rows of each query."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return rows.where(eligible).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
