"""Registered queries of sources and sinks: each writes or shapes rows of the tables and reads them back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import intent as N
from ..sources import posts as P
from ..sources.shared import scratch
from ..sources.views import view
from .queries import listings, query, table


@query("SELECT DISTINCT listing_text, seller, strftime(posted_date, '%B %-d, %Y') AS posted_date, '/flash-sales/' || substr(source_url, 10) AS source_url, image_url FROM listings_v", "listings_v")
def s1_json_listings(s, d):
    item = F.struct(
        F.col("listing_text").alias("title"), F.col("seller").alias("companyName"), F.expr("cast(substr(source_url, 10) AS bigint)").alias("number"),
        F.col("posted_date").cast("string").alias("createdOn"), F.col("image_url").alias("imageUrl"),
    )
    raw = listings(s, d).select(F.col("listing_id").alias("page_id"), F.to_json(F.struct(F.array(item).alias("listings"))).alias("body"))
    return P.listings_from_json(raw).select("listing_text", "seller", "posted_date", "source_url", "image_url").distinct()


@query("SELECT CAST(p_partkey AS VARCHAR) AS page_id, p_name AS listing_text FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_brand || ' ' || p_type FROM part")
def s2_nested_listings(s, d):
    nested = F.array(F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("title")), F.struct(F.lit(None).cast("string").alias("brand"), F.col("p_name").alias("title")))
    item = F.struct(F.col("p_name").alias("title"), F.col("p_partkey").alias("number"), nested.alias("listings"))
    raw = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("page_id"), F.to_json(F.array(item)).alias("body"))
    return P.explode_nested(P.listings_from_json(raw)).select("page_id", "listing_text")


@query("SELECT DISTINCT lower(query_text) AS query_text FROM queries_v", "queries_v")
def s5_query_list(s, d):
    path = scratch(s, "query-list")
    q = view(s, d, "queries_v")
    q.select(F.concat(F.lit("# note\n\n  "), F.regexp_replace("query_text", " ", "  "), F.lit(" \n"), F.upper("query_text")).alias("value")).write.text(path)
    return P.read_query_list(s, path).select(F.lower("query_text").alias("query_text"))


@query("SELECT query, stage, count(*) AS n, count(fuzzy_score) AS scored FROM audit_v GROUP BY query, stage", "audit_v")
def s6_audit_artifacts(s, d):
    path = scratch(s, "audit-lines")
    ev = view(s, d, "audit_v")
    P.write_audit_jsonl(ev.limit(0).select("query", "stage"), ev.select("query", "stage", "has_image", "fuzzy_score", "scope_reason"), ev.limit(0).select("query", "stage"), path)
    return P.read_audit_artifacts(s, [path]).groupBy("query", "stage").agg(F.count("*").alias("n"), F.count("fuzzy_score").alias("scored"))


@query("SELECT event_id, event_type FROM events")
def s7_read_store(s, d):
    return P.read_store(s, f"{d}/events.parquet").select("event_id", "event_type")


@query("SELECT listing_id, listing_text, coalesce(image_url, '') AS image_url FROM listings_v", "listings_v")
def s8_results_csv(s, d):
    path = scratch(s, "results-csv")
    P.write_results_csv(listings(s, d).withColumn("rank", F.lit(1)), path)
    back = s.read.option("header", True).option("escape", '"').option("quote", '"').option("emptyValue", "").schema("rank string, listing_id string, listing_text string, seller string, posted_date string, image_url string, source_url string").csv(path)
    return back.select("listing_id", "listing_text", F.coalesce("image_url", F.lit("")).alias("image_url"))


@query("SELECT stage, count(*) AS n FROM audit_v GROUP BY stage", "audit_v")
def s9_results_json(s, d):
    path = scratch(s, "results-json")
    ev = view(s, d, "audit_v").select("query", "stage", "fuzzy_score")
    P.write_audit_jsonl(ev.where("stage = 'parsed'"), ev.where("stage NOT IN ('parsed', 'final')"), ev.where("stage = 'final'"), path)
    return s.read.schema("query string, stage string").json(path).groupBy("stage").agg(F.count("*").alias("n"))


@query("SELECT event_id, 'user_' || substr(query, 6) || '_' || event_id AS case_name FROM audit_v WHERE stage = 'weak_match' OR fuzzy_score < 10", "audit_v")
def s11_cases_from_audit(s, d):
    rows = view(s, d, "audit_v").select("event_id", "query", F.col("event_id").alias("rank"), (F.col("fuzzy_score") < 10).cast("int").alias("quality_group"), F.when(F.col("stage") == "weak_match", F.array(F.lit("suspicious.weak"))).alias("reason_codes"))
    return P.regression_cases_from_audit(rows).select("event_id", "case_name")


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'fixed ' || id WHEN reason = 'ends_with_currency' THEN 'raw ' || listing_text ELSE listing_text END AS expected FROM suspicious_v", "suspicious_v")
def s12_cases_from_issues(s, d):
    rows = view(s, d, "suspicious_v").withColumns({"expected_text": F.when(F.col("id") % 5 == 0, F.concat(F.lit("fixed "), F.col("id").cast("string"))), "raw_listing_text": F.concat(F.lit("raw "), "listing_text")})
    return P.regression_cases_from_issues(rows).select("id", "expected")


@query("SELECT query, total_count, cache_hit, 'b' || run_number AS branch, elapsed_ms AS ms FROM bench_v", "bench_v")
def s13_runs_from_payloads(s, d):
    body = F.struct("query", "total_count", "cache_hit", F.struct(F.array(F.struct(F.concat(F.lit("b"), F.col("run_number").cast("string")).alias("branch"), F.col("elapsed_ms").alias("ms"))).alias("retrieval_timings")).alias("diagnostics"))
    raw = view(s, d, "bench_v").select(F.to_json(body).alias("payload"))
    return P.runs_from_payloads(raw).select("query", "total_count", "cache_hit", "branch", "ms")


@query("SELECT listing_id, listing_text, seller FROM listings_v WHERE listing_text LIKE '%blue%'", "listings_v")
def p31_result_view(s, d):
    """Rows as shown: without raw text and identifiers of the parent."""
    return listings(s, d).where(T.normalize_text("listing_text").contains("blue")).drop("rank_in", "posted_date", "image_url", "source_url")


@query("SELECT listing_id, upper(listing_text) AS refined_text FROM listings_v WHERE listing_text LIKE '%red%' AND listing_text NOT LIKE '%HKD%'", "listings_v")
def x1_refine_with(s, d):
    """A user's function over the rows without price evidence; half of them come from the cache of refinements."""
    rows = listings(s, d).where(F.col("listing_text").contains("red") & ~E.has_price("listing_text")).select("listing_id", "listing_text")
    cached = rows.where(F.col("listing_id") < "8").select("listing_id", F.upper("listing_text").alias("refined_text"))

    def shout(frames):
        for frame in frames:
            assert isinstance(frame, pd.DataFrame)
            yield frame.assign(refined_text=frame.listing_text.str.upper())

    return N.refine_with(rows, cached, shout, ["listing_id"]).select("listing_id", "refined_text")
