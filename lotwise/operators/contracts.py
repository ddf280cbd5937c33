"""Contracts of search results: rules on a search, on each result, and between both, as rows of one violation table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTS = ["raw_candidate_count", "parsed_count", "matched_count", "unique_latest_count", "unique_text_count", "deduped_drop_count", "weak_match_count", "final_count"]


def _rows(df: DataFrame, item: Column, rules: dict[str, Column]) -> DataFrame:
    """(query_id, item, rule) of every rule whose test holds; a null test doesn't."""
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return df.select("query_id", item.cast("int").alias("item"), F.explode_outer(broken).alias("rule")).where("rule IS NOT NULL")


def search_violations(searches: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, item, rule) of everything that searches and their results break; item is null for rules on the search.

    searches: query_id, query, total_count, offset, limit, result_count, has_more, next_offset, cache_hit and those of
    COUNTS that they have, one row a search; results: query_id, item (from 0), result_id, stable_listing_id, rank,
    listing_text, source_url. Rows are counted by search before they are joined, and ids compared within (search, id).
    Results of no search break no rule but their own.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    negative = lambda c: F.col(c).isNull() | (F.col(c) < 0)
    held = results.groupBy("query_id").agg(F.count("*").alias("__rows"))
    q = searches.join(held, "query_id", "left").withColumn("__rows", F.coalesce("__rows", F.lit(0)))
    more = F.coalesce("has_more", F.lit(False))
    rules = {
        "query.required": blank("query"), "total_count.non_negative": negative("total_count"), "offset.non_negative": negative("offset"), "limit.positive": F.col("limit") <= 0,
        "result_count.non_negative": negative("result_count"), "has_more.boolean": F.col("has_more").isNull(), "next_offset.required": more & negative("next_offset"),
        "next_offset.null": ~more & F.col("next_offset").isNotNull(), "result_count.equals_rows": F.col("result_count") != F.col("__rows"), "results.empty": F.col("__rows") == 0,
        "final_count.within_matched": ~F.coalesce("cache_hit", F.lit(False)) & (F.col("final_count") > F.col("matched_count")),
    } | {f"{c}.non_negative": F.col(c) < 0 for c in COUNTS if c in searches.columns}
    of_search = _rows(q, F.lit(None), rules)

    again = F.row_number().over(Window.partitionBy("query_id", "result_id").orderBy("item")) > 1
    url = F.trim(F.coalesce("source_url", F.lit("")))
    of_result = {
        "result_id.required": blank("result_id"), "result_id.unique": ~blank("result_id") & F.col("__again"), "stable_listing_id.required": blank("stable_listing_id"),
        "rank.positive": F.col("rank").isNull() | (F.col("rank") <= 0), "listing_text.required": blank("listing_text"),
        "source_url.http_or_relative": (url != "") & ~url.rlike("(?i)^(https?://[^/ ]+|/(?!/))"),
    }
    return of_search.unionByName(_rows(results.withColumn("__again", again), F.col("item"), of_result))
