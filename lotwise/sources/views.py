"""Fixture views over the driver's tables, in Spark SQL and, where they differ, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "listings_v": ("lineitem", "part", "supplier"), "queries_v": ("part",), "audit_v": ("events",), "feedback_v": ("events",),
    "suspicious_v": ("events",), "bench_v": ("events",), "snapshots_v": ("events",), "bundles_v": ("lineitem", "part", "supplier"),
}

SPARK = {
    "listings_v": """
SELECT md5(CAST(l_orderkey AS STRING)||'-'||CAST(l_linenumber AS STRING)||'-'||CAST(l_partkey AS STRING)||'-'||CAST(l_suppkey AS STRING)||'-'||CAST(CAST(round(l_extendedprice*100) AS BIGINT) AS STRING)) AS listing_id,
       p_brand||' '||lpad(CAST(l_partkey AS STRING),5,'0')||substr(p_type,1,2)||' '||p_name||' '||CASE l_returnflag WHEN 'A' THEN 'new' WHEN 'N' THEN 'used' ELSE 'full set' END||' '||CAST(year(l_shipdate) AS STRING)||CASE WHEN l_linestatus='F' THEN ' HKD '||CAST(CAST(floor(l_extendedprice/10000) AS BIGINT)*10000+10000 AS STRING) ELSE '' END AS listing_text,
       s_name AS seller, CAST(l_shipdate AS DATE) AS posted_date,
       CASE WHEN l_linenumber%3=0 THEN NULL ELSE 'https://img.example/'||CAST(l_partkey AS STRING)||'.jpg' END AS image_url,
       '/listing/'||CAST(l_orderkey AS STRING) AS source_url
FROM {lineitem} JOIN {part} ON l_partkey=p_partkey JOIN {supplier} ON l_suppkey=s_suppkey""",
    "queries_v": """
SELECT p_partkey AS query_id,
       CASE WHEN p_partkey%110=0 THEN 'WTB ' ELSE '' END || lpad(CAST(p_partkey AS STRING),5,'0') || substr(p_type,1,2)
       || ' ' || CASE WHEN p_partkey%30=0 THEN 'blue' WHEN p_partkey%70=0 THEN split_part(p_name,' ',2) ELSE split_part(p_name,' ',1) END
       || CASE WHEN p_partkey%50=0 THEN ' 1997' ELSE '' END AS query_text
FROM {part} WHERE p_partkey%10=0""",
    "audit_v": """
SELECT event_id, ts, 'user '||CAST(user_id AS STRING) AS query,
       CASE event_type WHEN 'view' THEN 'parsed' WHEN 'click' THEN 'matched' WHEN 'error' THEN 'weak_match' WHEN 'signup' THEN 'dedupe_drop' ELSE 'final' END AS stage,
       event_id%3<>0 AS has_image, CAST(floor(value) AS INT)%100 AS fuzzy_score,
       CASE WHEN event_id%5=0 THEN 'scope.stock_list' ELSE 'scope.full_listing' END AS scope_reason FROM {events}""",
    "feedback_v": """
SELECT event_id AS report_id, ts AS reported_at, 'user '||CAST(user_id%40 AS STRING) AS query_text, CAST(event_id%5 AS INT)+1 AS result_rank,
       CASE event_type WHEN 'error' THEN 'wrong_result' WHEN 'view' THEN 'missing_info' ELSE 'other' END AS reason,
       CASE WHEN event_id%4=0 THEN NULL ELSE user_id END AS reporter_id, 'item '||CAST(user_id%7 AS STRING) AS listing_text,
       CASE WHEN event_id%3=0 THEN NULL ELSE 'note '||CAST(event_id AS STRING) END AS notes FROM {events}""",
    "suspicious_v": """
SELECT event_id AS id, ts AS found_at, 'user '||CAST(user_id%40 AS STRING) AS query_text, CAST(event_id%5 AS INT)+1 AS result_rank,
       CASE event_type WHEN 'error' THEN 'ends_with_currency' WHEN 'view' THEN 'raw_much_longer' ELSE 'missing_price_evidence' END AS reason,
       CASE event_type WHEN 'error' THEN 3 WHEN 'view' THEN 2 ELSE 1 END AS severity, 'item '||CAST(user_id%7 AS STRING) AS listing_text,
       CASE WHEN event_id%11=0 THEN 'ignored' WHEN event_id%13=0 THEN 'fixed' ELSE 'open' END AS issue_status FROM {events}""",
    "bench_v": """
SELECT event_id, 'user '||CAST(user_id%20 AS STRING) AS canonical_query, 'spelling '||CAST(user_id AS STRING) AS query, CAST(event_id%3 AS INT)+1 AS run_number,
       CAST(floor(value*100) AS BIGINT) AS elapsed_ms, event_type<>'error' AS ok, event_type='view' AS cache_hit, 100+CAST(user_id%15 AS INT) AS total_count FROM {events}""",
    "snapshots_v": """
SELECT event_id AS snapshot_id, 'user '||CAST(user_id AS STRING) AS cache_key, ts AS created_at, ts + INTERVAL 30 MINUTE AS expires_at,
       CAST(event_id%50 AS INT) AS result_count FROM {events} WHERE event_type='purchase'""",
    "bundles_v": """
SELECT seller || '-' || CAST(posted_date AS STRING) AS bundle_id, seller, posted_date, count(*) AS n_items,
       'HK STOCK LIST ' || listagg(listing_text,' | ') WITHIN GROUP (ORDER BY listing_id) AS raw_listing_text
FROM {listings_v} GROUP BY seller, posted_date HAVING count(*)>=2""",
}


def spread(df: DataFrame, least: int = 1 << 20, deals: int = 4) -> DataFrame:
    """A scan of least bytes or more that has fewer than deals splits for each of the cluster's cores, dealt to all of them.

    Text rules cost far more than reading, a file of one row group is one split, and large row groups leave most splits of
    a file empty. Scans of many splits stay as they are.
    """
    tasks = deals * df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < least or df.rdd.getNumPartitions() >= tasks:
        return df
    return df.repartition(tasks)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame; its tables are bound by name for this one query only."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    if "lineitem" in frames:
        frames["lineitem"] = spread(frames["lineitem"])
    if name == "queries_v":
        frames["part"] = spread(frames["part"], 1 << 16)
    if name == "bundles_v":
        frames = {"listings_v": view(spark, sf_dir, "listings_v")}
    return spark.sql(SPARK[name], **frames)


def duck(*names: str) -> str:
    """WITH clause that defines the views for DuckDB."""
    wanted = [n for n in SPARK if n in names or (n == "listings_v" and "bundles_v" in names)]
    text = {n: SPARK[n].replace("listagg(listing_text,' | ') WITHIN GROUP (ORDER BY listing_id)", "string_agg(listing_text,' | ' ORDER BY listing_id)") for n in wanted}
    tables = {t: t for t in ("lineitem", "part", "supplier", "events", "listings_v")}
    return "WITH " + ",\n".join(f"{n} AS ({text[n].format(**tables)})" for n in wanted)
