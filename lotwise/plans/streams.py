"""Registered queries that run as streams: events arrive in slices, with late and repeated rows among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.shared import scratch
from ..streaming import jobs as J
from .queries import query, table

_FILES = 4


def arrivals(s, d):
    """A stream of all events: four slices in order of time, repeats of every seventh row beside it, then late copies of
    the first slice's every ninth row with one row of a much later time, which closes what is open."""
    events = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch(s, "arrivals")
    J.write_arrivals(events.unionByName(events.where("event_id % 7 = 0")), "ts", path, 4, _FILES)
    bounds = events.agg(F.percentile_approx(F.unix_micros("ts"), 0.2).alias("early"), F.max("ts").alias("last")).first()
    late = events.where((F.unix_micros("ts") < bounds["early"]) & (F.col("event_id") % 9 == 0))
    closing = events.limit(1).select(F.lit(-1).cast("long").alias("event_id"), (F.lit(bounds["last"]) + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("closing").alias("event_type"), F.lit(0.0).alias("value"))
    rows = late.select(closing.columns).unionByName(closing.select(*[F.col(c).cast(late.schema[c].dataType) for c in closing.columns]))
    rows.repartition(_FILES).write.mode("append").parquet(path)
    return J.event_stream(s, path, files=_FILES)


@query("SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'error') / count(*) AS error_rate FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 7 = 0) GROUP BY 1")
def t3_quality_windows(s, d):
    """Hourly windows written when their watermark has passed; late rows are left out, repeats count."""
    stream = J.stream_quality_windows(arrivals(s, d))
    return J.run_to_parquet(stream, scratch(s, "windows"), scratch(s, "windows-state"))


@query("SELECT user_id, max_by(event_type, ts) AS event_type, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY user_id")
def t2_latest(s, d):
    """Newest event of each user; a batch writes the users that it changed."""
    stream = J.stream_latest(arrivals(s, d).where("user_id >= 0"), ["user_id"], "ts", "event_type")
    return J.run_updates(stream, ["user_id"], scratch(s, "latest"), scratch(s, "latest-state"))


@query("SELECT DISTINCT event_type AS listing_text, CAST(user_id AS VARCHAR) AS seller, CAST(CAST(ts AS DATE) AS VARCHAR) AS posted_date FROM events")
def t1_dedupe_arrivals(s, d):
    """Each listing (text, seller, day) once, by its first arrival; repeats meet the state, late copies the watermark."""
    rows = arrivals(s, d).where("user_id >= 0 OR event_type = 'closing'")
    rows = rows.select(F.col("ts").alias("seen_at"), F.col("event_type").alias("listing_text"), F.col("user_id").cast("string").alias("seller"), F.to_date("ts").cast("string").alias("posted_date"))
    stream = J.stream_dedupe_listings(rows).select("listing_text", "seller", "posted_date")
    return J.run_to_parquet(stream, scratch(s, "dedupe"), scratch(s, "dedupe-state")).where("seller <> '-1'")
