"""Streams over files: late and repeated rows, null times, and restarts from a checkpoint."""

import datetime as dt

from pyspark.sql import functions as F

from lotwise.streaming import jobs as J

START = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def rows_of(spark, hours, first=0):
    return spark.createDataFrame([(first + i, None if h is None else START + dt.timedelta(hours=h), i % 3, "error" if i % 4 == 0 else "view", 0.0) for i, h in enumerate(hours)], SCHEMA)


def test_windows_go_on_after_a_restart(spark, tmp_path):
    path, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    run = lambda: J.run_to_parquet(J.stream_quality_windows(J.event_stream(spark, path, SCHEMA, files=2)), sink, state)
    J.write_arrivals(rows_of(spark, [h / 4 for h in range(80)]), "ts", path, slices=2, files=2)
    first = {r.window_start.hour: r.n for r in run().collect()}
    assert set(first.values()) == {4} and 10 < len(first) < 20
    rows_of(spark, [1, 1, 19.9, 40], 1000).repartition(2).write.mode("append").parquet(path)  # two late, one in an open window, one that closes it
    again = [(r.window_start, r.n) for r in run().collect()]
    assert len(again) == len({w for w, _ in again}) == 20 and sum(n for _, n in again) == 81
    assert len(run().collect()) == 20  # nothing new arrives, nothing is written twice


def test_latest_goes_on_after_a_restart(spark, tmp_path):
    path, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    stream = lambda: J.stream_latest(J.event_stream(spark, path, SCHEMA), ["user_id"], "ts", "event_id")
    rows_of(spark, [1, 2, 3]).coalesce(1).write.parquet(path)
    assert {r.user_id: r.event_id for r in J.run_updates(stream(), ["user_id"], sink, state).collect()} == {0: 0, 1: 1, 2: 2}
    rows_of(spark, [0, 9, None], 100).coalesce(1).write.mode("append").parquet(path)
    got = {r.user_id: (r.event_id, r.first_seen) for r in J.run_updates(stream(), ["user_id"], sink, state).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: 0, 1: 101, 2: 2}
    assert got[0][1] == J.run_updates(stream(), ["user_id"], sink, state).where("user_id = 0").first().first_seen


def test_dedupe_goes_on_after_a_restart(spark, tmp_path):
    path, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    shape = lambda df: df.select(F.col("ts").alias("seen_at"), F.col("event_type").alias("listing_text"), F.col("user_id").cast("string").alias("seller"), F.lit("x").alias("posted_date"))
    run = lambda: J.run_to_parquet(J.stream_dedupe_listings(shape(J.event_stream(spark, path, SCHEMA)), "3 days"), sink, state).count()
    rows_of(spark, [0, 1, 2, 3, 3, 3]).coalesce(1).write.parquet(path)
    assert run() == 5
    rows_of(spark, [4, 5, 6, 7, 8, 9]).coalesce(1).write.mode("append").parquet(path)
    assert run() == 5  # the keys stand in the state
    rows_of(spark, [500]).coalesce(1).write.mode("append").parquet(path)
    assert run() == 5  # still met by the state, which goes when the watermark has moved
    rows_of(spark, [501, 1, 501]).coalesce(1).write.mode("append").parquet(path)
    assert run() == 7  # two keys come again long after their state has gone; the late row doesn't


def test_arrivals_are_slices_in_order_of_time(spark, tmp_path):
    path = str(tmp_path / "in")
    J.write_arrivals(rows_of(spark, [5, 3, None, 1, 9, 7, 2, 8]), "ts", path, slices=3, files=2)
    back = spark.read.schema(SCHEMA).parquet(path)
    assert back.count() == 8 and back.where("ts IS NULL").count() == 1
    J.write_arrivals(rows_of(spark, [1]).limit(0), "ts", str(tmp_path / "none"), slices=3, files=2)
    assert spark.read.schema(SCHEMA).parquet(str(tmp_path / "none")).count() == 0
