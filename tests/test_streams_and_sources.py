"""Streams beside their batch twins, and literal cases of sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from lotwise.operators import intent as N
from lotwise.sources import posts as P
from lotwise.streaming import jobs as J


@pytest.fixture(scope="module")
def events(spark, tiny, tmp_path_factory):
    """The events of the smallest scale as three files in order of time."""
    folder = str(tmp_path_factory.mktemp("events"))
    rows = spark.read.parquet(f"{tiny}/events.parquet").limit(300).orderBy("ts").toPandas()
    for i in range(3):
        spark.createDataFrame(rows.iloc[i * 100 : i * 100 + 100]).coalesce(1).write.mode("append").parquet(folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return folder, spark.createDataFrame(rows)


def test_rate_limit_stream_equals_batch(spark, events, tmp_path):
    folder, table = events
    stream = J.stream_rate_limit(J.event_stream(spark, folder), limit=3, per=86_400, block=172_800)
    got = {(r.key, r.event_id, r.accepted) for r in J.run_once(stream, "limits", str(tmp_path / "c"), "append").collect()}
    want = {(r.key, r.event_id, r.accepted) for r in J.batch_rate_limit(table, limit=3, per=86_400, block=172_800).collect()}
    assert got == want and {a for *_, a in want} == {True, False}


def test_throttle_and_repeats_equal_batch(spark, events, tmp_path):
    folder, table = events
    got = {(r.event_id, r.passed) for r in J.run_once(J.stream_alert_throttle(J.event_stream(spark, folder), gap=86_400), "alerts", str(tmp_path / "a")).collect()}
    assert got == {(r.event_id, r.passed) for r in J.batch_throttle(table, gap=86_400).collect()}
    served = J.run_once(J.stream_repeat_queries(J.event_stream(spark, folder), ttl=86_400), "repeats", str(tmp_path / "b"))
    assert {(r.event_id, not r.served) for r in served.collect()} == got


def _naive(rows, start):
    """Rule by rule over each key's events, one after the other."""
    out = set()
    for key in {r[2] for r in rows}:
        rule = start()
        for t, i, _ in sorted(r for r in rows if r[2] == key and r[0] is not None):
            out.add((key, i, rule(t)))
        out |= {(key, i, False) for t, i, k in rows if k == key and t is None}
    return out


def _first_of(gap):
    free = [-1.0]

    def rule(t):
        if t < free[0]:
            return False
        free[0] = t + gap
        return True

    return rule


@pytest.mark.parametrize("batch", [7, 10_000])
def test_rules_over_a_busy_key_and_awkward_rows(spark, batch):
    """A third of all rows under one key with and without pauses, ties, null keys and times, large ids; batches smaller than a run."""
    hot = [(float(3 * i + 40_000 * (i // 150)), i, 1) for i in range(600)]
    rest = [(float(5000 * (i % 40) + i // 40), 1000 + i, 2 + i % 9) for i in range(900)]
    odd = [(50.0, 5001, None), (50.0, 5000, None), (9e5, (1 << 60) + 1, None), (None, 5003, None), (None, 5004, 1), (1e6, 5006, (1 << 60) + 1), (1e6, 5005, (1 << 60) + 1)]
    rows = hot + rest + odd
    table = spark.createDataFrame(rows, "t double, event_id long, user_id long").withColumn("ts", F.timestamp_seconds("t")).withColumn("key", F.lit("clash"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = [tuple(r) for r in J.batch_rate_limit(table, limit=4, per=60, block=120).collect()]
        assert len(got) == len(rows) and set(got) == _naive(rows, lambda: J.limiter([], float("-inf"), 4, 60, 120))
        got = [tuple(r) for r in J.batch_throttle(table, gap=100).collect()]
        assert len(got) == len(rows) and set(got) == _naive(rows, lambda: _first_of(100))
        assert J.batch_throttle(table.where("false")).count() == 0 and J.batch_rate_limit(table.where("false")).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_windows_and_latest(spark, events, tmp_path):
    folder, table = events
    got = J.run_once(J.stream_quality_windows(J.event_stream(spark, folder)), "windows", str(tmp_path / "w"))
    want = {(r.window_start, r.n, r.errors) for r in J.stream_quality_windows(table).collect()}
    rows = {(r.window_start, r.n, r.errors) for r in got.collect()}
    assert rows and rows <= want
    latest = J.run_once(J.stream_latest(J.event_stream(spark, folder), ["user_id"], "ts", "event_type"), "latest", str(tmp_path / "l"), "complete")
    assert {tuple(r) for r in latest.collect()} == {tuple(r) for r in J.stream_latest(table, ["user_id"], "ts", "event_type").collect()}


def test_dedupe_stream_keeps_each_key_once(spark, events, tmp_path):
    folder, table = events
    shape = lambda df: df.select(F.col("ts").alias("seen_at"), F.col("event_type").alias("listing_text"), F.col("user_id").cast("string").alias("seller"), F.lit("2026").alias("posted_date"))
    out = J.run_once(J.stream_dedupe_listings(shape(J.event_stream(spark, folder)), "400 days"), "dedupe", str(tmp_path / "d"))
    keys = [r.dedupe_key for r in out.collect()]
    assert len(keys) == len(set(keys)) == shape(table).select("listing_text", "seller").distinct().count()


def test_json_and_nested_listings(spark):
    item = {"title": "4408R Used 2012 - 81k usdt", "companyName": "Shop", "number": 7, "createdOn": "2026-06-02T01:02:03", "phoneNumber": "+852 9123 4567", "dialColor": "blue",
            "frontImage": "p.jpg", "listings": [{"title": "4408R Used 2012 - 81k usdt"}, {"title": "5711 new", "dialColor": "black"}, {"title": "5990", "dialColor": "Blue"}]}
    rows = [(1, json.dumps({"listings": [item, item, "text"]})), (2, "[not json"), (3, json.dumps([{"title": "a"}])), (4, None), (5, "plain")]
    items = P.listings_from_json(spark.createDataFrame(rows, "page_id int, body string"))
    got = {r.listing_text: r for r in items.collect()}
    first = got["4408R Used 2012 - 81k usdt"]
    assert (first.posted_date, first.source_url, first.seller_phone) == ("June 2, 2026", "/flash-sales/7", "85291234567") and "a" in got
    nested = {r.listing_text: r.image_url for r in P.explode_nested(items).where("nested_no >= 0").collect()}
    assert nested == {"black 5711 new": None, "Blue 5990": "p.jpg"}


def test_segments_of_a_stock_list(spark):
    text = "HK STOCK LIST • 828345 arabic 312k - 7408r new 2021 -> 97k; 9102/1B, used 2019 54k |  7408R n3/2020 900000usd"
    one, dull = "stocklist 5712 5712 blue", "828345 arabic 7408r new"
    df = spark.createDataFrame([(1, text), (2, one), (3, None), (4, dull), (5, "")], "bundle_id int, raw_listing_text string")
    rows = P.split_stock_lists(df).orderBy("bundle_id", "item_no").collect()
    parts = [r.listing_text for r in rows if r.bundle_id == 1]
    assert parts == ["828345 arabic 312k", "7408r new 2021 -> 97k", "9102/1B, used 2019 54k", "7408R n3/2020 900000usd"]
    assert [(r.listing_text, r.scope_reason) for r in rows if r.bundle_id != 1] == [(one, None), (None, None), (dull, None), ("", None)]
    assert {(r.scope_reason, tuple(r.reason_codes), r.raw_listing_text) for r in rows[:4]} == {("scope.stock_list", tuple(P.SEGMENT_CODES), text)}


def test_query_list_and_audit_files(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# a comment\n\n  Daytona   panda \ndaytona PANDA\n5711\n")
    got = [r.query_text for r in P.read_query_list(spark, str(tmp_path / "q.txt")).orderBy("line_no").collect()]
    assert got == ["Daytona panda", "5711"]
    (tmp_path / "a.jsonl").write_text(json.dumps({"type": "e", "query": "q", "stage": "final", "fuzzy_score": "bad"}) + "\n" + json.dumps({"query": "q", "final": [{"rank": 1}, {"rank": 2}]}) + "\n")
    stages = sorted(r.stage for r in P.read_audit_artifacts(spark, [str(tmp_path / "a.jsonl")]).collect() if r.stage)
    assert stages[-3:] == ["final_result", "final_result", "query_summary"]


def test_results_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 'say "5711"', "s", None, None, "/x")], "rank int, listing_id string, listing_text string, seller string, posted_date string, image_url string, source_url string")
    P.write_results_csv(rows, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part-*"))
    assert '"say ""5711"""' in text and text.count('"') % 2 == 0


def test_payloads_become_branch_rows(spark):
    body = {"query": "q", "total_count": "x", "cache_hit": True, "results": [{"listing_text": str(i)} for i in range(5)], "diagnostics": {"parsed": 3, "retrieval_timings": [{"branch": "b", "ms": 4}]}}
    r = P.runs_from_payloads(spark.createDataFrame([(json.dumps(body),), ("bad",)], "payload string")).where("query = 'q'").first()
    assert r.top_results == ["0", "1", "2"] and (r.branch, r.ms, r.parsed) == ("b", 4, 3)


def test_gates(spark):
    rows = spark.createDataFrame([("5711", "5711 blue", "x | 5711 blue"), ("5711", "5990", "x | 5711"), ("5711", None, "x")], "query_text string, suggested_text string, raw_listing_text string")
    assert [r.gate_status for r in N.gate_suggestions(rows).collect()] == ["accepted", "rejected", "rejected"]
    done = N.refine_with(rows.where("suggested_text IS NOT NULL"), rows.limit(0).selectExpr("query_text", "suggested_text", "'c' AS refined_text"), lambda it: (p.assign(refined_text=p.suggested_text.str.upper()) for p in it), ["query_text", "suggested_text"])
    assert sorted(r.refined_text for r in done.collect()) == ["5711 BLUE", "5990"]
