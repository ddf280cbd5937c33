"""Structured Streaming jobs over event and listing streams, and their batch twins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def event_stream(spark: SparkSession, path: str, schema: str | None = None, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, so many files for each micro-batch."""
    return spark.readStream.schema(schema or spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def write_arrivals(rows: DataFrame, time: str, path: str, slices: int = 4, files: int = 4) -> None:
    """Write rows as arrivals: slices of about equal size in order of time, each of at most ``files`` files; null times come last.

    Streams that read so many files for each micro-batch see one slice after the other. Only the bounds of the slices reach the driver.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    shares = [(i + 1) / slices for i in range(slices - 1)]
    bounds = rows.agg(F.percentile_approx(at, shares, F.lit(10_000))).first()[0] or []
    number = sum(((at > b).cast("int") for b in bounds), F.lit(0))
    rows = rows.withColumn("__slice", F.coalesce(number, F.lit(slices - 1)))
    for i in range(slices):
        rows.where(F.col("__slice") == i).drop("__slice").repartition(files).write.mode("append").parquet(path)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what has arrived into Parquet files and read them; a restart from the checkpoint goes on from there."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_updates(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Run a stream in update mode, each micro-batch's changed rows a folder of its own, and read the newest row of each key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:09d}")  # a retried batch overwrites itself

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    log = stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(path)
    values = [c for c in stream.columns if c not in keys]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r"))
    return newest.select(*keys, *[f"r.{c}" for c in values])


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its result table (for tests and small catch-up jobs)."""
    stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def stream_dedupe_listings(listings: DataFrame, delay: str = "3 days") -> DataFrame:
    """First arrival of each normalised (text, seller, date) within the watermark."""
    key = F.concat_ws("|", T.normalize_text("listing_text"), T.normalize_text("seller"), F.col("posted_date").cast("string"))
    return listings.withColumn("dedupe_key", key).withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["dedupe_key"])


def stream_latest(rows: DataFrame, key: list[str], time: str, value: str) -> DataFrame:
    """Newest value of each key with its first and last time (update mode)."""
    return rows.groupBy(*key).agg(F.max_by(value, time).alias(value), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))


def stream_quality_windows(events: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts and error rate of tumbling windows; events later than the watermark are left out."""
    out = events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w")).agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")
    )
    return out.select(F.col("w.start").alias("window_start"), "n", "errors", (F.col("errors") / F.col("n")).alias("error_rate"))


class RateLimiter(StatefulProcessor):
    """At most ``limit`` accepted events of a key within ``per`` seconds; then the key is blocked for ``block`` seconds.

    Rejected events leave no trace in the count. Events of a micro-batch are taken in order of time.
    """

    def __init__(self, limit: int, per: int, block: int):
        self.limit, self.per, self.block = limit, per, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getListState("accepted", "at double")
        self.blocked = handle.getValueState("blocked", "until double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        past = [r[0] for r in self.accepted.get()]
        until = self.blocked.get()[0] if self.blocked.exists() else float("-inf")
        decide = limiter(past, until, self.limit, self.per, self.block)
        events["accepted"] = [decide(t.timestamp()) for t in events.ts]
        past, until = decide.state()
        self.accepted.put([(t,) for t in past]) if past else self.accepted.clear()
        self.blocked.update((until,))
        yield events[["event_id", "accepted"]].assign(key=key[0])[["key", "event_id", "accepted"]]

    def close(self) -> None:
        pass


def limiter(past: list[float], until: float, limit: int, per: int, block: int) -> Callable:
    """The rule of one key: called with a time in order, says whether the event is accepted."""
    held = {"past": list(past), "until": until}

    def decide(t: float) -> bool:
        if t < held["until"]:
            return False
        held["past"] = [x for x in held["past"] if x > t - per]
        if len(held["past"]) >= limit:
            held["until"] = t + block
            return False
        held["past"].append(t)
        return True

    decide.state = lambda: (held["past"], held["until"])
    return decide


def stream_rate_limit(events: DataFrame, key: str = "user_id", limit: int = 60, per: int = 60, block: int = 120) -> DataFrame:
    return events.groupBy(key).transformWithStateInPandas(
        RateLimiter(limit, per, block), "key long, event_id long, accepted boolean", "append", "none"
    )


def _quiet_runs(events: DataFrame, key: str, reset: int, grain: int = 64) -> DataFrame:
    """Rows (key, event_id, at, run) dealt by (key, run) and sorted in time: at in microseconds, run numbers the stretches
    of a key between pauses of at least ``reset`` seconds, over which no rule carries its state.

    Pauses are looked for between the stretches of ``grain * reset`` seconds that have events, one row each, so finding
    them costs a key a row for each stretch of time and not for each event. A busy key is cut wherever it pauses there.
    """
    rows = events.select(F.col(key).alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    rows = rows.withColumn("slot", F.floor(F.col("at") / (grain * reset * 1_000_000)))
    slots = rows.groupBy("key", "slot").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    order = Window.partitionBy("key").orderBy("slot")
    fresh = F.coalesce(F.col("first") - F.lag("last").over(order) >= reset * 1_000_000, F.lit(True)).cast("int")
    runs = slots.withColumn("fresh", fresh).select(F.col("key").alias("k"), F.col("slot").alias("s"), F.sum("fresh").over(order).alias("run"))
    out = rows.join(runs, F.col("key").eqNullSafe(F.col("k")) & F.col("slot").eqNullSafe(F.col("s"))).select("key", "event_id", "at", "run")
    return out.repartition("key", "run").sortWithinPartitions("key", "run", "at", "event_id")


def _by_runs(runs: DataFrame, start: Callable, column: str) -> DataFrame:
    """(key, event_id, column) by a rule over sorted runs; start() gives a run's rule, which maps the times of each batch.

    Only the rule's state lives from batch to batch, so a run of any length needs a batch's memory. Events without a
    time are refused and leave no trace.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rule = None, None
        for batch in batches:
            keys, at, run = (batch.column(c).fill_null(0).to_numpy() for c in ("key", "at", "run"))
            null, timed = batch.column("key").is_null().to_numpy(zero_copy_only=False), batch.column("at").is_valid().to_numpy(zero_copy_only=False)
            verdict = np.zeros(len(run), bool)
            other = (run[1:] != run[:-1]) | (null[1:] != null[:-1]) | (keys[1:] != keys[:-1])
            cuts = [0, *(np.flatnonzero(other) + 1).tolist(), len(run)]
            for a, b in pairwise(cuts):
                if a == b:
                    continue
                if (here := (null[a], keys[a], run[a])) != current:
                    current, rule = here, start()
                if timed[a]:  # events without a time share a run of their own
                    verdict[a:b] = rule(at[a:b])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("event_id"), pa.array(verdict)], ["key", "event_id", column])

    return runs.mapInArrow(work, f"key long, event_id long, {column} boolean")


def batch_rate_limit(events: DataFrame, key: str = "user_id", limit: int = 60, per: int = 60, block: int = 120) -> DataFrame:
    """(key, event_id, accepted): batch twin of stream_rate_limit over a whole table.

    A pause of the longer of ``per`` and ``block`` clears a key's state. A null key is a key; a repeated row counts again;
    events without a time are rejected; ties in time go by event_id. An empty table gives no rows.
    """

    def start() -> Callable:
        decide = limiter([], float("-inf"), limit, per * 1_000_000, block * 1_000_000)
        return lambda times: [decide(t) for t in times.tolist()]

    return _by_runs(_quiet_runs(events, key, max(per, block)), start, "accepted")


class Throttle(StatefulProcessor):
    """First event of a key passes and closes the key for ``gap`` seconds (from the event that passed)."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        last, passed = (self.last.get()[0] if self.last.exists() else float("-inf")), []
        for t in events.ts:
            ok = t.timestamp() >= last + self.gap
            last = t.timestamp() if ok else last
            passed.append(ok)
        self.last.update((last,))
        yield pd.DataFrame({"key": key[0], "event_id": events.event_id, "passed": passed})

    def close(self) -> None:
        pass


def stream_alert_throttle(errors: DataFrame, key: str = "user_id", gap: int = 1800) -> DataFrame:
    """One alert for each key in ``gap`` seconds."""
    return errors.groupBy(key).transformWithStateInPandas(Throttle(gap), "key long, event_id long, passed boolean", "append", "none")


def batch_throttle(errors: DataFrame, key: str = "user_id", gap: int = 1800) -> DataFrame:
    """(key, event_id, passed): batch twin of the throttle and of repeat detection: an event passes if none passed in the gap before it.

    A null key is a key; of events at one time the smallest event_id may pass; events without a time don't pass.
    """

    def start() -> Callable:
        free = [np.iinfo(np.int64).min]  # from when on the next event passes

        def rule(times: np.ndarray) -> np.ndarray:
            passed, at = np.zeros(len(times), bool), int(np.searchsorted(times, free[0]))
            while at < len(times):
                passed[at] = True
                free[0] = int(times[at]) + gap * 1_000_000
                at = max(at + 1, int(np.searchsorted(times, free[0])))
            return passed

        return rule

    return _by_runs(_quiet_runs(errors, key, gap), start, "passed")


def stream_repeat_queries(queries: DataFrame, key: str = "user_id", ttl: int = 1800) -> DataFrame:
    """First event of a key is searched and opens its lifetime, later ones inside it are served; reads don't extend it."""
    out = queries.groupBy(key).transformWithStateInPandas(Throttle(ttl), "key long, event_id long, passed boolean", "append", "none")
    return out.select("key", "event_id", (~F.col("passed")).alias("served"))


def stream_feedback(reports: DataFrame, path: str, checkpoint: str):
    """Write each micro-batch of reports as a folder of its own (a retried batch overwrites itself); readers merge by key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return reports.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
