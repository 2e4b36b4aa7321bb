"""Request accounting and catalogue updates as streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from motorfisc.operators import accounting, tax, upsert
from motorfisc.sources import versions

#: How late an event may come; later ones are dropped.
WATERMARK = "1 hour"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream over its file, with a timestamp that a watermark can stand on."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
    return files.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", WATERMARK)


def daily_paid(events: DataFrame, paid: str = "purchase", cap: int = accounting.DAY_CAP) -> DataFrame:
    """Paid calls of each day so far, and whether the cap is reached."""
    days = events.where(F.col("event_type") == paid).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("used"))
    return days.select(F.to_date("w.start").alias("day"), "used", (F.col("used") >= cap).alias("capped"))


def _micros(batches: Iterator[pd.DataFrame], *names: str) -> list[np.ndarray]:
    parts = list(batches)
    if not parts:
        return [np.zeros(0, dtype=np.int64) for _ in names]
    return [np.concatenate([p[n].to_numpy(dtype=np.int64) for p in parts]) for n in names]


def _due(state: GroupState, pending: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Times and ids up to the watermark, in order, and the rest: nothing can come before those any more."""
    order = np.lexsort((ids, pending))
    pending, ids = pending[order], ids[order]
    at = int(np.searchsorted(pending, state.getCurrentWatermarkMs() * 1000, "right"))
    return pending[:at], ids[:at], pending[at:], ids[at:]


def _wake(state: GroupState, micros: int) -> None:
    """Calls the client up when the watermark has passed a time."""
    state.setTimeoutTimestamp(max(micros // 1000, state.getCurrentWatermarkMs() + 1))


#: Times that a client's state keeps of events whose counts are out: one more than a day's quota.
KEPT = accounting.DAY_LIMIT + 1
_HOUR, _DAY = 3600 * 1_000_000, 86400 * 1_000_000


def _quotas(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    kept, pending, ids = (np.array(x, dtype=np.int64) for x in (state.get if state.exists else ([], [], [])))
    times, new = _micros(batches, "micros", "event_id")
    due, due_ids, pending, ids = _due(state, np.concatenate([pending, times]), np.concatenate([ids, new]))
    known = np.concatenate([kept, due])
    upto = np.searchsorted(known, due, "right")
    hour, day = (np.minimum(upto - np.searchsorted(known, due - span, "left"), KEPT) for span in (_HOUR, _DAY))
    alive = state.getCurrentWatermarkMs() * 1000 - _DAY
    kept = known[known >= alive][-KEPT:]
    if len(pending) or len(kept):
        state.update((kept.tolist(), pending.tolist(), ids.tolist()))
        _wake(state, int(pending[0]) if len(pending) else int(kept[-1]) + _DAY)
    else:
        state.remove()
    if len(due):
        yield pd.DataFrame({"client": key[0], "event_id": due_ids, "last_hour": hour, "last_day": day, "allowed": (hour <= accounting.HOUR_LIMIT) & (day <= accounting.DAY_LIMIT)})


def quotas(events: DataFrame, client: str = "user_id") -> DataFrame:
    """(client, event_id, last_hour, last_day, allowed) of every event of a stream, as ``accounting.rate_limits`` has them.

    An event is counted once the watermark has reached it, as until then an earlier one may come; so what comes out
    doesn't depend on how the events are split into batches, or on their order within the watermark's delay. Counts
    above KEPT are told as KEPT, which is over both quotas. A client's state is the times not yet due and the KEPT
    newest ones of the last day; it goes a day after the last event. Null clients are one client; events without a
    time or an event_id don't count.
    """
    timed = events.where("ts is not null and event_id is not null").select(F.col(client).cast("string").alias("client"), F.col("event_id").cast("long").alias("event_id"), F.unix_micros("ts").alias("micros"), "ts")
    found = timed.groupBy("client").applyInPandasWithState(_quotas, "client string, event_id long, last_hour long, last_day long, allowed boolean", "kept array<long>, pending array<long>, ids array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("client", F.col("client").cast(events.schema[client].dataType))


def _periods(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    paid_at, calls, pending = state.get if state.exists else (None, 0, [])
    (times,) = _micros(batches, "micros")
    waiting = np.concatenate([np.array(pending, dtype=np.int64), times])
    due, _, waiting, _ = _due(state, waiting, np.zeros(len(waiting), dtype=np.int64))
    ttl, out, at = accounting.TTL_SECONDS * 1_000_000, [], 0
    while True:
        if paid_at is not None:
            inside = int(np.searchsorted(due, paid_at + ttl, "left"))
            calls, at = calls + max(0, inside - at), max(at, inside)
            if at < len(due) or state.getCurrentWatermarkMs() * 1000 >= paid_at + ttl:
                out.append((paid_at, calls))
                paid_at, calls = None, 0
        if paid_at is not None or at == len(due):
            break
        paid_at, calls, at = int(due[at]), 1, at + 1
    if paid_at is not None or len(waiting):
        state.update((paid_at, calls, waiting.tolist()))
        _wake(state, min([int(w) for w in waiting[:1]] + ([paid_at + ttl] if paid_at is not None else [])))
    else:
        state.remove()
    if out:
        yield pd.DataFrame({"client": key[0], "micros": [p for p, _ in out], "calls": [n for _, n in out]})


def paid_periods(events: DataFrame, client: str = "user_id") -> DataFrame:
    """(client, paid_at, calls, hits): each paid call of a stream with the calls that the cache answers from it.

    A period is told when its time to live is over by the watermark; the periods of a client add up to what
    ``accounting.cache_hits`` counts. A client's state is the period at hand and the times not yet due, and goes with
    the period. Null clients are one client; events without a time don't count.
    """
    timed = events.where("ts is not null").select(F.col(client).cast("string").alias("client"), F.unix_micros("ts").alias("micros"), "ts")
    found = timed.groupBy("client").applyInPandasWithState(_periods, "client string, micros long, calls long", "paid_at long, calls long, pending array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("client").cast(events.schema[client].dataType).alias("client"), F.timestamp_micros("micros").alias("paid_at"), "calls", (F.col("calls") - 1).alias("hits"))


def upsert_sink(table_path: str, keys: list[str], keep: list[str], order: str, writer: str | None = None):
    """A foreachBatch function that puts rows into a table of versions by key, in any order of batches (see ``upsert.merged``).

    A batch is known by the query's id, which a checkpoint keeps, and its number: one that comes again changes nothing,
    one that fails leaves the table as it was, and a query under a new checkpoint goes on with the rows that are there.
    ``writer`` is for callers that aren't a query.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        by = writer or spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not by:
            raise ValueError("outside a streaming query the writer must be named")
        versions.commit(spark, table_path, lambda old: {"rows": upsert.merged(old("rows"), batch, keys, keep, order)}, by, number)

    return put


def outcome_sink(path: str):
    """A foreachBatch function that appends a batch's runs and listings, each batch under its own number."""

    def put(batch: DataFrame, number: int) -> None:
        runs, rows = upsert.split_outcomes(batch)
        runs.write.mode("overwrite").parquet(f"{path}/runs/batch={number}")
        rows.write.mode("overwrite").parquet(f"{path}/listings/batch={number}")

    return put


def priced_stream(offers: DataFrame) -> DataFrame:
    """Offers of a stream with their tax: the brackets are static and broadcast, so no state is kept."""
    return tax.tax_breakdown(offers)


def run_to_end(df: DataFrame, checkpoint: str, name: str | None = None, mode: str = "complete", sink=None) -> StreamingQuery:
    """Works off what there is, then ends; into a table in memory, or through ``sink`` batch by batch."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.foreachBatch(sink) if sink else writer.format("memory").queryName(name)).start()
    query.awaitTermination()
    return query
