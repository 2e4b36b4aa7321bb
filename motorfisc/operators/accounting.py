"""Request accounting over an event log: budgets, trailing counts and a cache with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_CAP, HOUR_LIMIT, DAY_LIMIT, TTL_SECONDS = 200, 10, 30, 24 * 3600


def _seconds(ts: Column) -> Column:
    return ts.cast("timestamp").cast("double")


def daily_budget(events: DataFrame, paid: Column, cap: int = DAY_CAP) -> DataFrame:
    """Paid calls of each day, and what is left of the cap."""
    days = events.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(paid).alias("used"))
    return days.withColumn("remaining", F.greatest(F.lit(0), cap - F.col("used")))


def rate_limits(events: DataFrame, client: str = "user_id") -> DataFrame:
    """Events with the client's counts over the last hour and day (itself included) and whether it passes."""
    own = events.withColumn("_s", _seconds(F.col("ts")))
    last = lambda n: F.count(F.lit(1)).over(Window.partitionBy(client).orderBy("_s").rangeBetween(-n, 0))
    counted = own.withColumn("last_hour", last(3600)).withColumn("last_day", last(86400)).drop("_s")
    return counted.withColumn("allowed", (F.col("last_hour") <= HOUR_LIMIT) & (F.col("last_day") <= DAY_LIMIT))


def cache_hits(events: DataFrame, key: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """(key, calls, paid, hits): an event pays unless one that paid lies less than ``ttl`` seconds before it.

    Events are dealt by key, sorted within a task and read in batches; the state of the key at hand is its counts and
    the time of its last paid event, so that no key's history is held as a whole. Null keys are one key; events without
    a time don't count.
    """
    timed = events.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("_s")).where("_s is not null")
    kind = timed.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, arrow = None, None
        for batch in batches:
            done, arrow, at = [], batch.schema.field(0).type, 0
            times, runs = batch.column(1).to_numpy(zero_copy_only=False), pc.run_end_encode(batch.column(0))
            for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if state is None or state[0] != value:
                    done += [state] if state else []
                    state = (value, 0, 0, None)
                state, at = (value, state[1] + end - at, *_paid(times[at:end], state[2], state[3], ttl * 1_000_000)), end
            if done:
                yield _counts(done, arrow)
        if state:
            yield _counts([state], arrow)

    counted = timed.repartition(key).sortWithinPartitions(key, "_s").mapInArrow(scan, f"`{key}` {kind}, calls long, paid long")
    return counted.withColumn("hits", F.col("calls") - F.col("paid"))


def _paid(times: np.ndarray, paid: int, last: int | None, ttl: int) -> tuple[int, int | None]:
    """Paid events up to the end of ``times``, and the time of the last one."""
    at = 0 if last is None else int(np.searchsorted(times, last + ttl))
    while at < len(times):
        paid, last = paid + 1, int(times[at])
        at = int(np.searchsorted(times, last + ttl))
    return paid, last


def _counts(states: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    keys, calls, paid, _ = zip(*states, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, type=kind), pa.array(calls, type=pa.int64()), pa.array(paid, type=pa.int64())], names=["key", "calls", "paid"])
