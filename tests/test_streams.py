import datetime as dt
import os
import random
import tempfile
import time
from pathlib import Path

import pytest
from motorfisc.operators import accounting
from motorfisc.sources import versions
from motorfisc.streaming import streams
from pyspark.sql import functions as F


def fresh():
    return tempfile.mkdtemp(prefix="stream-")


def test_daily_count_equals_the_batch_twin(spark, sf_dir):
    streams.run_to_end(streams.daily_paid(streams.event_stream(spark, sf_dir)), fresh(), "daily_paid")
    got = {r.day: r.used for r in spark.table("daily_paid").collect()}
    batch = accounting.daily_budget(spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_type") == "purchase")
    assert got == {r.day: r.used for r in batch.where("used > 0").collect()} and got


EVENTS = "event_id long, ts timestamp, user_id long, event_type string"
START = dt.datetime(2024, 5, 1, tzinfo=dt.UTC)


def source_of(spark, batches):
    """Events (id, seconds, client) as files that a stream reads one after another."""
    path = fresh()
    for at, rows in enumerate(batches):
        made = [(i, None if s is None else START + dt.timedelta(seconds=s), client, "view") for i, s, client in rows]
        spark.createDataFrame(made, EVENTS).coalesce(1).write.parquet(f"{path}/{at:03d}")
        for file in Path(f"{path}/{at:03d}").glob("*"):  # files are read in the order of their time stamps
            os.utime(file, (1_700_000_000 + 10 * at,) * 2)
    return path


def streamed(spark, path, make, name):
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    query = streams.run_to_end(make(events.withWatermark("ts", streams.WATERMARK)), fresh(), name, "append")
    return spark.table(name).collect(), [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


@pytest.fixture(scope="module")
def busy():
    """Clients in bursts and at rest, ties, events at whole hours and days, none without a client; within an hour in any order."""
    rng = random.Random(6)
    rows = [(i, rng.choice([0, 1, 2, 30, 47]) * 3600 + rng.choice([0, 0, 3599, 3600, rng.randint(0, 7000)]), rng.choice([1, 1, 1, 2, 3, None])) for i in range(700)]
    return sorted(rows, key=lambda r: (r[1] + rng.randint(0, 3000), r[0]))


#: A last event that moves the watermark past all others.
LAST = [(10**6, 40 * 86400, 99)]


def batches_of(rows, how):
    if how == "one":
        return [rows, LAST]
    if how == "many":
        return [*[rows[i : i + 40] for i in range(0, len(rows), 40)], LAST]
    rng, out = random.Random(how), [[]]
    for r in rows:
        out[-1].append(r)
        if rng.random() < 0.02:
            out.append([])
    return [*[b for b in out if b], LAST]


@pytest.mark.parametrize("how", ["one", "many", "uneven"])
def test_stream_quotas_equal_the_batch_twin_for_every_event(spark, busy, how):
    got, states = streamed(spark, source_of(spark, batches_of(busy, how)), streams.quotas, f"quotas_{how}")
    events = spark.createDataFrame([(i, START + dt.timedelta(seconds=s), u, "view") for i, s, u in busy], EVENTS)
    want = accounting.rate_limits(events).select("user_id", "event_id", F.least("last_hour", F.lit(streams.KEPT)), F.least("last_day", F.lit(streams.KEPT)), "allowed").collect()
    assert {tuple(r) for r in got if r.event_id < 10**6} == {tuple(r) for r in want} and len(got) in (len(want), len(want) + 1)
    assert {r.allowed for r in got} == {True, False} and any(r.last_hour <= accounting.HOUR_LIMIT and not r.allowed for r in got)
    assert states[-1] == 1 and max(states) >= 4  # all but the last client's have gone


def test_stream_quotas_of_the_given_events(spark, sf_dir):
    path = fresh()
    given = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type").cache()
    days = given.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()
    for at, (day,) in enumerate(days[::5]):
        part = given.where((F.to_date("ts") >= F.lit(day)) & (F.to_date("ts") < F.date_add(F.lit(day), 5)))
        part.coalesce(1).write.parquet(f"{path}/{at:03d}")
        for file in Path(f"{path}/{at:03d}").glob("*"):
            os.utime(file, (1_700_000_000 + 10 * at,) * 2)
    spark.createDataFrame([(-1, dt.datetime(2030, 1, 1, tzinfo=dt.UTC), -1, "view")], EVENTS).coalesce(1).write.parquet(f"{path}/999")
    got, _ = streamed(spark, path, streams.quotas, "quotas_given")
    want = accounting.rate_limits(given).select("user_id", "event_id", "last_hour", "last_day", "allowed").collect()
    assert {tuple(r) for r in got if r.event_id >= 0} == {tuple(r) for r in want}


@pytest.mark.parametrize("how", ["one", "many", "uneven"])
def test_paid_periods_add_up_to_the_batch_twin(spark, busy, how):
    got, states = streamed(spark, source_of(spark, batches_of(busy, how)), streams.paid_periods, f"periods_{how}")
    sums = {}
    for r in got:
        calls, paid, hits = sums.get(r.client, (0, 0, 0))
        sums[r.client] = (calls + r.calls, paid + 1, hits + r.hits)
    events = spark.createDataFrame([(i, START + dt.timedelta(seconds=s), u, "view") for i, s, u in busy], EVENTS)
    want = {r.user_id: (r.calls, r.paid, r.hits) for r in accounting.cache_hits(events, "user_id").collect()}
    assert {k: v for k, v in sums.items() if k != 99} == want and states[-1] == 1


ROWS = "id long, key long, price double"


@pytest.mark.parametrize("turned", [False, True])
def test_stream_of_rows_is_upserted_in_any_order(spark, turned):
    source, table = fresh(), fresh() + "/t"
    parts = [[(1, 10, 1.0), (2, 20, 2.0)], [(3, 20, 3.0), (4, 30, 4.0), (5, 30, 5.0)], [(6, None, 6.0), (7, None, 7.0)]]
    for at, rows in enumerate(reversed(parts) if turned else parts):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{source}/{at}")
        time.sleep(1.1)  # files are read in the order of their time stamps
    rows = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    query = streams.run_to_end(rows, fresh(), mode="append", sink=streams.upsert_sink(table, ["key"], ["id"], "id"))
    read = lambda: {tuple(r) for r in versions.read(spark, table).select("id", "key", "price").collect()}
    assert read() == {(1, 10, 1.0), (2, 20, 3.0), (4, 30, 5.0), (6, None, 7.0)}
    number = versions.latest(spark, table).number
    assert versions.latest(spark, table).batches == {query.id: len(parts) - 1} and number == len(parts) - 1
    again = streams.upsert_sink(table, ["key"], ["id"], "id", writer=query.id)
    again(spark.createDataFrame([(9, 90, 9.0)], ROWS), len(parts) - 1)  # a batch that comes again
    assert versions.latest(spark, table).number == number


def test_upserts_go_on_under_a_new_checkpoint(spark):
    source, table = fresh(), fresh() + "/t"
    spark.createDataFrame([(1, 10, 1.0), (2, 20, 2.0), (3, 30, 3.0)], ROWS).coalesce(1).write.parquet(f"{source}/a")
    stream = lambda: spark.readStream.schema(ROWS).option("recursiveFileLookup", "true").parquet(source)
    put = streams.upsert_sink(table, ["key"], ["id"], "id")
    checkpoint = fresh()
    streams.run_to_end(stream(), checkpoint, mode="append", sink=put)
    source = fresh()
    spark.createDataFrame([(4, 40, 4.0), (5, 10, 5.0)], ROWS).coalesce(1).write.parquet(f"{source}/a")
    streams.run_to_end(stream(), fresh(), mode="append", sink=put)
    want = {(1, 10, 5.0), (2, 20, 2.0), (3, 30, 3.0), (4, 40, 4.0)}
    assert {tuple(r) for r in versions.read(spark, table).select("id", "key", "price").collect()} == want
    assert len(versions.latest(spark, table).batches) == 2


def test_priced_stream_and_outcomes(spark):
    source, out = fresh(), fresh()
    schema = "price_eur double, co2_g_km double, fuel_type string, first_registration_date date, declaration_date date, eaer_city_range_km double, seat_count int, is_camper boolean, is_new_vehicle boolean"
    day = dt.date(2025, 7, 10)
    rows = [(70318.61, 136.0, "diesel", dt.date(2020, 8, 17), day, None, None, False, False), (40000.0, 180.0, "steam", dt.date(2020, 8, 17), day, None, None, False, False)]
    spark.createDataFrame(rows, schema).write.parquet(f"{source}/a")
    priced = streams.priced_stream(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source))
    runs = priced.select(F.lit("site").alias("site"), F.when(F.col("status") != "ok", F.col("status")).alias("error"), "final_ppmv")
    streams.run_to_end(runs, fresh(), mode="append", sink=streams.outcome_sink(out))
    assert [r.final_ppmv for r in spark.read.parquet(f"{out}/listings").collect()] == [3475.5]
    assert sorted((r.status, r.error_message) for r in spark.read.parquet(f"{out}/runs").collect()) == [("failed", "unknown_fuel"), ("success", None)]
