import datetime as dt
import os
from pathlib import Path

import pytest
from motorfisc.functions import folding
from motorfisc.operators import accounting, statistics
from motorfisc.sources import stores
from pyspark.sql import functions as F


def spoil(path, kept):
    """Makes every file but those of the kept partitions unreadable, so that opening one shows."""
    found = [f for f in Path(path).glob("*/*.parquet") if f.parent.name not in kept]
    assert found
    for f in found:
        os.chmod(f, 0o644)
        f.write_bytes(b"no parquet")
        for crc in f.parent.glob(f".{f.name}.crc"):
            crc.unlink()


@pytest.fixture
def catalogue(spark, tmp_path):
    rows = [(i, ["BMW", "Bmw", "Audi", "Kia", None][i % 5], float(i)) for i in range(50)]
    path = str(tmp_path / "catalogue")
    stores.write_catalogue(spark.createDataFrame(rows, "catalogue_id long, brand string, price_eur double"), path)
    return path


def test_a_brands_scan_opens_its_partition_only(spark, catalogue):
    assert stores.catalogue_scan(spark, catalogue).count() == 50
    rows, none, kia = (stores.catalogue_scan(spark, catalogue, b) for b in ("bMw", "Tatra", "Kia"))
    spoil(catalogue, {"_brand=bmw"})  # once the schema is known, from a file of any partition
    assert sorted(r.catalogue_id for r in rows.collect()) == [i for i in range(50) if i % 5 < 2] and rows.columns == ["catalogue_id", "brand", "price_eur"]
    assert none.count() == 0
    with pytest.raises(Exception, match="(?i)parquet"):
        kia.collect()


def test_listings_decide_as_the_query_runs_which_brands_are_opened(spark, catalogue):
    listings = spark.createDataFrame([(1, "AUDI", 5), (2, "bmw", 5), (3, None, 5), (4, "Kia", 9), (5, "Lada", 5)], "listing_id long, brand string, x int").where("x < 7")
    rows = stores.catalogue_for(spark, catalogue, listings)
    spoil(catalogue, {"_brand=bmw", "_brand=audi"})
    assert sorted(r.catalogue_id for r in rows.collect()) == [i for i in range(50) if i % 5 < 3]
    assert "dynamicpruning" in rows._jdf.queryExecution().toString()


def test_a_brand_that_is_written_again_replaces_its_own_rows(spark, catalogue):
    stores.write_catalogue(spark.createDataFrame([(99, "KIA", 1.0)], "catalogue_id long, brand string, price_eur double"), catalogue)
    assert [r.catalogue_id for r in stores.catalogue_scan(spark, catalogue, "kia").collect()] == [99] and stores.catalogue_scan(spark, catalogue).count() == 41


def test_a_hot_day_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "FILE_ROWS", 100)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as the partitions are small here
    events = spark.range(1000).select(F.col("id").alias("event_id"), (F.lit(dt.datetime(2024, 1, 1)) + F.make_interval(hours=F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") / 8).cast("int"))).alias("ts"))
    stores.write_events(events, str(tmp_path / "e"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(list((tmp_path / "e" / "_day=2024-01-01").glob("*.parquet"))) > 1 and spark.read.parquet(str(tmp_path / "e")).count() == 1000


def test_events_are_scanned_by_day(spark, sf_dir, tmp_path):
    events, path = spark.read.parquet(f"{sf_dir}/events.parquet"), str(tmp_path / "events")
    stores.write_events(events, path)
    since, until = dt.datetime(2024, 1, 10, 12), dt.datetime(2024, 1, 12, 6)
    got, eleventh = stores.event_scan(spark, path, since, until, kinds=["view", "click"], clients=[1, 2, 3]), stores.day_scan(spark, path, dt.date(2024, 1, 11))
    spoil(path, {f"_day=2024-01-{d}" for d in (10, 11, 12)})
    want = events.where((F.col("ts") >= F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-12 06:00:00").cast("timestamp_ntz")) & F.col("event_type").isin("view", "click") & F.col("user_id").isin(1, 2, 3))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    day = accounting.daily_budget(eleventh, F.col("event_type") == "purchase").collect()
    assert [(r.day, r.used) for r in day] == [(dt.date(2024, 1, 11), events.where("event_type = 'purchase' and to_date(ts) = '2024-01-11'").count())]


TABLES = [
    ("a", "{|\n|-\n! Motor !! Leistung\n|-\n| x || 9 kW\n|}"),  # both ways normal
    ("b", "{|\n|-\n! Motor\n| x\n|-\n! CO<sub>2</sub>\n| 120 g/km\n|}"),  # one labelled row more than down, marks transposed
    ("c", "{|\n|-\n! q !! r\n|-\n| x || y\n|}"),  # words say nothing
    ("d", "{|\n|-\n| Hubraum || Leistung || CO2\n|-\n| 1 || 2 || 3\n|}"),  # marks say nothing
]


def test_observed_statistics_equal_a_plain_aggregate(spark, tmp_path):
    found = statistics.analysed(spark.createDataFrame([*TABLES, TABLES[0], ("e", "")], "fingerprint string, table string"))
    got = statistics.write_observed(found, str(tmp_path / "x"), statistics.totals())
    plain = found.agg(*[x.alias(n) for n, x in statistics.totals().items()]).first().asDict()
    assert got == plain and spark.read.parquet(str(tmp_path / "x")).count() == 6
    assert (got["tables"], got["with_co2"], got["marks_normal"], got["marks_transposed"], got["agreeing"]) == (6, 2, 3, 1, 3)


def test_statistics_of_no_tables(spark, tmp_path):
    none = spark.createDataFrame([], "fingerprint string, table string")
    got = statistics.write_observed(statistics.analysed(none), str(tmp_path / "x"), statistics.totals())
    assert set(got.values()) == {0}


def test_folding_equals_unicodes_for_all_of_the_basic_plane(spark):
    codes = [i for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(i, chr(i)) for i in codes], "i int, t string").select("i", F.lower("t").alias("low"), folding.unmarked_all(F.col("t")).alias("f"))
    wrong = [(r.i, r.low, r.f) for r in rows.collect() if r.f != folding.stripped(r.low)]
    assert wrong == []


def test_folding_of_words_nulls_and_what_stays_in_the_engine(spark):
    words = ["Škoda Đakovo", None, "", "Čačak ŽĐ", "ﬁne Ⅷ ½", "한글 é", "𝐀bc é", "état"]
    got = [r.f for r in spark.createDataFrame([(w,) for w in words], "t string").coalesce(1).select(folding.unmarked_all(F.col("t")).alias("f")).collect()]
    assert got == [None if w is None else folding.stripped(w.lower()) for w in words]


def test_plain_texts_are_folded_fast(spark):
    """Twelve million plain letters and a marked one: each plain one is passed at the first look."""
    import time

    from motorfisc.functions import folding
    from pyspark.sql import functions as F

    text = F.concat(F.repeat(F.concat(F.lit("Plain Word "), F.col("id").cast("string")), 1_000_000), F.lit("Ǆć"))
    begun = time.time()
    got = spark.range(1).select(F.substring(folding.unmarked_all(text), -6, 6).alias("t")).first().t
    assert got == folding.stripped("rd 0ǆć")[-6:] and time.time() - begun < 8
