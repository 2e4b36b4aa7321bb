"""Stores and reports in JSON, tables written anew, and the cache's count beside a plain one."""

import json

import pytest
from motorfisc.operators import accounting, articles, upsert
from motorfisc.sources import readers
from pyspark.sql import functions as F


def test_entries_without_a_mapping_are_left_out(spark, tmp_path):
    store = {"a": {"status": "ok", "price_currency": "EUR", "confidence": 0.9, "fields": {"model": "B"}}, "b": {"status": "fail"}}
    (tmp_path / "store.json").write_text(json.dumps(store, indent=1))
    rows = readers.mapping_store(spark, str(tmp_path / "store.json")).collect()
    assert [(r.fingerprint, r.price_currency, r.confidence, r.fields) for r in rows] == [("a", "EUR", 0.9, {"model": "B"})]
    texts = spark.createDataFrame([(None,), ("no json",), ("{}",)], "value string")
    assert readers.mapping_entries(texts).count() == 0


def test_tripwires_are_review_rows_of_the_brands_asked_for(spark, tmp_path):
    report = {"valid": [], "tripwire": [{"brand": "BMW", "article_title": "F30", "co2_shaped_matches": ["1 g/km", "2 g/km"], "variants_returned": 3}, {"brand": "Kia"}]}
    (tmp_path / "report.json").write_text(json.dumps(report, indent=1))
    row = readers.tripwires(spark, str(tmp_path / "report.json"), ["BMW"]).collect()
    assert [(r.crawl_brand, r.effective_brand, r.model_article_title, r.reason, r.variants_returned) for r in row] == [("BMW", "BMW", "F30", "phase2_5_tripwire", 3)]
    assert row[0].validation_errors[0].endswith(": 1 g/km, 2 g/km")
    assert readers.tripwires(spark, str(tmp_path / "report.json")).count() == 2
    (tmp_path / "none.json").write_text("{}")
    assert readers.tripwires(spark, str(tmp_path / "none.json")).count() == 0


def test_a_slice_is_replaced_and_a_table_refreshed(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda *x: spark.createDataFrame(list(x), "brand string, n int")
    read = lambda: sorted((r.brand, r.n) for r in spark.read.parquet(path).collect())
    upsert.write_replacing(rows(("a", 1), ("a", 2), ("b", 3)), path, "brand")
    upsert.write_replacing(rows(("a", 9)), path, "brand")
    assert read() == [("a", 9), ("b", 3)]
    upsert.write_replacing(rows(("c", 1)), path)
    assert read() == [("c", 1)]


def test_a_report_is_written_as_json(spark, tmp_path):
    review = spark.createDataFrame([("x", 1), ("y", 2)], "reason string, n int")
    for _ in range(2):
        readers.write_report(review, review.agg(F.sum("n").alias("n")), str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run/review")).count() == 2
    assert [r.n for r in spark.read.json(str(tmp_path / "run/summary")).collect()] == [3]


@pytest.mark.parametrize("batch", [3, 10_000])
def test_cache_counts_equal_a_plain_count(spark, batch):
    events = [(k, i * 7919 % 400_000) for k in (None, "a", "b") for i in range(40 if k else 300)] + [("c", 0), ("c", 86_399), ("c", 86_400), ("d", None)]
    df = spark.createDataFrame(events, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = {r.k: (r.calls, r.paid, r.hits) for r in accounting.cache_hits(df, "k").collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k in (None, "a", "b", "c"):
        times, last, paid = sorted(s for key, s in events if key == k), None, 0
        for t in times:
            if last is None or t - last >= 86_400:
                last, paid = t, paid + 1
        want[k] = (len(times), paid, len(times) - paid)
    assert got == want
    assert accounting.cache_hits(df.where("false"), "k").count() == 0


def test_a_sample_of_one_orientation_is_all_its_own(spark):
    rows = spark.createDataFrame([("normal", b, i) for b, n in (("x", 9), ("y", 2)) for i in range(n)], "orientation string, brand string, id int")
    got = articles.spot_check_sample(rows, 5, F.col("id")).orderBy("turn").collect()
    assert [(r.brand, r.id) for r in got] == [("x", 0), ("y", 0), ("x", 1), ("y", 1), ("x", 2)]
    assert articles.spot_check_sample(rows, 50, F.col("id")).count() == 11
    assert articles.spot_check_sample(rows.where("false"), 5, F.col("id")).count() == 0
