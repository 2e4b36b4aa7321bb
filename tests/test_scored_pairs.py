"""All pairs of listings and rows: made in many tasks, and rounded as Spark rounds."""

import random

from pyspark.sql import functions as F

from motorfisc.functions import numbers as num
from motorfisc.operators import match
from motorfisc.plans import table_queries as tq


def test_pairs_are_dealt_evenly_to_many_tasks_and_hot_texts_are_split(spark, sf_dir, monkeypatch):
    queries, rows = match.listing_queries(tq.listings(spark, sf_dir)), match.catalogue_rows(tq.catalogue(spark, sf_dir))
    whole = match.scored(queries, rows).select("listing_id", "catalogue_id", "score")
    monkeypatch.setattr(match, "TOGETHER", 2, raising=False)
    split = match.scored(queries, rows).select("listing_id", "catalogue_id", "score")
    for pairs in (whole, split):
        sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 16 and max(sizes) < sum(sizes) / 4
    assert whole.exceptAll(split).isEmpty() and split.exceptAll(whole).isEmpty()
    assert whole.count() == match.pair_counts(queries, rows).agg(F.sum("pairs")).first()[0]


def test_rounding_is_that_of_spark(spark):
    rng = random.Random(1)
    some = [rng.uniform(0, 100) for _ in range(2000)] + [k / 2e6 for k in range(0, 4000, 7)] + [12.3456785, 12.3456775, 0.0000005, 1e-9, 100.0, 0.0, None]
    df = spark.createDataFrame([(x,) for x in some], "x double")
    assert df.where(~num.rounded(F.col("x"), 6).eqNullSafe(F.round("x", 6))).isEmpty()
