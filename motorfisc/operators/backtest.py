"""Back-test of emission ranges: rows whose emission is known are asked as vehicles, and the answers held against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorfisc.functions import categories as cat
from motorfisc.operators import corpus

c = F.col
#: Width of a band of scores, in points.
BAND = 5


def as_vehicles(known: DataFrame) -> DataFrame:
    """Catalogue rows as vehicles to ask for: their emission isn't among what is asked."""
    return known.select(
        c("catalogue_id").alias("vehicle_id"), F.trim("brand").alias("brand"), F.concat_ws(" ", "model", "variant").alias("v_model"), cat.tax_fuel(c("fuel_type")).alias("v_fuel"),
        c("power_kw").alias("v_power"), F.lit(None).cast("double").alias("v_cc"), c("valid_from").alias("registered"),
    )


def answers(known: DataFrame, engines: DataFrame) -> DataFrame:
    """(catalogue_id, co2_g_km, co2_min, co2_max, score, miss) of the known rows that get a range.

    ``miss`` is how far the known figure lies outside the range, 0 inside. Rows without a figure or an id aren't asked.
    """
    truth = known.where(c("co2_g_km").isNotNull() & c("catalogue_id").isNotNull())
    found = corpus.co2_range(as_vehicles(truth), corpus.eligible(engines)).select(c("vehicle_id").alias("catalogue_id"), "co2_min", "co2_max", "score")
    told = truth.select("catalogue_id", "co2_g_km").join(found, "catalogue_id")
    return told.withColumn("miss", F.greatest(c("co2_min") - c("co2_g_km"), c("co2_g_km") - c("co2_max"), F.lit(0.0)))


def by_band(found: DataFrame) -> DataFrame:
    """(band, n, contained, p50, p90): answers by BAND points of their score: how many, the share that holds the truth, and percentiles of the miss."""
    band = (F.floor(c("score") / BAND) * BAND).cast("double").alias("band")
    return found.groupBy(band).agg(F.count(F.lit(1)).alias("n"), F.avg((c("miss") == 0).cast("double")).alias("contained"), F.percentile("miss", 0.5).alias("p50"), F.percentile("miss", 0.9).alias("p90"))


def coverage(known: DataFrame, found: DataFrame) -> DataFrame:
    """One row: rows asked, rows answered, the share of these, and the share of the answers that hold the truth."""
    asked = known.agg(F.count_if(c("co2_g_km").isNotNull() & c("catalogue_id").isNotNull()).alias("asked"))
    told = found.agg(F.count(F.lit(1)).alias("answered"), F.avg((c("miss") == 0).cast("double")).alias("contained"))
    return asked.join(F.broadcast(told)).select("asked", "answered", F.try_divide("answered", "asked").alias("share"), "contained")  # of one row each
