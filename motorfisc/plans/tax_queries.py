"""Tax queries over offers derived from lineitem, orders and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorfisc.functions import dims
from motorfisc.operators import tax
from motorfisc.plans.derived import SQL, derive, duck

_PARTS = ["as_new_value_component", "as_new_eco_component", "as_new_total", "vehicle_reduction_factor", "depreciation_percent", "final_ppmv"]


def job1_tax_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Itemized tax of every offer."""
    return tax.tax_breakdown(derive(spark, sf_dir, "offers")).select("offer_id", "status", "co2_standard_used", "months_old", *_PARTS)


def job1_tax_by_fuel_era(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers, months and tax by fuel and standard."""
    taxed = tax.tax_breakdown(derive(spark, sf_dir, "offers"))
    return taxed.groupBy("fuel_type", "co2_standard_used").agg(F.count(F.lit(1)).alias("n_offers"), F.sum("months_old").alias("sum_months"), F.round(F.sum(F.col("final_ppmv").cast("decimal(18,2)")).cast("double"), 2).alias("sum_ppmv"))


def flt1_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers by the first rule that they break."""
    offers = derive(spark, sf_dir, "offers")
    # some offers are spoilt so that every rule has its share
    spoilt = offers.withColumn("co2_g_km", F.when(F.col("offer_id") % 7 == 0, F.lit(0).cast("decimal(7,2)")).when(F.col("offer_id") % 7 == 1, F.lit(12).cast("decimal(7,2)")).otherwise(F.col("co2_g_km")))
    spoilt = spoilt.withColumn("seat_count", F.when(F.col("offer_id") % 31 == 0, 0).otherwise(F.col("seat_count")))
    return spoilt.withColumn("error", tax.validation_error(spoilt)).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def jn1_value_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price bracket of every offer, by bracket."""
    offers = derive(spark, sf_dir, "offers").withColumn("standard", tax.standard(F.col("first_registration_date")))
    found = tax.with_value_bracket(offers)
    return found.groupBy("standard", F.col("v_lo").cast("double").alias("lo")).agg(F.count(F.lit(1)).alias("n"), F.max("price_eur").cast("double").alias("max_price"))


def jn2_eco_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emission bracket of every offer, by bracket; null: below the lowest."""
    offers = derive(spark, sf_dir, "offers").withColumn("standard", tax.standard(F.col("first_registration_date")))
    found = tax.with_eco_bracket(offers.where("fuel_type <> 'electric'"))
    return found.groupBy("standard", "fuel_type", F.col("e_lo").cast("double").alias("lo")).agg(F.count(F.lit(1)).alias("n"), F.max("co2_g_km").cast("double").alias("max_co2"))


def jn3_depreciation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share still owed by age in months."""
    offers = derive(spark, sf_dir, "offers").withColumn("months_old", tax.completed_months(F.col("first_registration_date"), F.col("declaration_date"))).withColumn("is_new_vehicle", F.lit(False))
    return tax.with_depreciation(offers).groupBy("months_old").agg(F.max(F.col("depreciation_percent").cast("double")).alias("share"), F.count(F.lit(1)).alias("n"))


def dat1_completed_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed months of every offer."""
    return derive(spark, sf_dir, "offers").select("offer_id", tax.completed_months(F.col("first_registration_date"), F.col("declaration_date")).alias("months"))


def _values(rows: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else f"'{x}'" if not isinstance(x, int) else str(x)
    return ", ".join(f"({', '.join(cell(x) for x in r)})" for r in rows)


_VALUE = f"vb AS (SELECT standard AS vs, CAST(lo AS DECIMAL(12,2)) AS lo, CAST(hi AS DECIMAL(12,2)) AS hi, CAST(fixed AS DECIMAL(12,2)) AS fixed, CAST(rate AS DECIMAL(7,2)) AS rate FROM (VALUES {_values([('NEDC', *r) for r in dims.VALUE_NEDC] + [('WLTP', *r) for r in dims.VALUE_WLTP])}) t(standard, lo, hi, fixed, rate))"
_ECO = f"eb AS (SELECT standard AS es, fuel AS ef, CAST(lo AS DECIMAL(12,2)) AS elo, CAST(hi AS DECIMAL(12,2)) AS ehi, CAST(fixed AS DECIMAL(12,2)) AS efixed, CAST(rate AS DECIMAL(7,2)) AS erate FROM (VALUES {_values([(*k, *r) for k, rs in dims.ECO.items() for r in rs])}) t(standard, fuel, lo, hi, fixed, rate))"
_AGES = f"db AS (SELECT CAST(m AS INT) AS m, lead(CAST(m AS INT), 1, {dims.LAST_MONTH}) OVER (ORDER BY m) AS n, CAST(s AS DECIMAL(5,4)) AS s FROM (VALUES {_values(dims.DEPRECIATION)}) t(m, s))"
_MONTHS = "greatest((year(declaration_date) - year(first_registration_date)) * 12 + month(declaration_date) - month(first_registration_date) - CASE WHEN day(declaration_date) < least(day(first_registration_date), day(last_day(declaration_date))) THEN 1 ELSE 0 END, 0)"
_STANDARD = "CASE WHEN first_registration_date >= DATE '2021-01-01' THEN 'WLTP' ELSE 'NEDC' END"
_BASE = f"o AS (SELECT *, {_STANDARD} AS standard, CASE WHEN is_new_vehicle THEN 0 ELSE {_MONTHS} END AS months_old FROM offers)"
_SHARE = "CASE WHEN is_new_vehicle THEN CAST(1 AS DECIMAL(5,4)) WHEN months_old >= 180 THEN CAST(CAST('0.1932' AS DECIMAL(5,4)) - CAST(((least(months_old, 360) - 180) // 12) AS DECIMAL(4,0)) * CAST('0.006' AS DECIMAL(4,3)) AS DECIMAL(5,4)) ELSE s END"
_RULE = "CASE WHEN NOT price_eur > 0 THEN 'price_not_positive' WHEN co2_g_km < 0 THEN 'co2_negative' WHEN seat_count < 1 THEN 'seats_below_one' WHEN eaer_city_range_km < 0 THEN 'range_negative' WHEN declaration_date < first_registration_date THEN 'declared_before_registration' WHEN fuel_type = 'electric' AND co2_g_km <> 0 THEN 'electric_with_co2' WHEN fuel_type <> 'electric' AND co2_g_km = 0 THEN 'zero_co2_not_electric' END"
_TAXED = f"""
WITH offers AS ({duck(SQL['offers'])}), {_VALUE}, {_ECO}, {_AGES}, {_BASE},
j AS (SELECT o.*, lo, fixed, rate, elo, efixed, erate, {_SHARE} AS share, {_RULE} AS rule FROM o
  LEFT JOIN vb ON vs = standard AND price_eur >= lo AND (hi IS NULL OR price_eur <= hi)
  LEFT JOIN eb ON es = standard AND ef = fuel_type AND co2_g_km >= elo AND (ehi IS NULL OR co2_g_km < ehi)
  LEFT JOIN db ON months_old >= m AND months_old < n),
p AS (SELECT *, CASE WHEN rule IS NOT NULL THEN rule WHEN fuel_type <> 'electric' AND lo IS NULL THEN 'invalid_price' ELSE 'ok' END AS status,
  CASE WHEN fuel_type = 'electric' THEN 0 ELSE CAST(fixed + (price_eur - lo) * rate AS DECIMAL(18,4)) END AS value_exact,
  CASE WHEN fuel_type = 'electric' OR elo IS NULL THEN 0 ELSE CAST(efixed + (co2_g_km - elo) * erate AS DECIMAL(18,4)) END AS eco_exact,
  CASE WHEN fuel_type = 'electric' THEN CAST(1 AS DECIMAL(10,8)) ELSE CAST((CAST(1 AS DECIMAL(5,4)) - CAST(least(coalesce(eaer_city_range_km, 0), 100) AS DECIMAL(5,2)) * CAST('0.01' AS DECIMAL(3,2))) * CAST(CASE WHEN seat_count >= 9 THEN '0.25' WHEN seat_count >= 8 THEN '0.50' ELSE '1.00' END AS DECIMAL(3,2)) * CAST(CASE WHEN is_camper THEN '0.15' ELSE '1.00' END AS DECIMAL(3,2)) AS DECIMAL(10,8)) END AS factor_exact
  FROM j),
taxed AS (SELECT offer_id, fuel_type, status, standard AS co2_standard_used, months_old,
  CASE WHEN status = 'ok' THEN CAST(round(value_exact, 2) AS DOUBLE) END AS as_new_value_component,
  CASE WHEN status = 'ok' THEN CAST(round(eco_exact, 2) AS DOUBLE) END AS as_new_eco_component,
  CASE WHEN status = 'ok' THEN CAST(round(value_exact + eco_exact, 2) AS DOUBLE) END AS as_new_total,
  CASE WHEN status = 'ok' THEN CAST(factor_exact AS DOUBLE) END AS vehicle_reduction_factor,
  CASE WHEN status = 'ok' THEN CAST(share AS DOUBLE) END AS depreciation_percent,
  CASE WHEN status = 'ok' THEN CAST(round(CAST(CAST(value_exact + eco_exact AS DECIMAL(18,4)) * CAST(factor_exact AS DECIMAL(20,8)) AS DECIMAL(33,12)) * share, 2) AS DOUBLE) END AS final_ppmv
  FROM p)
"""
_OFFERS = f"WITH offers AS ({duck(SQL['offers'])})"

QUERIES = [job1_tax_breakdown, job1_tax_by_fuel_era, flt1_validation, jn1_value_bracket, jn2_eco_bracket, jn3_depreciation, dat1_completed_months]
ORACLES = {
    "job1_tax_breakdown": f"{_TAXED} SELECT offer_id, status, co2_standard_used, months_old, {', '.join(_PARTS)} FROM taxed",
    "job1_tax_by_fuel_era": f"{_TAXED} SELECT fuel_type, co2_standard_used, count(*) AS n_offers, sum(months_old)::BIGINT AS sum_months, round(CAST(sum(CAST(final_ppmv AS DECIMAL(18,2))) AS DOUBLE), 2) AS sum_ppmv FROM taxed GROUP BY ALL",
    "flt1_validation": f"{_OFFERS}, s AS (SELECT * REPLACE (CASE WHEN offer_id % 7 = 0 THEN 0 WHEN offer_id % 7 = 1 THEN 12 ELSE co2_g_km END AS co2_g_km, CASE WHEN offer_id % 31 = 0 THEN 0 ELSE seat_count END AS seat_count) FROM offers) SELECT {_RULE} AS error, count(*) AS n FROM s GROUP BY ALL",
    "jn1_value_bracket": f"{_OFFERS}, {_VALUE}, {_BASE} SELECT standard, CAST(lo AS DOUBLE) AS lo, count(*) AS n, CAST(max(price_eur) AS DOUBLE) AS max_price FROM o LEFT JOIN vb ON vs = standard AND price_eur >= lo AND (hi IS NULL OR price_eur <= hi) GROUP BY ALL",
    "jn2_eco_bracket": f"{_OFFERS}, {_ECO}, {_BASE} SELECT standard, fuel_type, CAST(elo AS DOUBLE) AS lo, count(*) AS n, CAST(max(co2_g_km) AS DOUBLE) AS max_co2 FROM o LEFT JOIN eb ON es = standard AND ef = fuel_type AND co2_g_km >= elo AND (ehi IS NULL OR co2_g_km < ehi) WHERE fuel_type <> 'electric' GROUP BY ALL",
    "jn3_depreciation": f"{_OFFERS}, {_AGES}, o AS (SELECT false AS is_new_vehicle, {_MONTHS} AS months_old FROM offers) SELECT months_old, max(CAST({_SHARE} AS DOUBLE)) AS share, count(*) AS n FROM o LEFT JOIN db ON months_old >= m AND months_old < n GROUP BY ALL",
    "dat1_completed_months": f"{_OFFERS} SELECT offer_id, {_MONTHS} AS months FROM offers",
}
