"""Listings priced end to end: match, fill, guard, tax."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorfisc.functions import categories as cat
from motorfisc.operators import corpus, match, tax
from motorfisc.session import stored

c = F.col


def price_listings(listings: DataFrame, catalogue: DataFrame, engines: DataFrame, declared: str, k: int = 15) -> DataFrame:
    """One row for each listing: tax, or the first reason why there is none.

    Emission and fuel come from the listing, else from a catalogue row that matched for sure. A stated emission that
    isn't positive is no reading, except of an electric car, and isn't filled from the catalogue either. An emission range
    from the corpus is a hint for listings that neither tier has a figure for, and never enters the tax. ``declared`` is
    the declaration day. A stated fuel that the tax has no spelling for ends as ``needs_fuel``; the matched row's fuel
    counts only where the listing states none. Seats and whether a car is new count where listings have the columns
    seat_count and is_new; electric range and camper use aren't known of listings.

    ``co2_source`` tells which tier the emission is from (listing, catalogue, or manual: none), ``confidence`` is low
    where it has to be given by hand, and ``warnings`` lists, in order, co2_not_found (of listings with a brand),
    co2_not_positive, and of what keeps the others from being taxed unknown_fuel, no_registration_date or no_price.
    """
    matched = match.match_listings(listings, catalogue, k).select("listing_id", c("status").alias("match_status"), "matched_id")
    rows = catalogue.select(c("catalogue_id").alias("matched_id"), c("co2_g_km").alias("_co2"), c("fuel_type").alias("_fuel"))
    own = stored(listings.join(matched, "listing_id").join(rows, "matched_id", "left"))  # read by hints, tax and result
    stated = F.nullif(F.trim("fuel_type"), F.lit(""))
    own = own.withColumn("fuel", cat.tax_fuel(F.coalesce(stated, c("_fuel"))))
    bad = c("co2_g_km").isNotNull() & (c("co2_g_km") <= 0) & ~F.coalesce(c("fuel") == "electric", F.lit(False))
    own = own.withColumn("_bad", bad).withColumn("_none", c("co2_g_km").isNull() & c("_co2").isNull())
    own = own.withColumn("co2", F.when(~c("_bad"), F.coalesce("co2_g_km", "_co2"))).withColumn("co2_source", F.when(c("co2").isNull(), "manual").when(c("co2_g_km").isNotNull(), "listing").otherwise("catalogue"))
    branded = F.coalesce(F.trim("brand") != "", F.lit(False))
    own = own.withColumn("confidence", F.when(c("_bad") | (branded & c("_none")), "low").otherwise("high"))
    asked = own.where("_none").select(c("listing_id").alias("vehicle_id"), F.trim("brand").alias("brand"), F.concat_ws(" ", "model", "variant").alias("v_model"), c("fuel").alias("v_fuel"), c("power_kw").alias("v_power"), F.lit(None).cast("double").alias("v_cc"), c("valid_from").alias("registered"))
    hints = corpus.co2_range(asked, corpus.eligible(engines)).select(c("vehicle_id").alias("listing_id"), c("co2_min").alias("hint_min"), c("co2_max").alias("hint_max"))
    status = F.when(c("co2").isNull(), "needs_co2").when(c("fuel").isNull(), "needs_fuel").when(c("valid_from").isNull(), "needs_date").when(c("price_eur").isNull(), "needs_price")
    lacking = F.when(c("co2").isNotNull(), F.when(c("fuel").isNull(), "unknown_fuel").when(c("valid_from").isNull(), "no_registration_date").when(c("price_eur").isNull(), "no_price"))
    warnings = F.array_compact(F.array(F.when(branded & c("_none"), "co2_not_found"), F.when(c("_bad"), "co2_not_positive"), lacking))
    own = own.withColumn("stop", status).withColumn("warnings", warnings)
    given = lambda name, none: c(name) if name in listings.columns else F.lit(none)
    offers = own.select("listing_id", "price_eur", c("co2").alias("co2_g_km"), c("fuel").alias("fuel_type"), c("valid_from").alias("first_registration_date"), F.lit(declared).cast("date").alias("declaration_date"), F.lit(None).cast("double").alias("eaer_city_range_km"), given("seat_count", None).cast("int").alias("seat_count"), F.lit(False).alias("is_camper"), F.coalesce(given("is_new", False), F.lit(False)).alias("is_new_vehicle"))
    taxed = tax.tax_breakdown(offers).select("listing_id", c("status").alias("tax_status"), "as_new_total", "final_ppmv")
    out = own.join(hints, "listing_id", "left").join(taxed, "listing_id")
    paid = c("stop").isNull()
    return out.select("listing_id", "match_status", "matched_id", "co2_source", c("co2").alias("co2_g_km"), c("fuel").alias("fuel_type"), F.coalesce("stop", "tax_status").alias("status"), F.when(paid, c("as_new_total")).alias("as_new_total"), F.when(paid, c("final_ppmv")).alias("final_ppmv"), "hint_min", "hint_max", "confidence", "warnings")
