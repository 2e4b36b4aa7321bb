"""Itemized registration tax of whole tables of vehicle offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorfisc.functions import dims


def validation_error(df: DataFrame) -> Column:
    """The first rule that an offer breaks, or null."""
    c = df.__getitem__
    return (
        F.when(~(c("price_eur") > 0), "price_not_positive")
        .when(c("co2_g_km") < 0, "co2_negative")
        .when(c("seat_count") < 1, "seats_below_one")
        .when(c("eaer_city_range_km") < 0, "range_negative")
        .when(c("declaration_date") < c("first_registration_date"), "declared_before_registration")
        .when(~c("fuel_type").isin("petrol", "diesel", "electric"), "unknown_fuel")
        .when((c("fuel_type") == "electric") & (c("co2_g_km") != 0), "electric_with_co2")
        .when((c("fuel_type") != "electric") & (c("co2_g_km") == 0), "zero_co2_not_electric")
    )


def completed_months(start: Column, end: Column) -> Column:
    """Full months between two dates; a month ends on the start's day, or the last one of a shorter month."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    due = F.least(F.dayofmonth(start), F.dayofmonth(F.last_day(end)))
    return F.greatest(months - F.when(F.dayofmonth(end) < due, 1).otherwise(0), F.lit(0))


def standard(first_registration: Column) -> Column:
    """The emission standard that a first registration falls under."""
    return F.when(first_registration >= F.lit(dims.WLTP_FROM).cast("date"), "WLTP").otherwise("NEDC")


def with_value_bracket(offers: DataFrame) -> DataFrame:
    """Range join with the price brackets of the offer's standard: 24 broadcast rows, an equi key and a range."""
    b = F.broadcast(dims.value_brackets(offers.sparkSession))
    price = F.col("price_eur")
    return offers.join(b, (F.col("standard") == b["v_standard"]) & (price >= b["v_lo"]) & (b["v_hi"].isNull() | (price <= b["v_hi"])), "left")


def with_eco_bracket(offers: DataFrame) -> DataFrame:
    """Range join with the emission brackets of standard and fuel, half open: a shared bound has one bracket."""
    b = F.broadcast(dims.eco_brackets(offers.sparkSession))
    co2 = F.col("co2_g_km")
    return offers.join(b, (F.col("standard") == b["e_standard"]) & (F.col("fuel_type") == b["e_fuel"]) & (co2 >= b["e_lo"]) & (b["e_hi"].isNull() | (co2 < b["e_hi"])), "left")


def with_depreciation(offers: DataFrame) -> DataFrame:
    """Adds ``depreciation_percent``: by age bracket, beyond the last one in yearly steps, frozen at the end."""
    b = F.broadcast(dims.depreciation_brackets(offers.sparkSession))
    months = F.col("months_old")
    steps = F.floor((F.least(months, F.lit(dims.FROZEN_MONTH)) - dims.LAST_MONTH) / 12).cast("decimal(4,0)")
    tail = (F.lit(dims.LAST_SHARE).cast("decimal(5,4)") - steps * F.lit(dims.STEP_SHARE).cast("decimal(4,3)")).cast("decimal(5,4)")
    joined = offers.join(b, (months >= b["d_from"]) & (months < b["d_to"]), "left")
    share = F.when(F.col("is_new_vehicle"), F.lit("1").cast("decimal(5,4)")).when(months >= dims.LAST_MONTH, tail).otherwise(b["d_share"])
    return joined.withColumn("depreciation_percent", share).drop("d_from", "d_to", "d_share")


def reduction_factor(plug_in_km: Column, seats: Column, camper: Column) -> Column:
    """Product of the plug-in, seat and camper reductions, as decimal(9,7)."""
    km = F.least(F.coalesce(plug_in_km, F.lit(0)), F.lit(100)).cast("decimal(5,2)")
    plug_in = F.lit("1").cast("decimal(5,4)") - km * F.lit("0.01").cast("decimal(3,2)")
    by_seats = F.when(seats >= 9, F.lit("0.25")).when(seats >= 8, F.lit("0.50")).otherwise(F.lit("1.00")).cast("decimal(3,2)")
    by_use = F.when(camper, F.lit("0.15")).otherwise(F.lit("1.00")).cast("decimal(3,2)")
    return (plug_in * by_seats * by_use).cast("decimal(10,8)")


def tax_breakdown(offers: DataFrame) -> DataFrame:
    """Adds the itemized tax to offers, one row for each row.

    Needs price_eur, co2_g_km, fuel_type, first_registration_date, declaration_date, eaer_city_range_km, seat_count,
    is_camper and is_new_vehicle. Money is computed in decimals and given as doubles rounded to cents. ``status`` is
    ``ok``, or why there is no tax: a broken rule (a fuel other than petrol, diesel and electric is one; see
    ``categories.tax_fuel`` for spellings), ``invalid_price`` or ``missing_input``.
    """
    own = offers.withColumn("price_eur", F.col("price_eur").cast("decimal(12,2)")).withColumn("co2_g_km", F.col("co2_g_km").cast("decimal(7,2)"))
    own = own.withColumn("standard", standard(F.col("first_registration_date")))
    own = own.withColumn("months_old", F.when(F.col("is_new_vehicle"), 0).otherwise(completed_months(F.col("first_registration_date"), F.col("declaration_date"))))
    own = own.withColumn("error", validation_error(own))
    own = with_depreciation(with_eco_bracket(with_value_bracket(own)))
    electric = F.col("fuel_type") == "electric"
    zero = F.lit("0").cast("decimal(18,4)")
    value = F.when(electric, zero).otherwise((F.col("v_fixed") + (F.col("price_eur") - F.col("v_lo")) * F.col("v_rate")).cast("decimal(18,4)"))
    eco = F.when(electric | F.col("e_lo").isNull(), zero).otherwise((F.col("e_fixed") + (F.col("co2_g_km") - F.col("e_lo")) * F.col("e_rate")).cast("decimal(18,4)"))
    factor = F.when(electric, F.lit("1").cast("decimal(10,8)")).otherwise(reduction_factor(F.col("eaer_city_range_km"), F.col("seat_count"), F.col("is_camper")))
    own = own.withColumn("value_exact", value).withColumn("eco_exact", eco).withColumn("factor_exact", factor)
    missing = F.col("price_eur").isNull() | F.col("co2_g_km").isNull() | F.col("fuel_type").isNull() | F.col("first_registration_date").isNull()
    status = F.when(missing, "missing_input").when(F.col("error").isNotNull(), F.col("error")).when(~electric & F.col("v_lo").isNull(), "invalid_price").otherwise("ok")
    total = F.col("value_exact") + F.col("eco_exact")
    money = lambda x: F.when(F.col("status") == "ok", F.round(x, 2).cast("double"))
    out = own.withColumn("status", status)
    return out.select(
        *[c for c in offers.columns if c not in ("standard", "status", "months_old")],
        "status",
        F.col("standard").alias("co2_standard_used"),
        "months_old",
        money(F.col("value_exact")).alias("as_new_value_component"),
        money(F.col("eco_exact")).alias("as_new_eco_component"),
        money(total).alias("as_new_total"),
        F.when(F.col("status") == "ok", F.col("factor_exact").cast("double")).alias("vehicle_reduction_factor"),
        F.when(F.col("status") == "ok", F.col("depreciation_percent").cast("double")).alias("depreciation_percent"),
        money(total.cast("decimal(18,4)") * F.col("factor_exact") * F.col("depreciation_percent")).alias("final_ppmv"),
    )
