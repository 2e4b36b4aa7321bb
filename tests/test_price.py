import datetime as dt

import pytest
from motorfisc.operators import price, tax
from pyspark.sql import functions as F

CATALOGUE = "catalogue_id long, brand string, model string, variant string, match_key string, price_eur double, co2_g_km double, fuel_type string, power_kw double, valid_from date"
LISTING = "listing_id long, brand string, model string, variant string, fuel_type string, power_kw double, co2_g_km double, year int, price_eur double, valid_from date, seat_count int, is_new boolean"
ENGINE = "engine_id long, brand string, title string, engine_code string, production_start string, production_end string, displacement_cc double, power_kw double, fuel_type string, co2_min double, co2_max double, brand_check string, source_url string, source_fingerprint string, variant_index int, source_order_corrected boolean"
DAY = dt.date(2020, 8, 17)
ROWS = [(1, "BMW", "320d", "xDrive", "bmw 320d xdrive", 50000.0, 120.0, "diesel", 140.0, DAY), (2, "BMW", "i3", "120 Ah", "bmw i3 120 ah", 40000.0, None, "electric", 125.0, DAY)]


def listing(i, model="320d", variant="xDrive", fuel="diesel", power=140.0, co2=None, amount=30000.0, day=DAY, brand="BMW", seats=None, new=None):
    return (i, brand, model, variant, fuel, power, co2, 2020, amount, day, seats, new)


LISTINGS = [
    listing(1), listing(2, co2=136.0), listing(3, co2=0.0), listing(4, co2=-5.0, amount=None), listing(5, fuel=None), listing(6, fuel="steam"), listing(7, day=None, co2=130.0), listing(8, amount=None, co2=130.0),
    listing(9, model="nothing", variant="like it", power=None), listing(10, brand=None), listing(11, model="i3", variant="120 Ah", fuel="electric", power=125.0, co2=0.0), listing(12, co2=136.0, seats=8), listing(13, co2=136.0, new=True),
]
#: status, source, confidence and warnings of each listing
WANT = {
    1: ("ok", "catalogue", "high", []), 2: ("ok", "listing", "high", []), 3: ("needs_co2", "manual", "low", ["co2_not_positive"]), 4: ("needs_co2", "manual", "low", ["co2_not_positive"]),
    5: ("ok", "catalogue", "high", []), 6: ("needs_fuel", "catalogue", "high", ["unknown_fuel"]), 7: ("needs_date", "listing", "high", ["no_registration_date"]), 8: ("needs_price", "listing", "high", ["no_price"]),
    9: ("needs_co2", "manual", "low", ["co2_not_found"]), 10: ("needs_co2", "manual", "high", []), 11: ("ok", "listing", "high", []), 12: ("ok", "listing", "high", []), 13: ("ok", "listing", "high", []),
}


@pytest.fixture(scope="module")
def priced(spark):
    engines = spark.createDataFrame([(1, "BMW", "BMW F30", "320d", "2015-01", "2022-01", 1995.0, 140.0, "diesel", 110.0, 125.0, "confirmed", "u", "f", 0, False)], ENGINE)
    return {r.listing_id: r for r in price.price_listings(spark.createDataFrame(LISTINGS, LISTING), spark.createDataFrame(ROWS, CATALOGUE), engines, "2025-07-10").collect()}


def test_tiers_confidence_and_warnings(priced):
    assert {i: (r.status, r.co2_source, r.confidence, r.warnings) for i, r in priced.items()} == WANT


def test_tax_is_of_what_the_tiers_say(spark, priced):
    offers = spark.createDataFrame([(i, 30000.0, co2, fuel, DAY, dt.date(2025, 7, 10), None, seats, False, new) for i, co2, fuel, seats, new in ((1, 120.0, "diesel", None, False), (2, 136.0, "diesel", None, False), (5, 120.0, "diesel", None, False), (12, 136.0, "diesel", 8, False), (13, 136.0, "diesel", None, True))], "i long, price_eur double, co2_g_km double, fuel_type string, first_registration_date date, declaration_date date, eaer_city_range_km double, seat_count int, is_camper boolean, is_new_vehicle boolean")
    for r in tax.tax_breakdown(offers).select("i", "final_ppmv").collect():
        assert priced[r.i].final_ppmv == r.final_ppmv
    assert priced[12].final_ppmv < priced[2].final_ppmv < priced[13].final_ppmv
    assert all((r.final_ppmv is None) == (r.status != "ok") for r in priced.values()) and priced[11].final_ppmv == 0


def test_hints_are_for_listings_without_a_figure_in_either_tier(spark, priced):
    assert all(r.hint_min is None for i, r in priced.items() if i not in (9, 10))


def test_listings_without_seats_and_news(spark):
    plain = spark.createDataFrame(LISTINGS[:2], LISTING).drop("seat_count", "is_new")
    got = price.price_listings(plain, spark.createDataFrame(ROWS, CATALOGUE), spark.createDataFrame([], ENGINE), "2025-07-10")
    assert got.where(F.col("final_ppmv") > 0).count() == 2
