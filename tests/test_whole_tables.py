"""Queries read whole tables: every car is a listing, and stored keys grow with the tables."""

import pytest

from motorfisc.plans import registry, table_queries
from motorfisc.plans.derived import derive

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def cars(spark, sf_dir):
    return {r.id for r in derive(spark, sf_dir, "cars").select("id").collect()}


def ids(df, name):
    return {r[0] for r in df.select(name).collect()}


@pytest.mark.parametrize("name", ["job4_match_listings", "job13_price_listings", "jn4_jn5_candidate_pairs", "num14_win6_scored_pairs"])
def test_every_car_is_listed(spark, sf_dir, cars, name):
    assert ids(table_queries.listings(spark, sf_dir), "listing_id") == cars
    assert ids(QUERIES[name](spark, sf_dir), "listing_id") == cars


def test_every_car_is_searched_but_those_without_a_match(spark, sf_dir, cars):
    told = {r.listing_id for r in QUERIES["job4_match_listings"](spark, sf_dir).collect() if r.status != "no_match"}
    assert ids(QUERIES["job5_catalogue_search"](spark, sf_dir), "listing_id") == told


def test_every_car_has_a_period(spark, sf_dir, cars):
    assert ids(QUERIES["jn6_period_in_force"](spark, sf_dir), "id") == cars


def test_keys_grow_with_the_tables(spark, sf_dir, cars):
    written = {3 * r[0] for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey").collect()}
    stored = {2 * i for i in cars}
    for name in ("snk1_snk4_snk6_upsert", "snk2_insert_ignore"):
        assert ids(QUERIES[name](spark, sf_dir), "key") == stored | written
    assert written & stored and stored - written and written - stored
