import tempfile

import pytest
from motorfisc.operators import load
from motorfisc.sources import versions

SCHEMA = "engine_id long, crawl_brand string, title string, source_fingerprint string, variant_index int, production_start string, production_end string, displacement_cc double, power_kw double, co2_min double, co2_max double"


def variant(i, key, low, high, brand="BMW", title="BMW 3er", power=100.0):
    return (i, brand, title, *key, None, None, 1995.0, power, low, high)


@pytest.fixture
def path():
    return tempfile.mkdtemp(prefix="load-") + "/t"


def held(spark, path):
    return sorted(((r.source_fingerprint, r.variant_index, r.brand, r.co2_min, r.co2_max) for r in versions.read(spark, path).collect()), key=repr)


def test_loads_check_put_in_and_prune(spark, path):
    first = [variant(1, ("a", 0), 120.0, 130.0), variant(2, ("a", 1), 130.0, 125.0), variant(3, ("b", 0), 99.0, 99.0, "Subaru", "Opel Astra"), variant(4, ("c", 0), 100.0, 100.0, title="Nobody knows"), variant(5, (None, 0), 110.0, None), variant(6, ("a", 0), 121.0, 131.0)]
    assert load.load(spark, path, spark.createDataFrame(first, SCHEMA), "run", 0)
    want = [("a", 0, "BMW", 121.0, 131.0), ("a", 1, "BMW", 125.0, 130.0), ("b", 0, "Opel", 99.0, 99.0), (None, 0, "BMW", 110.0, None)]
    assert held(spark, path) == sorted(want, key=repr)
    assert [(r.source_fingerprint, r.reason) for r in versions.read(spark, path, "review").collect()] == [("c", "unverified")]
    # of what was fine one row is held now, with its figures turned too far; another is put in anew; the rest stays
    second = [variant(7, ("a", 1), 190.0, 30.0), variant(8, ("a", 0), 140.0, 150.0), variant(9, (None, 0), 110.0, 900.0)]
    tables = spark.createDataFrame([("d", "BMW", "BMW 5er", "x 120 g/km"), ("a", "BMW", "BMW 3er", "y 140 g/km"), ("e", "BMW", "BMW", "no figures")], "fingerprint string, crawl_brand string, title string, table string")
    frame = spark.createDataFrame(second, SCHEMA)
    assert load.load(spark, path, frame, "run", 1, load.tripwires(tables, frame))
    assert held(spark, path) == [("a", 0, "BMW", 140.0, 150.0), ("b", 0, "Opel", 99.0, 99.0)]
    review = {(r.source_fingerprint, r.variant_index, r.reason, tuple(r.errors)) for r in versions.read(spark, path, "review").collect()}
    assert review == {("a", 1, "implausible_correction", ()), (None, 0, "validation", ("co2_max_implausible",)), ("d", None, "tripwire", ("120",))}
    # a batch that comes again changes nothing, under a new name it goes on where the table is
    assert not load.load(spark, path, frame.limit(0), "run", 1)
    assert load.load(spark, path, frame.limit(0), "other", 0) and len(held(spark, path)) == 2


def test_a_load_that_dies_half_way_keeps_the_table(spark, path):
    assert load.load(spark, path, spark.createDataFrame([variant(1, ("a", 0), 120.0, 130.0)], SCHEMA), "run", 0)
    bad = spark.createDataFrame([variant(2, ("a", 0), 1.0, 2.0)], SCHEMA)
    suspects = load.tripwires(spark.createDataFrame([("d", "B", "B", "x 120 g/km")], "fingerprint string, crawl_brand string, title string, table string"), bad).selectExpr("source_fingerprint", "variant_index", "crawl_brand", "title", "raise_error('lost') as reason", "errors")
    with pytest.raises(Exception, match="lost"):
        load.load(spark, path, bad, "run", 1, suspects)
    assert held(spark, path) == [("a", 0, "BMW", 120.0, 130.0)]
    assert load.load(spark, path, bad, "run", 1) and held(spark, path) == [("a", 0, "BMW", 1.0, 2.0)]
