import math

from motorfisc.operators import backtest, corpus
from motorfisc.plans import corpus_queries
from motorfisc.plans.derived import derive
from motorfisc.plans.table_queries import catalogue
from pyspark.sql import functions as F


def percentile(xs, p):
    xs, at = sorted(xs), p * (len(xs) - 1)
    low = math.floor(at)
    return xs[low] + (xs[min(low + 1, len(xs) - 1)] - xs[low]) * (at - low)


def test_bands_equal_a_plain_count_of_the_operators_answers(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    known, engines = catalogue(spark, larger).cache(), corpus.ordered_range(derive(spark, larger, "engines")).cache()
    truth = {r.catalogue_id: r.co2_g_km for r in known.collect()}
    bands = {}
    for r in corpus.co2_estimates(backtest.as_vehicles(known), corpus.eligible(engines)).where("co2_min is not null").collect():
        miss = max(r.co2_min - truth[r.vehicle_id], truth[r.vehicle_id] - r.co2_max, 0.0)
        bands.setdefault(5.0 * (r.score // 5), []).append(miss)
    got = {r.band: r for r in corpus_queries.agg17_job10_backtest(spark, larger).collect()}
    whole = got.pop(None)
    assert (whole.asked, whole.n) == (len(truth), sum(map(len, bands.values())))
    assert got.keys() == bands.keys() and len(bands) > 1
    for band, misses in bands.items():
        r = got[band]
        assert (r.n, round(r.contained, 9)) == (len(misses), round(sum(m == 0 for m in misses) / len(misses), 9))
        assert abs(r.p50 - percentile(misses, 0.5)) < 1e-9 and abs(r.p90 - percentile(misses, 0.9)) < 1e-9
    row = backtest.coverage(known, backtest.answers(known, engines)).first()
    assert (row.asked, row.answered) == (len(truth), sum(map(len, bands.values()))) and abs(row.share - row.answered / row.asked) < 1e-12


def test_rows_without_a_figure_arent_asked_and_none_answered_is_no_error(spark, sf_dir):
    known = catalogue(spark, sf_dir).withColumn("co2_g_km", F.lit(None).cast("double"))
    engines = corpus.ordered_range(derive(spark, sf_dir, "engines"))
    row = backtest.coverage(known, backtest.answers(known, engines)).first()
    assert (row.asked, row.answered, row.share, row.contained) == (0, 0, None, None)
    assert backtest.by_band(backtest.answers(known, engines)).collect() == []
