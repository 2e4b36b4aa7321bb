"""Every query against its SQL twin on the smallest tables; the others must run and have rows."""

import pytest

from compare import differences, duck
from motorfisc.plans import registry

#: Their twins take it that each sheet has more plain rows than banners, which the smallest tables are too small for.
LARGER = ("flt3_", "job2_", "job3_")
ORACLES = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def tables(sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    return {False: (sf_dir, duck(sf_dir)), True: (larger, duck(larger))}


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, tables, name):
    sf_dir, con = tables[name.startswith(LARGER)]
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_a_twin_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
