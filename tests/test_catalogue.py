"""Every query of the core against its SQL on the smallest tables."""

import pytest

from quillspark.plans import catalogue
from tests.compare import connect, differences

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()

#: Queries that SQL can't state; their rows are compared with plain computations in test_sources_and_judging.py.
TESTED_BY_VALUE = {"a24_rouge_l", "a24_rouge_stemmed", "a25_meteor", "a25_meteor_stemmed", "w09_peaks", "w10_piecewise_segments"}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    if name in SQL:
        assert differences(spark, con, data, QUERIES[name], SQL[name]) == []
    else:
        df = QUERIES[name](spark, data)
        assert name in TESTED_BY_VALUE and 0 < df.count() == df.distinct().count()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
