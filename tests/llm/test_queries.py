"""Queries of the subpackage on the smallest tables: SQL where there is some, and the columns asked for."""

import pytest

from quillspark.llm.queries import QUERIES, SQL
from tests.compare import connect, differences

COLUMNS = {
    "p1_found": [("annotation_id", "bigint"), ("lang", "string")],
    "p3_found": [("target_id", "int")],
    "p4_found": [("member_a", "bigint"), ("member_b", "bigint")],
    "p5_found": [("tab", "string"), ("rec_id", "bigint")],
    "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p8_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    if name in SQL:
        assert differences(spark, connect(data), data, QUERIES[name], SQL[name]) == []
    else:
        df = QUERIES[name](spark, data)
        assert COLUMNS.get(name, df.dtypes) == df.dtypes
        assert df.count() == df.distinct().count()
