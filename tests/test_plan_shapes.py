"""What the optimiser makes of the queries."""

import subprocess
import sys

from quillspark.operators import relational as R
from quillspark.plans import catalogue
from quillspark.sources.tables import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_needed(spark, data):
    text = plan(R.equal_or_all(table(spark, data, "orders"), "o_orderstatus", "F").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in text
    assert "o_totalprice" not in text.split("ReadSchema:")[1]


def test_queries_stay_in_the_jvm(spark, data):
    for name in ("w04_change_points", "a23_bleu", "x12_format_score", "m05_split", "j14_history"):
        text = plan(catalogue.queries()[name](spark, data))
        assert "Python" not in text and "Arrow" not in text, name


def test_no_cartesian_products(spark, data):
    for name in ("f11_allowed", "j01_annotations_images", "a31_margins", "m08_affinities"):
        assert "CartesianProduct" not in plan(catalogue.queries()[name](spark, data)), name


def test_the_rest_works_without_the_subpackage():
    code = "import sys; sys.modules['quillspark.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p1_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=sys.path[0]).returncode == 0
