import importlib.util
import sys

import pytest

import __spark_entry__
from ledgerloom.plans.queries import ORACLES, QUERIES

from oracle import rows_of_spark, rows_of_sql, same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    names, rows = rows_of_spark(QUERIES[name](spark, SF))
    sql_names, sql_rows = rows_of_sql(ORACLES[name], SF)
    assert names == sql_names
    assert rows and same(rows, sql_rows)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 6000


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_on_executors(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "PythonUDF" not in plan and "EvalPython" not in plan


def test_filter_and_columns_reach_the_scan(spark):
    plan = QUERIES["active_only"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_linestatus,O)" in plan and "l_shipdate" not in plan


def test_record_queries_stay_where_the_text_operators_cannot_be_imported(monkeypatch):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("ledgerloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    if importlib.util.find_spec("ledgerloom.llm"):
        with pytest.warns(UserWarning, match="left out"):
            assert __spark_entry__.queries().keys() == QUERIES.keys()
