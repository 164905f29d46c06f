"""Every registered query with an oracle equals DuckDB on sf0.001."""

import pytest

from conftest import SF001
from shiftscope.plans.catalog import load_all
from shiftscope.plans.compare import compare, duck

REG = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(n for n, q in REG.items() if q.sql))
def test_matches_oracle(spark, con, name):
    ok, detail = compare(REG[name].build(spark, SF001), con, REG[name].sql)
    assert ok, detail


@pytest.mark.parametrize("name", sorted(n for n, q in REG.items() if not q.sql))
def test_rows_only_queries_run(spark, name):
    df = REG[name].build(spark, SF001)
    assert len(df.columns) > 0
    assert df.count() > 0


def test_entry_contract(spark):
    import importlib.util
    import os
    spec = importlib.util.spec_from_file_location(
        "spark_entry", os.path.join(os.path.dirname(os.path.dirname(__file__)), "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    out = mod.entry(spark)
    assert out.count() > 0
    qs, sqls = mod.queries(), mod.oracle_sql()
    assert set(sqls) <= set(qs)
