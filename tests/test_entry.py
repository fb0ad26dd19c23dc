"""The driver's gate at the smallest scale: entry() and every query vs its oracle."""
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["question_id", "doc_id", "path", "score", "context", "missing"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
        return
    r = compare(df, sql, con)
    assert r["cols_match"] and r["rows_spark"] == r["rows_oracle"] and r["hash_match"], r


def test_runs_from_a_foreign_working_directory(tmp):
    """The driver imports the entry module from elsewhere with its own plain
    session: Python workers must still import the package."""
    import subprocess
    import sys
    code = (
        "import importlib.util\n"
        "spec = importlib.util.spec_from_file_location('e', %r)\n"
        "E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('ROWS', E.queries()['hash_embedding'](s, %r).count(), E.queries()['search_l2'](s, %r).count())\n"
    ) % (E.__file__, SF_SMALL, SF_SMALL)
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", code], cwd=tmp, capture_output=True, text=True, timeout=600, env=env)
    assert "ROWS" in r.stdout, r.stderr[-2000:]
