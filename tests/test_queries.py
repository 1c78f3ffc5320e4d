"""Every registered query against its SQL, and the entry point."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry_point
from oracle import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_query(spark, con, name):
    df = entry_point.queries()[name](spark, SF_DIR)
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, con, sql) is None


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["project", "type", "count"] and df.count() > 0


def test_oracles_have_queries():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("missing", ["graphloom.llm", "corpus_pipeline", "xxhash"])
def test_entry_without_the_subpackage(missing):
    """Without llm/, the pipeline or an extra they need the other queries are there all the same."""
    code = (
        f"import sys; sys.modules['{missing}'] = None; import __spark_entry__ as e; "
        "assert len(e.queries()) > 100 and not any(n.startswith('op') for n in e.queries()) and 'pipeline' not in e.oracle_sql()"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
