"""Every registered query with SQL gives the rows of its SQL, on the smallest data folder."""

from pathlib import Path

import pytest

from oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def names():
    from loomline import queries

    return sorted(queries.SQL)


@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    from loomline import queries

    assert compare(spark, con, FOLDER, name, queries.QUERIES[name], queries.SQL[name]) == ""


def test_all_are_registered():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
