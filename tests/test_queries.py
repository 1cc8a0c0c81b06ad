import os

import pytest

from tests.oracle import FOLDER, compare
from tidegauge.plans import problems, reference, registry, storage  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, name):
    mine, theirs = compare(spark, registry.QUERIES[name], registry.SQL.get(name))
    assert mine == theirs


def test_all_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["row_id", "image_date", "statements"]
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
