import os

import pytest

from tests.oracle import FOLDER, compare
from tidegauge.llm import queries, sql

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, name):
    mine, theirs = compare(spark, queries.QUERIES[name], sql.SQL.get(name))
    assert mine == theirs


def test_columns(spark):
    columns = {"p2_found": ["train_id", "test_id"], "p3_found": ["origin", "rec_id", "field_name", "defect"], "p6_found": ["row_id", "pos"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "seg_no", "true_lang"]}
    for name, expected in columns.items():
        assert queries.QUERIES[name](spark, FOLDER).columns == expected
