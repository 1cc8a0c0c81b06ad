"""What the physical plans of the queries must and must not hold."""

import os
import re

import pytest

from tests.oracle import FOLDER
from tidegauge.plans import problems, reference, registry, storage  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_product_of_tables(spark, name):
    text = plan(registry.QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text  # no row-at-a-time Python


@pytest.mark.parametrize(
    "name, columns",
    [
        ("cloud_bit_mask", {"l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"}),
        ("csv2_record_parse", {"line_no", "raw_line"}),
        ("top5_links_per_event", {"event_id", "url", "found_at"}),
        ("image_dates_from_names", {"folder_id", "video"}),
        ("answer_counts", {"model_name", "qid", "predicted"}),
        ("judge_averages", {"ans_id", "model_name"}),
        ("p5_loaded", {"line_no", "raw_line"}),
    ],
)
def test_scans_read_only_what_is_used(spark, name, columns):
    read = re.findall(r"ReadSchema: struct<(.*?)>(?:\n|$|,? )", plan(registry.QUERIES[name](spark, FOLDER)) + "\n")
    found = {c.split(":")[0] for r in read for c in re.split(r",(?![^<]*>)", r)}
    assert found == columns


def test_filters_reach_the_scan(spark):
    assert re.search(r"PushedFilters: \[[^\]]*IsNotNull\(url\)", plan(registry.QUERIES["link_scan"](spark, FOLDER)))
    assert re.search(r"PushedFilters: \[[^\]]*IsNotNull\(raw_line\)", plan(registry.QUERIES["csv2_comma_parse"](spark, FOLDER)))


def test_pairs_of_places_stay_within_the_row(spark):
    text = plan(registry.QUERIES["geo_to_pixel"](spark, FOLDER))
    assert "Exchange" not in text
