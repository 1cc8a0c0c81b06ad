"""Queries that hold whole groups, in parts of bounded size."""

import datetime

from pyspark.sql import functions as F

from tidegauge.operators import ordered
from tidegauge.plans.registry import QUERIES
from tidegauge.plans import reference  # noqa: F401

DAY = datetime.datetime(2020, 1, 1)


def test_article_parts_hold_all_texts(spark, tmp_path):
    rows = [(k, 7, f"t{k}", DAY) for k in range(250)] + [(300, 8, "x", DAY), (301, None, "y", DAY), (302, 8, None, DAY)]
    spark.createDataFrame(rows, "doc_id long, event_id int, text string, crawled_at timestamp").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in QUERIES["article_concat"](spark, str(tmp_path)).collect())
    assert [(e, p, n) for e, p, _, n in got] == [(7, 0, 100), (7, 1, 100), (7, 2, 50), (8, 0, 1)]
    assert "".join(a for e, _, a, _ in got if e == 7) == "".join(f"t{k}\n" for k in range(250))


def test_all_links_are_kept(spark, tmp_path):
    rows = [(7, f"u{9 - k}", DAY + datetime.timedelta(k)) for k in range(9)] + [(7, "u9", DAY), (7, None, DAY), (8, "v", None)]
    spark.createDataFrame(rows, "event_id int, url string, found_at timestamp").write.parquet(str(tmp_path / "articles.parquet"))
    got = {(r["event_id"], r["part"]): (r["links"], r["n"]) for r in QUERIES["links_per_event"](spark, str(tmp_path)).collect()}
    assert got == {(7, 0): ("\n".join(f"u{k}" for k in range(9, 0, -1)), 9), (8, 0): ("v", 1)}


def test_paths_of_a_hot_event_stand_in_parts(spark, tmp_path):
    rows = [(7, [f"7/7_cloud_{k:03}.jpg" for k in range(j, 230, 3)]) for j in range(3)] + [(8, None), (None, ["x"]), (9, ["a", None, "a"])]
    spark.createDataFrame(rows, "folder_id int, video array<string>").write.parquet(str(tmp_path / "train_total.parquet"))
    got = sorted((r["event_id"], r["part"], r["n"], r["masks"]) for r in QUERIES["image_paths_per_event"](spark, str(tmp_path)).collect())
    assert got == [(7, 0, 100, 100), (7, 1, 100, 100), (7, 2, 30, 30), (9, 0, 1, 0)]


def test_places_of_all_lines_are_looked_up(spark, tmp_path):
    rows = [(k, f"{k},http://x/{k},(10.0, 20.0),{{'P{k}': (1.5, 2.5)}},[2020-01-01: a]") for k in range(1, 5)]
    spark.createDataFrame(rows, "line_no long, raw_line string").write.parquet(str(tmp_path / "packed_rows.parquet"))
    got = sorted((r["event_id"], r["name"], r["lat"], r["lon"]) for r in QUERIES["offline_geocode"](spark, str(tmp_path)).collect())
    assert got == [(k, f"P{k}", 1.5, 2.5) for k in range(1, 5)]


def test_numbers_within_keys(spark):
    df = spark.createDataFrame([(k % 3 if k % 2 else 0, 1000 - k) for k in range(1000)], "k int, v int")
    got = ordered.within(df, "k", "v").collect()
    for key in range(3):
        assert [r["at"] for r in sorted((r for r in got if r["k"] == key), key=lambda r: r["v"])] == list(range(sum(r["k"] == key for r in got)))
    assert ordered.within(df.limit(0), "k", "v").collect() == []


def test_fill_forward_over_spans_and_groups(spark):
    df = spark.createDataFrame([(k, k if k in (3, 4, 50) else None) for k in range(0, 120, 1)], "n long, v long")
    got = {r["n"]: r["last"] for r in ordered.fill_forward(df, "n", F.col("v"), "last", span=4, wide=3).collect()}
    assert got == {k: None if k < 3 else 3 if k == 3 else 4 if k < 50 else 50 for k in range(120)}
