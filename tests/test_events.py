from pyspark.sql import functions as F

from tidegauge.functions.fixed import FILLER
from tidegauge.operators import events, parsing, places

STATEMENT = "array<struct<pos:int,date:string,statement:string,is_no_event:boolean>>"


def statements(*told):
    return [(k, d, s, s.startswith("No")) for k, (d, s) in enumerate(told)]


def table(spark, rows):
    return spark.createDataFrame(rows, f"row_id int, event int, st {STATEMENT}, dates array<string>")


def test_buckets(spark):
    st = statements(("2020-01-05", "b"), ("2020-01-03", "a"), ("2020-01-05", "c"), ("2020-01-06", "d"), ("2020-01-20", "late"), ("2020-01-04", "No"))
    rows = [(1, 9, st, ["2020-01-05", "2020-01-08", "2020-01-10"]), (2, 9, statements(("x", "y")), ["2020-01-01"])]
    got = sorted(tuple(r) for r in events.consolidated(table(spark, rows), "row_id", "st").collect())
    assert got == [(1, "2020-01-05", "a b c"), (1, "2020-01-08", "d"), (1, "2020-01-10", FILLER), (2, "2020-01-01", FILLER)]
    packed = {r["row_id"]: r["consolidated"] for r in events.repacked(events.consolidated(table(spark, rows), "row_id", "st"), "row_id").collect()}
    assert packed[1] == f"[2020-01-05: a b c 2020-01-08: d 2020-01-10: {FILLER} ]"


SAMPLE = {
    0: [("2022-07-13", "No events")] + [("2022-07-18", "The lake fire started."), ("2022-07-18", "An evacuation order was issued.")] + [("2022-07-23", "No events")] * 2,
    2: [("2022-07-13", "w"), ("2022-07-18", "x"), ("2022-07-23", "y"), ("2022-07-28", "z"), ("2022-08-02", "Information on it is not provided")],
    4: [("2022-05-01", "No event from the provided article is associated")] * 4,
}


def test_sample_rows(spark):
    """The bucket counts of the sample rows with both sets of dates; the row that tells nothing is dropped."""
    packed = [(k, " ".join(f"{d}: {s}" for d, s in v)) for k, v in SAMPLE.items()]
    rows = spark.createDataFrame(packed, "row_id int, t string").select("row_id", F.col("row_id").alias("event_id"), parsing.dated_statements(F.col("t")).alias("st"))
    counts = {}
    for name, dates in {"fallback": {0: ["2022-07-18", "2022-07-28"], 2: ["2022-07-18", "2022-07-28"], 4: ["2022-05-01"]}, "demo": {2: ["2022-07-13", "2022-07-18", "2022-07-28"], 4: ["2022-05-01", "2022-05-04"]}}.items():
        d = spark.createDataFrame(list(dates.items()), "event int, dates array<string>")
        for r in events.consolidated(events.kept_rows(rows, d, "event_id", "st"), "row_id", "st").collect():
            counts[name, r["row_id"], r["image_date"]] = 0 if r["statements"] == FILLER else r["statements"]
    assert counts["fallback", 0, "2022-07-28"] == 0 and "evacuation" in counts["fallback", 0, "2022-07-18"]
    assert counts["fallback", 2, "2022-07-18"] == "w x" and counts["fallback", 2, "2022-07-28"] == "y z"
    assert [counts["demo", 2, d] for d in ("2022-07-13", "2022-07-18", "2022-07-28")] == ["w", "x", "y z"]
    assert not any(k[1] == 4 for k in counts)


def test_rows_that_are_skipped(spark):
    dates = spark.createDataFrame([(1, [f"2020-01-0{k}" for k in range(1, 10)]), (2, [f"2020-01-0{k}" for k in range(1, 9)]), (3, [])], "event int, dates array<string>")
    rows = spark.createDataFrame([(k, e, st) for k, (e, st) in enumerate([(1, statements(("a", "b"))), (2, statements(("a", "b"))), (2, []), (2, statements(("a", "No"))), (3, statements(("a", "b"))), (4, statements(("a", "b"))), (None, statements(("a", "b")))])], f"row_id int, event_id int, st {STATEMENT}")
    assert [r["row_id"] for r in events.kept_rows(rows, dates, "event_id", "st").collect()] == [1]


def test_image_names(spark):
    rows = [(1, ["e/1/1_2020-01-02.jpg", "e/1/1_cloud_2020-01-03.jpg", None, "e/1/x.jpg"]), (1, ["e/1/1_2020-01-02.jpg"]), (2, None), (3, []), (None, ["e/1_2020-01-01.jpg"])]
    files = events.image_files(spark.createDataFrame(rows, "f int, video array<string>"), "f", "video")
    get = lambda df: {r["event"]: r[1] for r in df.collect()}
    assert get(events.image_dates(files)) == {1: ["2020-01-02", "2020-01-03"]} and get(events.image_dates(files, True)) == {1: ["2020-01-02"]}
    assert get(events.image_paths(files)) == {1: ["e/1/1_2020-01-02.jpg", "e/1/1_cloud_2020-01-03.jpg", "e/1/x.jpg"]}


def test_kinds_and_beginnings(spark):
    df = spark.createDataFrame([("A wildfire burned",), ("Water level fell after the storm surge",), ("The Red River rose",), ("nothing",), ("",)], "t string")
    got = [tuple(r) for r in df.select(events.keyword_type(F.col("t")), events.description(F.col("t"))).collect()]
    assert got == [("Fire", "fire"), ("Flood", "storm"), ("Unknown", "Red River rose"), ("Unknown", "event"), ("Unknown", "event")]
    kind = "e array<struct<pos:int,date:string,event:string>>"
    rows = [([(0, "d0", "short"), (1, "d1", "a long text about a thing"), (2, "d2", "It Began here")],), ([(0, "d0", "short"), (1, "d1", "a long text about a thing")],), ([(0, "d0", "short")],), ([],)]
    assert [r[0] for r in spark.createDataFrame(rows, kind).select(events.begin_date(F.col("e"))).collect()] == ["d2", "d1", "d0", None]


def test_first_and_top_rows(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c"), (None, "d")], "k int, v string")
    assert sorted((r["k"] or 0, r["v"]) for r in events.first_rows(df, "k", "v").collect()) == [(0, "d"), (1, "a"), (2, "c")]
    assert sorted((r["k"] or 0, r["v"], r["rank"]) for r in events.top_rows(df, "k", 2, "v").collect()) == [(0, "d", 1), (1, "a", 1), (1, "a", 2), (2, "c", 1)]


def test_types(spark):
    rows = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "row_id int, event_id int")
    types = spark.createDataFrame([(10, "Fire"), (11, None)], "event int, event_type string")
    get = lambda df: {r["row_id"]: r["event_type"] for r in df.collect()}
    assert get(events.with_type(rows, types, "event_id")) == {1: "Fire", 2: "natural disaster", 3: "natural disaster"}
    assert set(get(events.with_type(rows, types, "event_id", parity=True)).values()) == {"natural disaster"}


PLACE = "array<struct<pos:int,name:string,lat:double,lon:double>>"


def test_centres_against_all_candidates(spark):
    import random

    rng = random.Random(3)
    rows = [(k, [(i, "n", round(40 + rng.uniform(0, 0.2), 2), round(10 + rng.uniform(0, 0.2), 2)) for i in range(rng.randint(0, 8))], round(40 + rng.uniform(0, 0.2), 2), round(10.1, 2)) for k in range(60)]
    rows += [(100, [(0, "n", 40.0, 10.0)], None, 1.0), (101, None, 40.0, 10.0), (102, [(0, "n", 1.0, 1.0)], 40.0, 10.0)]
    expected = {}
    for k, p, y, x in rows:
        if not p or y is None:
            continue
        lats, lons, best = [q[2] for q in p] + [y], [q[3] for q in p] + [x], (0, None, None)
        for a in lats:
            for b in lons:
                n = sum(abs(u - a) <= 0.05 and abs(v - b) <= 0.05 for u, v in zip(lats, lons))
                if n > best[0] and a - 0.05 <= y <= a + 0.05 and b - 0.05 <= x <= b + 0.05:
                    best = (n, a, b)
        if best[0]:
            expected[k] = best
    df = spark.createDataFrame(rows, f"k int, places {PLACE}, flat double, flon double")
    assert {r["k"]: (r["n"], r["lat"], r["lon"]) for r in places.best_centres(df, "k", "places", "flat", "flon").collect()} == expected


def test_boxes_and_windows(spark):
    df = spark.createDataFrame([([(0, "a", 1.0, 5.0), (1, "b", -1.0, 7.0)],), ([],)], f"p {PLACE}")
    got = [r[0] for r in df.select(places.bounding_box(F.col("p"))).collect()]
    assert tuple(got[0]) == (5.0, -1.0, 7.0, 1.0) and got[1] is None
    df = spark.createDataFrame([("2020-01-03", "2020-01-10T00:00:00.000Z"), ("2020-01-03", None), ("bad", "x")], "b string, e string")
    got = [r[0] for r in df.select(places.window_of(F.col("b"), F.col("e"))).collect()]
    assert (str(got[0]["first"]), str(got[0]["last"])) == ("2019-12-29", "2020-01-15") and got[1]["last"] is None and got[2]["first"] is None


def test_catalogue_falls_back(spark):
    import datetime as d

    day = lambda n: d.date(2020, 1, n)
    events_ = spark.createDataFrame([(1, 40.0, 10.0, day(1), day(10)), (2, 40.0, 10.0, day(1), day(10))], "event int, lat double, lon double, first date, last date")
    images = [(1, 1, day(2), 40.0, 10.0), (1, 1, day(2), 40.0, 10.0), (1, 0, day(10), 40.0, 10.0), (1, 0, day(3), 41.0, 10.0), (1, 2, day(3), 40.0, 10.0), (2, 0, day(1), 40.04, 10.0), (2, 1, day(2), 40.0, 10.0), (3, 0, day(2), 40.0, 10.0)]
    df = spark.createDataFrame(images, "event_hint int, source int, image_date date, lat double, lon double")
    got = sorted((r["event"], r["source"], r["image_date"].day) for r in places.catalogue_scan(events_, df).collect())
    assert got == [(1, 1, 2), (2, 0, 1)]
