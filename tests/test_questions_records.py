from pyspark.sql import functions as F

from tidegauge.operators import ordered, questions, records

EVENTS = "array<struct<pos:int,date:string,event:string>>"


def rows(spark):
    e = [(0, "2020-01-02", "b started here and went on"), (1, "2020-01-01", "a"), (2, "2020-01-03", "c")]
    data = [(1, e, "Fire"), (2, e[:2], "Fire"), (3, [], "Fire"), (4, e, "natural disaster"), (5, e + [(3, "2020-01-03", "d")], "Hurricane")]
    return spark.createDataFrame(data, f"row_id int, events {EVENTS}, event_type string")


def check(made):
    for r in made:
        shown = [o[3:] for o in r["options"]]
        assert shown.count(r["correct"]) >= 1 and r["options"][ord(r["label"]) - 97] == f"{r['label']}. {r['correct']}"
        assert [o[:3] for o in r["options"]] == [f"{chr(97 + k)}. " for k in range(len(shown))]
    return {r["row_id"]: r for r in made}


def test_dates_and_types(spark):
    got = check(questions.temporal_grounding(rows(spark), "row_id").collect())
    assert sorted(got) == [1, 4, 5] and got[1]["correct"] == "2020-01-02" and len(got[1]["options"]) == 4
    assert got[1]["explanation"] == "The fire began on 2020-01-02 as indicated by the satellite imagery." and "{" not in got[1]["question"]
    got = check(questions.event_type(rows(spark), "row_id").collect())
    assert sorted(got) == [1, 2, 5] and len(set(got[5]["options"])) == 4
    assert check(questions.event_type(rows(spark), "row_id").collect()) == got  # it repeats
    assert questions.event_type(rows(spark).limit(0), "row_id").collect() == []


def test_sequences(spark):
    got = check(questions.event_sequence(rows(spark), "row_id").collect())
    assert sorted(got) == [1, 4, 5] and got[1]["correct"].startswith("2020-01-01: a...; 2020-01-02: b started here")


def test_small_pools_are_filled_up(spark):
    df = spark.createDataFrame([("x", ["x", "y"])], "c string, p array<string>").select(questions.options(F.col("c"), F.col("p"), 1).alias("o"))
    shown = {o[3:] for o in df.first()["o"]["options"]}
    assert len(shown) == 4 and "x" in shown and shown <= {"x", "y", "None of the above", "Cannot be determined", "No event occurred"}


def test_places(spark):
    kind = "array<struct<name:string,lat:double,lon:double,x:int,y:int>>"
    p = [("A", 1.5, 2.5, 256, 255), ("B", 3.0, 4.0, 300, 200)]
    data = [(1, p, [(0, "d", "e")], "Fire"), (2, p[:1], [(0, "d", "e")], "Fire"), (3, p, [], "Fire")]
    df = spark.createDataFrame(data, f"row_id int, places {kind}, events {EVENTS}, event_type string")
    got = check(questions.location_identification(df, "row_id").collect())
    assert sorted(got) == [1] and got[1]["correct"] in ("(256, 255)", "(300, 200)")
    # A drawn pixel that equals the right one leaves fewer options.
    tiny = check(questions.location_identification(spark.createDataFrame([(1, [("A", 1.0, 2.0, 0, 0)] * 2, [(0, "d", "e")], "Fire")], df.schema), "row_id", size=1).collect())
    assert tiny[1]["options"] == ["a. (0, 0)"]
    got = check(questions.damage_assessment(df, "row_id", "Where did the {event_type} strike?").collect())
    assert got[1]["question"] == "Where did the Fire strike?" and got[1]["correct"] in "AB"


def test_records(spark):
    df = spark.createDataFrame([(7, ["a.jpg", "b.jpg"], 1.5, -2.0, ["2020-01-01", "bad"], "t", "h", "g")], "f int, v array<string>, la double, lo double, d array<string>, t string, h string, g string")
    r = df.select(*records.record(*(F.col(c) for c in "f v la lo d t h g".split()), dataset="D", iso=True)).first()
    assert r["lat_lon"] == [[1.5, -2.0]] * 2 and r["sensor"] == ["satellite"] * 2 and r["timestamps"] == ["2020-01-01T00:00:00", None] and r["conversations"][1]["value_text"] == "g"
    df = spark.createDataFrame([("q", [("A", "x"), ("B", "y")], "B"), ("q", [("A", "x")], "B) y")], "q string, o array<struct<letter:string,text:string>>, l string")
    got = [r[1] for r in df.select(*records.generated_turns(F.col("q"), F.col("o"), F.col("l"))).collect()]
    assert got == ["The correct answer is B) y", "The correct answer is B) y) "]


def test_numbers_splits_and_merges(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(1).alias("same"))
    got = ordered.with_ordinal(df, "k").collect()
    assert sorted((r["k"], r["ordinal"]) for r in got) == [(k, k) for k in range(1000)]
    split = records.positional_split(df, "k").collect()
    assert all((r["k"] < 800) == (r["split"] == "train") for r in split)
    assert records.positional_split(df.limit(0), "k").collect() == []
    a, b = df.filter("k < 3").select("k"), df.filter("k > 997").select("k", "same")
    got = sorted((r["id"], r["k"], r["same"]) for r in records.merged([(b, ["k"]), (a, ["k"])]).collect())
    assert got == [(0, 998, 1), (1, 999, 1), (2, 0, None), (3, 1, None), (4, 2, None)]
    assert [r["k"] for r in records.every(records.merged([(df, ["k"])]), 250).sort("k").collect()] == [0, 250, 500, 750]


def test_fill_forward(spark):
    data = [(k, k if k % 7 == 0 else None) for k in range(3, 60)]
    df = spark.createDataFrame(data, "o long, v long")
    got = {r["o"]: r["f"] for r in ordered.fill_forward(df, "o", F.col("v"), "f", span=5).collect()}
    assert got == {k: (k // 7 * 7 or None) if k >= 7 else None for k in range(3, 60)}
