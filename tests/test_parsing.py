import pytest
from pyspark.sql import functions as F

from tidegauge.functions.fixed import NO_EVENT_GENERATED, NO_EVENT_TEMPLATED
from tidegauge.functions.geo import to_pixel
from tidegauge.operators import links, parsing


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t")).alias("r")).first()["r"]


def test_dated_statements(spark):
    text = "lead 2020-01-01:  It\nrained. 2020-01-02: No events here 2020-01-03: 1999-2001 zone: x"
    got = one(spark, parsing.dated_statements, text)
    assert [(r["pos"], r["date"], r["statement"], r["is_no_event"]) for r in got] == [(0, "2020-01-01", "It rained.", False), (1, "2020-01-02", "No events here", True), (2, "2020-01-03", "1999-2001 zone: x", False)]
    assert one(spark, parsing.dated_statements, "") == [] and one(spark, parsing.dated_statements, None) is None


def test_event_list_takes_ranges_for_events(spark):
    text = "['2020-01-01: a 1999-2001 zone: c 2020-01-02 no colon']"
    got = [(r["date"], r["event"]) for r in one(spark, lambda c: parsing.event_list(c, NO_EVENT_TEMPLATED), text)]
    assert got == [("2020-01-01", "a"), ("1999-2001 zone", "c")]
    filler = "2020-01-01: No known significant events reported for this timeframe."
    assert one(spark, lambda c: parsing.event_list(c, NO_EVENT_TEMPLATED), filler) == []
    assert len(one(spark, lambda c: parsing.event_list(c, NO_EVENT_GENERATED), filler)) == 1  # the other phrases let it pass


def test_numbered_texts(spark):
    df = spark.createDataFrame([([(0, "d", "a"), (3, "d", "b")],), ([],)], "e array<struct<pos:int,date:string,event:string>>")
    assert [r[0] for r in df.select(parsing.numbered_texts(F.col("e"))).collect()] == [{0: "a", 1: "b"}, {}]


def test_links(spark):
    df = spark.createDataFrame([("http://a.gov/x",), ("http://b/x",), (None,)], "url string")
    assert [r["url"] for r in links.kept_links(df).collect()] == ["http://b/x"] and links.kept_links(df, strict=False).count() == 2
    df = spark.createDataFrame([("a", None, 3)], "x string, y string, z int")
    assert df.select(links.search_text("x", "y", "z")).first()[0] == "a nan 3"


def test_place_map(spark):
    text = "7,u,(1, 2),{' \"Alder  Creek\"': (1.5, -2.0), 'Route 9: X': (1, 2), 'B/C': (3, 4), 'bad': (x, 1), 'B/C': (5, 6)},[z]"
    got = [(r["name"], r["lat"], r["lon"]) for r in one(spark, parsing.place_map, text)]
    assert got == [("Alder Creek", 1.5, -2.0), ("B C", 5.0, 6.0)]
    assert one(spark, parsing.place_map, "{}") == [] and one(spark, parsing.place_map, None) is None


def test_records_by_pattern_and_by_commas(spark):
    line = '3,"u,(1.0, 2.0),{""a"": (1, 2)},[2020-01-01: x [y] z]"'
    got = one(spark, parsing.record_fields, line + " \r")
    assert (got["id"], got["url"], got["coordinates"], got["statements"]) == ("3", '"u', "1.0, 2.0", "2020-01-01: x [y] z") and '"' not in got["locations"]
    assert one(spark, parsing.record_fields, "no record") is None
    got = one(spark, parsing.comma_fields, "3,u,(1.5, -2.5),{},[a] b]")
    assert (got["id"], got["lat"], got["lon"], got["events"]) == ("3", 1.5, -2.5, "[a]")  # the first bracket ends it
    assert one(spark, parsing.comma_fields, "3,u,x,(1.5, -2.5)")["lat"] is None  # a comma in the url


def test_reassembly(spark):
    lines = [(1, "head"), (2, "5,a"), (3, ""), (4, "b"), (5, None), (6, "6,c"), (250_000, "d"), (250_001, "7,e")]
    df = spark.createDataFrame(lines, "line_no long, raw_line string")
    got = sorted(tuple(r) for r in parsing.reassembled(df, "line_no", "raw_line").collect())
    assert got == [(-1, "head"), (2, "5,ab"), (6, "6,cd"), (250_001, "7,e")]
    assert parsing.reassembled(df.limit(0), "line_no", "raw_line").collect() == []


@pytest.mark.parametrize("text, exact, names", [("x [a, b] y", False, ["a", " b"]), ("a, b", False, ["a", " b"]), ("a, bc", True, ["a", " b"]), ("", False, [""])])
def test_place_list(spark, text, exact, names):
    assert one(spark, lambda c: parsing.place_list(c, exact), text) == names


def test_html(spark):
    got = one(spark, parsing.html_parts, "<html><title>A <b>b</b></title><p class='x'>one</p><p>two\nlines</p></html>")
    assert tuple(got) == ("A b", "one two\nlines")
    assert tuple(one(spark, parsing.html_parts, "<p>x</p>")) == ("No title found", "x")
    assert tuple(one(spark, parsing.html_parts, "")) == ("No title found", "")
    for page, content in (
        ("<svg><path d='M'/></svg><div>menu</div><p>real</p>", "real"), ("<pre>code</pre><p>x</p>", "x"), ("<P>big</P><param><picture>y</picture>", "big"), ("<p>a &amp; b &lt;c&gt; &#39;d&#39;</p>", "a & b <c> 'd'"),
        ("<p>one<p>two<div>no</div>", "one two"), ("<!-- <p>no</p> --><p>a<script>x<p>y</p></script>b<style>p{}</style></p>", "ab"), ("<ul><li><p>in</ul> out", "in"), ("<p", ""), ("plain", ""), ("<p></p><p>x</p>", " x"),
    ):
        assert one(spark, parsing.html_parts, page)["content"] == content, page
    assert tuple(one(spark, parsing.html_parts, "<TITLE>A &amp; B</TITLE><title>C</title>")) == ("A & B", "")
    assert tuple(one(spark, parsing.html_parts, None)) == ("No title found", None)


def test_positional_fields(spark):
    assert one(spark, parsing.positional_fields, "1,Fire,a,b,TX,C,N,1.5,-2,extra")["longitude"] == -2.0
    assert one(spark, parsing.positional_fields, "1,Fire,a,b,TX,C,N,x,-2") is None and one(spark, parsing.positional_fields, "1,2") is None


def test_augmented_names_are_literal(spark):
    df = spark.createDataFrame([("At A.B and AxB, Red Fork.", [("A.B", 1, 2), ("Red Fork", 3, 4), ("Fork", 5, 6)])], "t string, p array<struct<name:string,x:int,y:int>>")
    assert df.select(parsing.augmented(F.col("t"), F.col("p")).alias("r")).first()["r"] == "At A.B (1, 2) and AxB, Red Fork (5, 6) (3, 4)."


CHOICES = "**Question 1:** q1?\nA) a\nB) b\n**Correct Answer 1:** A\n**Question 2:** q2?\nA) c\n**Correct Answer 2:** B\n"


def test_generated_choices(spark):
    whole = CHOICES + "**Question 3:** q3?\nD) d\nx\n**Correct Answer 3:** D"
    df = spark.createDataFrame([(1, whole), (2, CHOICES), (3, whole.replace("A) a\nB) b\n", "")), (4, ""), (5, None)], "id int, t string")
    got = {(r["id"], r["pos"]): r for r in parsing.generated_choices(df, "id", "t").collect()}
    assert sorted(got) == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 2), (3, 3)]  # without question 3, question 2 goes too
    assert got[1, 1]["question"] == "q1?" and [tuple(o) for o in got[1, 1]["options"]] == [("A", "a"), ("B", "b")] and got[1, 3]["correct_answer"] == "D"


def test_generated_answers(spark):
    got = one(spark, parsing.generated_answers, "**Question 1:** a?**Answer 1:** b.**Question 2:** c?**Answer 2:** d.")
    assert [(r["question"], r["answer"]) for r in got] == [("a?", "b."), ("c?", None), (None, None)]


def test_judge_scores(spark):
    df = spark.createDataFrame([("FACTUAL ACCURACY: 4/5\nCOMPLETENESS: 4.5/5\nOVERALL SCORE:3/5",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(*parsing.judge_scores(F.col("t"))).collect()]
    assert got[0] == (4, 0, 0, 0, 0, 3) and got[1] == got[2] == (0,) * 6


def test_bare_question(spark):
    assert one(spark, parsing.bare_question, "a\n<video>\nq?>rest") == "\nq?" and one(spark, parsing.bare_question, "q?") == "q?"


def test_pixels_are_cut_toward_zero(spark):
    df = spark.createDataFrame([(-0.7 - 256.0, 0.0), (0.04, 0.0), (float("nan"), 0.0)], "v double, c double")
    assert [r[0] for r in df.select(to_pixel(F.col("v"), F.col("c"), 512)).collect()] == [0, 256, None]
