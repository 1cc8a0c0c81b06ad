import re

import pytest

from tidegauge.operators.packed_values import automaton, segments, spans, split_names, split_packed, statement_spans, unwrap


def names(text, known=()):
    return [v for v, _ in segments(text, automaton(sorted(known)))]


@pytest.mark.parametrize(
    "text, values",
    [
        (None, []), ("", []), ("  ", []), ("[]", []), ("{}", []), (",;|", []),
        ("Alder Creek", ["Alder Creek"]),
        ("[Alder Creek,]", ["Alder Creek"]),
        ("Alder Creek;; Birch Mesa\nCedar Fork | Dune Lake / Elm Point\tFir Bay", ["Alder Creek", "Birch Mesa", "Cedar Fork", "Dune Lake", "Elm Point", "Fir Bay"]),
        ("{'Alder Creek': (1.5, -2), \"Birch, Ohio\": (+3.0,4)}", ["Alder Creek", "Birch, Ohio"]),
        ('{" \'Route 9: Alder\'": (1.5, -2), \' "Birch; Upper Yard"\' : (3, 4);}', ["Route 9: Alder", "Birch; Upper Yard"]),
        ('("O\'Alder Creek" | Birch (old town)|)', ["O'Alder Creek", "Birch (old town)"]),
        ("'Farm Road 12/3', 'Farm Road 12/3'", ["Farm Road 12/3", "Farm Road 12/3"]),
        ("Alder: (1,2),, Birch : (3, 4)\n\"Cedar\":(5,6)", ["Alder", "Birch", "Cedar"]),
    ],
)
def test_names(text, values):
    assert names(text) == values


def test_dictionary_protects_delimiters_without_quotes():
    known = {"Birch, Ohio", "Farm Road 12/3", "Birch, Ohio; North"}
    assert names("Alder, Birch, Ohio, Farm Road 12/3", known) == ["Alder", "Birch, Ohio", "Farm Road 12/3"]
    assert names("Birch, Ohio; North / Birch, Ohio", known) == ["Birch, Ohio; North", "Birch, Ohio"]
    assert names("New Birch, Ohio", known) == ["New Birch", "Ohio"]  # not at the limit of a value


def test_statements():
    text = "['2020-01-02: Fire near X, mapped 2019-03-04, spread.', \"2020/01/05 - Out.\"] 2020-02-01 : End"
    assert [d for d, _ in statement_spans(text)] == ["2020-01-02", "2020-01-05", "2020-02-01"]
    assert statement_spans(text)[1][1].startswith("Out.")
    assert statement_spans("on 2020-01-02 it rained; 12020-01-02: no") == []
    assert statement_spans(None) == [] and statement_spans("") == []


def test_long_field():
    text = "; ".join(f"'Place {k}; Yard': (1.0, 2.0)" for k in range(20_000))
    assert len(names(text, {"Place 1; Yard"})) == 20_000
    assert unwrap("[" + text + "]") == text


def test_rows(spark):
    rows = [(1, "A One, B Two", "2020-01-01: x 2020-01-02: y", "z"), (1, "A One, B Two", None, "z"), (2, None, "", None), (3, "'C, D'", "2020-01-01: x", None), (None, "A, B", None, None)]
    df = spark.createDataFrame(rows, "row_id long, locations string, statements string, items string")
    got = sorted(tuple(r) for r in split_packed(df, "row_id", "locations", "statements").collect())
    one = [(1, "locations", 0, "A One"), (1, "locations", 1, "B Two")]
    assert got == sorted(one * 2 + [(1, "statements", 0, "2020-01-01"), (1, "statements", 1, "2020-01-02")])
    assert split_packed(df.limit(0), "row_id", "locations", "statements").collect() == []


def test_joined_dictionary_equals_sent_one(spark):
    rows = [(1, "{'Birch, Ohio': (1, 2)}"), (2, "Alder, Birch, Ohio"), (3, "[Birch, Ohio]"), (4, "x"), (5, "x")]
    df = spark.createDataFrame(rows, "id long, field string")
    collect = lambda n: sorted((r["id"], list(r["items"])) for r in split_names(df, n).collect())
    assert collect(1000) == collect(0) == [(1, ["Birch, Ohio"]), (2, ["Alder", "Birch, Ohio"]), (3, ["Birch, Ohio"]), (4, ["x"]), (5, ["x"])]


def test_delimiters_split_nothing_else():
    assert not re.search(r"[,;|/\n\t]", "".join(names("a,b;c|d/e\nf\tg")))


def test_joined_dictionary_keeps_names_with_brackets(spark):
    rows = spark.createDataFrame([(1, '"Aston (East), Barrow"; Cole'), (2, "Aston (East), Barrow; Dunn")], "id long, field string")
    sent, joined = ({r["id"]: r["items"] for r in split_names(rows, n).collect()} for n in (100, 0))
    assert sent == joined and sent[2] == ["Aston (East), Barrow", "Dunn"]


def test_stretches_of_pieces():
    assert spans("{A, B; C: (1, 2), D}", 2) == {"A, B", "B; C"} and spans("A/B/C", 3) == {"A/B", "B/C", "A/B/C"} and spans("", 3) == spans("A", 3) == set()
