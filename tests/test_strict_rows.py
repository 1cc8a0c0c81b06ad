import pytest
from hypothesis import given, settings, strategies as st

from tidegauge.sources.strict_rows import Fail, failed_rows, load_rows, parse

INNER = "12,https://a.example/x,8,(40.5, -100.25),{'Alder: North': (1.0, 2), \"O'Birch, Ohio\": (-3.5, 4)},[2020-01-02: It [left] rained (up 3 percent). 2020-02-29: Crews' line held.]"
GOOD = INNER.replace('"O\'Birch, Ohio"', "'Birch, Ohio'")
QUOTED = '12,"' + INNER[3:].replace('"', '""') + '"'


@pytest.mark.parametrize("line", [GOOD, QUOTED, GOOD + "  \r\n", QUOTED + "\r", "7,u,(1, 2),{'a': (1, 2)},[2020-01-01: x]"])
def test_well_formed(line):
    assert len(parse(line).statements) in (1, 2)


def test_parts():
    p = parse(QUOTED)
    assert (p.event_id, p.url, p.lat, p.lon) == ("12", "https://a.example/x,8", 40.5, -100.25)
    assert p.places == [("Alder: North", 1.0, 2.0), ("O'Birch, Ohio", -3.5, 4.0)]
    assert p.statements == [("2020-01-02", "It [left] rained (up 3 percent)."), ("2020-02-29", "Crews' line held.")]


@pytest.mark.parametrize(
    "line, reason",
    [
        ("", "column_count"), ("12", "column_count"), ('12,""', "column_count"), ("12,https://a.example/x", "column_count"),
        ("12,u,(1, 2)", "column_count"), ("12,u,(1, 2),{'a': (1, 2)}", "column_count"), ("12,u,(1, 2),[2020-01-01: x]", "column_count"),
        ("12,u,{'a': (1, 2)},[2020-01-01: x]", "column_count"), ("12,(1, 2),{'a': (1, 2)},[2020-01-01: x]", "column_count"), (GOOD + ",2", "column_count"), (GOOD + ",[]", "column_count"), (GOOD + ",{}", "column_count"), (GOOD.replace("(40.5, -100.25)", "(40.5, -100.25),(40.5, -100.25)"), "column_count"),
        (QUOTED[:-1] + ',2"', "column_count"), (QUOTED + ",2", "column_count"),
        (QUOTED[:-1], "broken_quote"), (QUOTED.replace('12,"', "12,", 1), "broken_quote"), (QUOTED.replace("a.example", 'a.ex"ample'), "broken_quote"), (GOOD.replace("'Alder", "Alder"), "broken_quote"),
        (GOOD.replace("North'", "North"), "broken_quote"), (INNER, "broken_quote"), (QUOTED.replace('""O', "O", 1), "broken_quote"),
        (GOOD.replace("(40.5", "40.5"), "unclosed_bracket"), (GOOD.replace("-100.25)", "-100.25"), "unclosed_bracket"), (GOOD.replace("{'", "'", 1), "unclosed_bracket"), (GOOD.replace(")}", ")"), "unclosed_bracket"),
        (GOOD.replace("4)}", "4}"), "unclosed_bracket"), (GOOD.replace("[2020", "2020"), "unclosed_bracket"), (GOOD[:-1], "unclosed_bracket"), (GOOD[:-20], "unclosed_bracket"),
        ("x" + GOOD, "invalid_value"), ("1.5" + GOOD[2:], "invalid_value"), (GOOD[2:], "invalid_value"), (GOOD.replace("40.5", "nan"), "invalid_value"), (GOOD.replace("40.5", "90.1"), "invalid_value"),
        (GOOD.replace("(1.0, 2)", "(1.0, )"), "invalid_value"), (GOOD.replace("(1.0, 2)", "(1.2.3, 2)"), "invalid_value"), (GOOD.replace("02-29", "02-30"), "invalid_value"), (GOOD.replace("2020-01-02", "2020-13-01"), "invalid_value"),
    ],
)
def test_reasons(line, reason):
    with pytest.raises(Fail) as e:
        parse(line)
    assert str(e.value) == reason


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="12,()[]{}'\": -.ab\n", max_size=120))
def test_any_line_has_an_outcome(line):
    try:
        parse(line)
    except Fail as e:
        assert str(e) in {"column_count", "broken_quote", "unclosed_bracket", "invalid_value"}


def test_tables(spark):
    long = GOOD[:-1] + " word" * 100_000 + "]"
    lines = [(1, GOOD, "x"), (2, GOOD, "x"), (3, None, "x"), (4, "", "x"), (5, GOOD[:-1], None), (6, long, None), (7, QUOTED, None), (None, GOOD, None)]
    df = spark.createDataFrame(lines, "line_no long, raw_line string, reason string")
    assert sorted(r["line_no"] for r in load_rows(df).collect()) == [1, 2, 6, 7]
    assert sorted(tuple(r) for r in failed_rows(df).collect()) == [(3, "column_count"), (4, "column_count"), (5, "unclosed_bracket")]
    assert load_rows(df.limit(0)).collect() == [] and failed_rows(df.limit(0)).collect() == []
