import pytest

from tidegauge.llm import residue
from tidegauge.llm.statements import statements

NEWS = [
    "Crews held the line at Red Fork, while {} homes were checked.",
    "High water covered {} barns at Elm Bayou (up 3 percent).",
    "A page of the Elm Bayou log listed {} requests that timed out.",
    "Forms at Red Fork ask for name, county and count of {} barns.",
    "Nothing visible was reported for this date.",
    "Officials [left] toured Red Fork with {} people, see [2].",
    "The script of the siren test at Red Fork was read at {}.",
    "Fewer than <{} percent of wells at Elm Bayou were tested.",
]
BAD = [
    "404 Not Found - the page /x/{} does not exist.", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Dear reader, the event is {{{{ event_type }}}}.",
    "Crews reached ${{place}} and counted {} acres.", "The [INSERT NAME] near Red Fork grew by {} acres.", "%(count)s", "__COUNTY__", "<ACRES>", "TBD TBD TBD", "Sorry, we could not find the page you were looking for.",
]


def passages(spark):
    texts = [(t.format(k), 0) for k in range(40) for t in NEWS] + [(t.format(k), 1) for k in range(3) for t in BAD]
    return spark.createDataFrame([(k, 0, t, y) for k, (t, y) in enumerate(texts)], "id long, pos int, text string, residue int")


def test_learns_and_judges(spark):
    df = passages(spark)
    model = residue.fit(df)
    got = {r["id"]: r["residue"] for r in residue.judge(df, model).collect()}
    assert all(got[r["id"]] == bool(r["residue"]) for r in df.collect())
    # Held out: other wordings with the same vocabulary.
    new = spark.createDataFrame([(1, 0, "Sorry, the page was not found."), (2, 0, "To view this page please enable JavaScript"), (3, 0, "Crews checked 12 homes at Elm Bayou."), (4, 0, "High water was reported at Red Fork for this date.")], "id long, pos int, text string")
    assert {r["id"]: r["residue"] for r in residue.judge(new, model).collect()} == {1: True, 2: True, 3: False, 4: False}


def test_residue_within_long_news(spark):
    """Trusted passages stay residue whatever stands around them, and so does residue that no phrase marks."""
    model = residue.fit(passages(spark))
    news = " ".join(t.format(7) for t in (NEWS[0], NEWS[1], NEWS[3], NEWS[6], NEWS[7]))
    rows = [(1, 0, news), (2, 0, news.replace("homes", "{{place}}", 1)), (3, 0, news + " Lorem ipsum dolor sit amet. " + news), (4, 0, news + " Sorry, the page you were looking for could not be found, please enable JavaScript. " + news)]
    got = {r["id"]: (r["residue"], r["trusted"], r["probability"] == 1) for r in residue.judge(spark.createDataFrame(rows, "id long, pos int, text string"), model).collect()}
    assert got[1] == (False, False, False) and all(got[k] == (True, True, True) for k in (2, 3, 4))
    other = news + " Sorry, the page was not found. To view this page please enable your JavaScript now. " + news
    assert [(r["residue"], r["trusted"]) for r in residue.judge(spark.createDataFrame([(5, 0, other)], "id long, pos int, text string"), model).collect()] == [(True, False)]
    parts = residue.windows(" ".join(map(str, range(40))))
    assert set(" ".join(parts).split()) == set(map(str, range(40))) and residue.windows(None) == [""]


def test_edges(spark):
    model = residue.fit(passages(spark))
    rows = [(1, 0, None), (1, 1, ""), (1, 2, "word " * 50_000), (2, 0, "TBD TBD TBD"), (2, 0, "TBD TBD TBD"), (None, 0, "x"), (3, None, "x")]
    df = spark.createDataFrame([(*r, "y") for r in rows], "id long, pos int, text string, trusted string")
    judged = residue.judge(df, model)
    got = sorted((r["id"], r["pos"], r["residue"]) for r in judged.collect())
    assert [g[:2] for g in got] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 0)] and [got[k][2] for k in (0, 1, 3, 4)] == [False, False, True, True]
    counts = {r["id"]: (r["passages"], r["exclude"]) for r in residue.records(judged).collect()}
    assert counts == {1: (3, False), 2: (2, True)}
    assert residue.judge(df.limit(0), model).collect() == []
    empty = residue.fit(df.limit(0))
    assert residue.judge(df.limit(1), empty).count() == 1


@pytest.mark.parametrize("text", ["{{ a }}", "${place}", "<%= name %>", "%(count)s", "__ACRES__", "{event_type}", "{name}", "<EVENT_TYPE>", "[INSERT COUNT]", "[name here]", "x {{ y }} z"])
def test_placeholders(text):
    assert residue.has_placeholder(text) and residue.is_trusted(text)


@pytest.mark.parametrize("text", ["[left]", "see [2], [3]", "<5 percent", "{est}", "a < b > c", "<br>", "50% (of) s", "Dr. __", "[map]"])
def test_no_placeholders(text):
    assert not residue.has_placeholder(f"Crews {text} came.")


def test_statements(spark):
    df = spark.createDataFrame([(1, "[2020-01-01: a b. 2020-01-02 - {name}]", 0), (2, None, 0), (3, "none", 0), (None, "2020-01-01: x", 0)], "row_id long, statements string, pos int")
    got = [(r["id"], r["pos"], r["date"]) for r in statements(df, "row_id", "statements").collect()]
    assert got == [(1, 0, "2020-01-01"), (1, 1, "2020-01-02")]


FAMILIES = [
    "404 Not Found - the page /x/{} does not exist.", "403 Forbidden", "Please enable JavaScript to view this page.", "Scripts must be on for this story, reader.", "Lorem ipsum dolor sit amet.", "Write your own summary in this box.",
    "asdf qwer asdf", "tbd tbd tbd", "Oops! Wrong link.", "Your session is over, sign in again.", "Too many calls, slow down please.", "This browser is too old.",
]
STORIES = [
    "Crews held the line at {}, while {} homes were checked.", "High water covered {1} barns at {0}.", "A page of the {} log listed {} requests that timed out.", "Forms at {} ask for name, county and count of {} barns.",
    "Officials toured {} with {} people.", "The script of the siren test at {} was read at {}.", "Fewer than {1} percent of wells at {0} were tested.", "The road to {} was closed {} days.",
    "Ash fell on {} through {}.", "Access was denied to trucks over {1} tons at {0}.",
]


@pytest.mark.parametrize("phrases", [residue.TRUSTED, residue.TRUSTED[:2], residue.TRUSTED[-1:]])
def test_families_held_out(spark, phrases):
    """Families whose wordings no trusted record holds are found by the model, however often they are repeated; real kinds aren't."""
    places = [f"{a}{b} Fork" for a in ("Elm", "Red", "Pine", "Oak") for b in ("ton", "dale", "burg", "wick", "mere", "by")]
    things = "barns homes docks fences wells trucks bridges people silos pumps".split()
    real = [f"{t.format(p, k + 2)[:-1]} near {k} {o}." for t in STORIES for o in things for k, p in enumerate(places[:8])] + ["Nothing was reported for this date."] * 200 + [f"Crews logged {k} acres {w} of {p}." for k, p in enumerate(places) for w in ("north", "south", "uphill")]
    bad = [t.format(k) for t in FAMILIES for k in range(30)] + [f"Crews reached {{{{ {w} }}}} and counted 3 {o}." for w in ("place", "name") for o in ("barns", "homes", "docks", "fences", "wells")]
    df = spark.createDataFrame([(k, 0, t) for k, t in enumerate(real + bad)], "id long, pos int, text string")
    judged = residue.fit_and_judge(df, phrases=phrases).collect()
    found = {r["id"] for r in judged if r["residue"]}
    held_out = {r["id"] for r in judged if r["id"] >= len(real) and not r["trusted"]}
    assert len(judged) == len(real + bad) and not any(k < len(real) for k in found)
    assert len(held_out & found) >= 0.9 * len(held_out) > 150


def test_wording():
    assert residue.wording("Crews reached Elm Fork by 4:00.") == (["crews", "reached", "by"], "Elm Fork", True)
    assert residue.wording("Elm Fork lost power. Crews came") == (["lost", "power", "crews", "came"], "Elm Fork", False)
    assert residue.wording("Page Not Found") == (["page", "not", "found"], "", False) and residue.wording("PAGE /a/b {{x}}")[0] == ["page", "_path", "_placeholder"]
    assert residue.wording(None) == ([], "", False)
