import pytest

from tests.llm.test_language import SAID
from tidegauge.functions.words import words
from tidegauge.llm import answers, language

ASKED = "Look at 3 scenes.\n<video>\nChoose one. What changed around Red Fork between the first and the last image?\na. Fire\nb. No event on these days\nc. A long option text that has no stop at all"
PLAIN = "Here is a series of frames:\n<video>\nWhere did the crews set up the line against the fire?"


@pytest.fixture(scope="module")
def model():
    return language.train([(k, s) for k, t in SAID.items() for s in t.split(". ") for _ in range(5)])


CASES = [
    (None, "empty"), ("", "empty"), (" \n", "empty"), ("...", "empty"), ("<br>", "empty"), ("​", "empty"), ("N/A", "empty"), ("(no answer)", "empty"), ("b. null", "empty"),
    ("b", None), ("(B)", None), ("c)", None), ("b. 2021-03-18", None), ("a. (12, 13)", None), ("Red Fork", None), ("27,960 homes", None), ("The north side of Red Fork", None), ("b. No event on these days", None),
    ("c. A long option text that has no stop at all", None), ("The answer is c.", None), ("b \nThe frames show 12 barns gone.", None),
    ("What changed around Red Fork between the first and the last image?", "copied_question"), ('"choose one. what changed around RED FORK between the first and the last image"', "copied_question"),
    ("Answer: What changed around Red Fork between the first and the last image?", "copied_question"), ("What changed around Red Fork between the first and the last image? " * 2, "copied_question"),
    ("What changed around Red Fork between the first and the last image: 12 barns were lost near Red Fork.", None), ("What changed around Red Fork between the first, which", "truncated"),
    ("I'm sorry, but I can't help with that request.", "refusal"), ("d \nAs an assistant, I must decline to answer about Red Fork.", "refusal"), ("UNFORTUNATELY, I AM UNABLE TO VIEW IMAGES.", "refusal"), ("Sorry, that is something I’d rather not comment on.", "refusal"),
    ("I cannot see flames, but crews counted 12 homes near Red Fork.", None), ("Sorry to say, 12 homes burned at Red Fork.", None), ("Officials cannot yet say what caused the fire at Red Fork.", None), ("Residents were told to leave at 4:00 and could not return until May 3.", None),
    ("The frames show 12 barns gone north of Red Fork by the", "truncated"), ("It went 5 kilometers south and stopped at (about", "truncated"), ("Crews brought 8 cots and", "truncated"), ("It was set...", "truncated"),
    (SAID["fr"], "other_language"), ("b \n" + SAID["de"], "other_language"), (SAID["zh"], "other_language"), (SAID["en"], None),
]


def table(spark, rows):
    return spark.createDataFrame(rows, "origin string, rec_id long, field_name string, question string, answer string, defect string")


#: Prompts that have nothing in common.
PROMPTS = [f"x\n<video>\n{q}" for q in ("How many barns were lost?", "Who found the first signs near Elm?", "Why was the road closed?", "Describe the damage at the creek.")]


def test_cases(spark, model):
    rows = [("o", k, "f", ASKED, a, "x") for k, (a, _) in enumerate(CASES)]
    # Refusals are known by recurring: each of the wordings stands under three other prompts, too.
    rows += [("o", 1000 + k, "f", q, a.replace(" about Red Fork", ""), "x") for q in PROMPTS[:3] for k, (a, d) in enumerate(CASES) if d == "refusal"]
    got = {r["rec_id"]: r["defect"] for r in answers.defective_answers(table(spark, rows), model).collect()}
    assert [(CASES[k][0], got.get(k)) for k in range(len(CASES))] == CASES


def test_templates_reveal_refusals(spark, model):
    """A wording that declines in no known way is found by recurring, without content, across unrelated prompts."""
    prompts = PROMPTS
    rows = [("o", k, "f", q, "Nothing about this request is for us to say.", None) for k, q in enumerate(prompts)]
    rows += [("o", 10, "f", prompts[0], "Nothing about this request is for us to say, except 12 barns.", None), ("o", 11, "f", prompts[0], "We have no reply to that sort of thing here.", None)]
    got = {r["rec_id"]: r["defect"] for r in answers.defective_answers(table(spark, rows), model).collect()}
    assert got == {k: "refusal" for k in range(4)}  # one prompt alone makes no template


def test_edges(spark, model):
    rows = [("o", 1, "f", None, "What is that?", None), ("o", 2, "f", "", SAID["fr"], None), ("o", 3, "f", PLAIN, SAID["en"].replace(".", "") * 3_000, None), ("o", 4, "f", PLAIN, None, None), ("o", 4, "f", PLAIN, None, None), (None, None, None, None, None, None), (None, 5, None, SAID["es"], SAID["es"] + " Fin", None)]
    got = sorted((r["rec_id"], r["defect"]) for r in answers.defective_answers(table(spark, rows), model).collect())
    assert got == [(3, "truncated"), (4, "empty"), (4, "empty"), (5, "truncated")]
    assert answers.defective_answers(table(spark, rows).limit(0), model).collect() == []


def test_spanish_question(spark, model):
    asked = "Aquí hay imágenes:\n<video>\n¿Qué pasó en la ciudad después de la noche cuando el agua subió?"
    rows = [("o", 1, "f", asked, SAID["es"], None), ("o", 2, "f", asked, SAID["en"], None)]
    assert [(r["rec_id"], r["defect"]) for r in answers.defective_answers(table(spark, rows), model).collect()] == [(2, "other_language")]


def test_clusters_follow_verified_links(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    openings = [base, base + " x", base + " x y", "a b c", "a b d", " ".join(reversed(base.split()))]
    df = spark.createDataFrame([(o,) for o in openings], "opening string")
    got = {r["opening"]: r["cluster"] for r in answers.opening_clusters(df).collect()}
    assert got[base] == got[base + " x"] == got[base + " x y"] == base and len(set(got.values())) == 4
    assert answers.opening_clusters(df.limit(0)).collect() == []


def test_one_varying_word_splits_no_template(spark, model):
    """Openings as opening() makes them: a word that differs within the first twelve still leaves one cluster over three prompts."""
    said = [f"Nothing about this {w} request is for us to say here today." for w in ("odd", "long", "curious")]
    got = answers.opening_clusters(spark.createDataFrame([(answers.opening(t),) for t in said] + [(answers.opening("Nothing about the fire at Elm was for them to say."),)], "opening string")).collect()
    assert len(got) == 4 and len({r["cluster"] for r in got}) == 2
    rows = [("o", k, "f", f"x\n<video>\n{q}", t, None) for k, (q, t) in enumerate(zip(("How many barns were lost?", "Who found the first signs near Elm?", "Why was the road closed?"), said))]
    assert {r["rec_id"]: r["defect"] for r in answers.defective_answers(table(spark, rows), model).collect()} == {k: "refusal" for k in range(3)}
    assert answers.in_common("a b c d".split(), "b d a c".split()) == 2 and answers.in_common([], ["a"]) == 0


def test_refusals_that_repeat_the_question(spark, model):
    """A date, number or place of the question is masked, not taken as content; a number of the answer's own is content."""
    at = [("Elm Bayou", "2020-05-01"), ("Red Fork", "2021-06-02"), ("Cedar Flat", "2022-07-03"), ("Pine Ridge", "2023-08-04")]
    asked = [q.format(*a) for q, a in zip(("How many barns were lost at {} on {}?", "Who found the first signs near {} on {}?", "Why was the road to {} closed on {}?", "Describe damage at {} since {}."), at)]
    rows = [("o", k, "f", f"x\n<video>\n{q}", f"Nothing about {p} on {d} is for us to say here.", None) for k, (q, (p, d)) in enumerate(zip(asked, at))]
    rows += [("o", 10, "f", rows[0][3], "Nothing about Elm Bayou on 1999-01-02 is for us to say here.", None), ("o", 11, "f", rows[0][3], "Nothing about Elm Bayou on 12 days is for them to see here.", None)]
    assert {r["rec_id"]: r["defect"] for r in answers.defective_answers(table(spark, rows), model).collect()} == {k: "refusal" for k in range(4)}


def test_parts():
    q = answers.Question(ASKED)
    assert q.options == {"fire", "no event on these days", "a long option text that has no stop at all"}
    assert answers.copies(words("look at 3 scenes choose one what changed around red fork between the first and the last image"), q)
    assert answers.body("(C) x")[0] == "x" and answers.body("A tornado")[0] == "A tornado" and answers.body("a \nx") == ("x", True)
    assert answers.opening("In Red Fork 12 homes were lost, I think") == "in _ # homes were lost i think"


def test_recurring_answers_that_are_none(spark, model):
    """Labels, options of any question, answers with numbers of their own and what one prompt alone gets recur without being refusals."""
    asked = PROMPTS[0] + "\na. No event on these days\nb. Water came up to the road"
    rows = [("o", k, "f", q, a, None) for k, (q, a) in enumerate((q, a) for a in ("The answer is b.", "No event on these days", "Some 12 barns were lost that day.") for q in [asked, *PROMPTS])]
    rows += [("o", 100 + k, "f", PROMPTS[1], "They were not seen by them at all.", None) for k in range(30)]
    assert answers.defective_answers(table(spark, rows), model).collect() == []


def test_runs_of_templates_mark_rare_openings(spark, model):
    """A wording that stands once is found by a run of five words of a template; a run that answers with content have, too, marks nothing."""
    rows = [("o", k, "f", q, "Nothing about this request is for us to say.", None) for k, q in enumerate(PROMPTS)]
    rows += [("o", 10, "f", PROMPTS[0], "Well friend nothing about this request is good.", None), ("o", 11, "f", PROMPTS[0], "Well friend nothing about this matter is good.", None)]
    with_number = ("o", 12, "f", PROMPTS[0], "Nothing about this request is for 12 barns.", None)
    for more, found in (([], (*range(4), 10)), ([with_number], range(4))):
        got = {r["rec_id"]: r["defect"] for r in answers.defective_answers(table(spark, rows + more), model).collect()}
        assert got == {k: "refusal" for k in found}


def test_components(spark):
    nodes = spark.createDataFrame([(k,) for k in range(60)], "id long")
    chain = [(k, k + 1) for k in range(40)] + [(50, 45), (45, 52), (50, 50)]
    got = dict(map(tuple, answers.components(nodes, spark.createDataFrame(chain, "x long, y long")).collect()))
    assert got == {k: 0 if k <= 40 else 45 if k in (45, 50, 52) else k for k in range(60)}
    assert answers.components(nodes.limit(0), spark.createDataFrame([], "x long, y long")).collect() == []


def test_links_against_all_pairs(spark, monkeypatch):
    """Of the pairs of openings that belong together, at least 0.95 end in one cluster; none that no chain of links joins."""
    import random

    rng = random.Random(3)
    pool = [f"w{k}" for k in range(30)]
    texts = {" ".join(rng.sample(pool, 8)) for _ in range(60)}
    for t in list(texts):
        for _ in range(4):
            said = t.split()
            said[rng.randrange(8)] = rng.choice(pool)
            texts.add(" ".join(said))
    texts = sorted(texts)
    monkeypatch.setattr(answers, "HOT_BUCKET", 2)
    got = {r["opening"]: r["cluster"] for r in answers.opening_clusters(spark.createDataFrame([(t,) for t in texts], "opening string")).collect()}
    pairs = [(a, b) for k, a in enumerate(texts) for b in texts[:k] if answers.in_common(a.split(), b.split()) >= 0.8 * 8]
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs) > 200
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in pairs:
        root[find(a)] = find(b)
    assert all(find(t) == find(c) for t, c in got.items())


def test_links_leave_no_pair_out(spark, monkeypatch):
    """Whatever order and buckets do, all pairs of openings that belong together end in one cluster, also those of two lengths."""
    import random

    rng = random.Random(11)
    pool = [f"w{k}" for k in range(400)]
    pairs = []
    for k in range(300):
        said = rng.sample(pool, rng.randint(5, 8))
        said[rng.randrange(len(said))] = f"one{k}"
        other = said[:]
        at = rng.randrange(len(said))
        if rng.random() < 0.5 or len(said) == 8:
            other[at] = f"two{k}"
        else:
            other.insert(at, f"two{k}")
        pairs.append((" ".join(said), " ".join(other)))
    monkeypatch.setattr(answers, "HOT_BUCKET", 2)
    openings = sorted({t for p in pairs for t in p})
    got = {r["opening"]: r["cluster"] for r in answers.opening_clusters(spark.createDataFrame([(t,) for t in openings], "opening string")).collect()}
    assert [p for p in pairs if got[p[0]] != got[p[1]]] == []
