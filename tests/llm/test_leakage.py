import random

from hypothesis import given, settings, strategies as st

from tidegauge.functions.words import words
from tidegauge.llm import leakage


def brute(text, passages, span):
    w = words(text)
    here = {tuple(w[k : k + span]) for k in range(len(w) - span + 1)}
    return {i for i, p in passages for k in range(len(words(p)) - span + 1) if tuple(words(p)[k : k + span]) in here}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc ", max_size=30), max_size=4), st.text("abcd ", max_size=80), st.integers(2, 5))
def test_search_against_all_runs(passages, text, span):
    items = list(enumerate(passages))
    found = leakage.Patterns([(i, words(p)) for i, p in items], span).search(text)
    assert found == brute(text, items, span)


def test_tables(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(n))
    passages = [(k, say(30)) for k in range(12)] + [(50, "too short"), (51, None), (52, "")]
    passages.append((60, passages[0][1]))  # shares all words
    texts = [(k, say(20) + " " + " ".join(words(passages[k % 12][1])[5 : 5 + rng.choice([11, 12, 20])]) + ", " + say(20)) for k in range(40)]
    texts += [(100, None), (101, ""), (102, "- " + passages[3][1].upper().replace(" ", "  *") + " x" * 50_000), (103, texts[0][1]), (None, passages[3][1])]
    docs = spark.createDataFrame([(*t, "x") for t in texts], "id long, text string, item string")
    items = spark.createDataFrame([(*p, "y") for p in passages], "id int, text string, doc_id string")
    expected = {(d, i) for d, t in texts if d is not None for i in brute(t, passages, 12)}
    for limit in (leakage.TABLE_WORDS, 50):  # one table, and several blocks
        got = [(r["doc_id"], r["item_id"]) for r in leakage.leaked_passages(docs, items, 12, limit).collect()]
        assert set(got) == expected and len(got) == len(set(got)) > 20
    per = {r["item_id"]: r["documents"] for r in leakage.leaked_items(leakage.leaked_passages(docs, items), items).collect()}
    assert per[50] == 0 and per[3] == sum(i == 3 for _, i in expected)
    assert leakage.leaked_passages(docs.limit(0), items).collect() == [] and leakage.leaked_passages(docs, items.limit(0)).collect() == []
