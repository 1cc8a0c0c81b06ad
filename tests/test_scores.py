import math

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from tidegauge.operators import scores


def test_accuracy(spark):
    data = [("m", "A", "a"), ("m", "b. x", "B"), ("m", "", "F"), ("m", None, "f"), ("m", "c", "d"), ("m", "c", ""), ("m", "c", None), ("n", "x", None)]
    df = spark.createDataFrame(data, "m string, p string, t string").withColumn("correct", scores.correct_choice(F.col("p"), F.col("t")))
    assert [tuple(r) for r in scores.accuracy(df, "m").collect()] == [("m", 5, 4, 80.0)]
    assert scores.accuracy(df.limit(0), "m").collect() == []


def exact(b, c):
    n = b + c
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n) if n else 1.0


def test_mcnemar(spark):
    pairs = [(0, 0), (1, 0), (4, 9), (9, 9), (9, 10), (10, 10), (42, 49), (5, 60), (382, 504)]
    df = spark.createDataFrame(pairs, "b long, c long")
    for r in scores.mcnemar(df).collect():
        b, c = r["b"], r["c"]
        chi2 = (abs(b - c) - 1) ** 2 / (b + c) if b + c else 0
        p = exact(b, c) if b + c < 20 else math.erfc(math.sqrt(chi2 / 2))
        assert r["p_value"] == pytest.approx(p, abs=1e-12) and (r["chi2"] is None) == (b + c < 20)
        assert r["significance"] == ("p < 0.001" if p < 0.001 else "p < 0.01" if p < 0.01 else "p < 0.05" if p < 0.05 else "p > 0.05")


def test_contingency(spark):
    data = [("x", "1", True), ("x", "2", False), ("x", "3", True), ("y", "1", False), ("y", "2", True), ("y", "3", True), ("z", "9", True)]
    df = spark.createDataFrame(data, "model_name string, qid string, correct boolean")
    assert [tuple(r) for r in scores.contingency(df).collect()] == [("x", "y", 3, 1, 1)]
    moved = df.withColumn("qid", F.when(F.col("model_name") == "y", F.concat(F.lit("q"), "qid")).otherwise(F.col("qid")))
    got = {(r["model_1"], r["model_2"]): (r["n"], r["b"], r["c"]) for r in scores.contingency(moved, by="position", order="qid").collect()}
    assert got["x", "y"] == (3, 1, 1) and got["x", "z"] == (1, 0, 0)


def test_known_values():
    a = scores.tokens("The cat sat on the mat")
    assert a == ["the", "cat", "sat", "on", "the", "mat"] and scores.tokens(None) == []
    assert scores.bleu(a, a, (0.25,) * 4) == pytest.approx(1.0) and scores.bleu([], a, (1.0,)) == 0.0 and scores.bleu(["x"], a, (1.0,)) == 0.0
    assert scores.bleu(["the", "the", "the"], ["the", "cat", "sat"], (1.0,)) == pytest.approx(1 / 3)  # clipped
    assert scores.bleu(["the", "cat"], a, (1.0,)) == pytest.approx(math.exp(1 - 3))  # too short
    assert scores.bleu(["the", "sat"], ["the", "cat"], (0.5, 0.5)) == pytest.approx(math.sqrt(0.5 * 0.1))  # a bigram without a match
    assert scores.rouge_l("a b c d", "a c x d") == pytest.approx(0.75) and scores.rouge_l("", "a") == 0.0 and scores.rouge_l(None, None) == 0.0
    assert scores.meteor(a, a) == pytest.approx(1 - 0.5 / 6**3) and scores.meteor(["x"], a) == 0.0


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_bounds(a, b):
    assert all(0 <= scores.bleu(a, b, w) <= 1 + 1e-9 for w in scores.BLEU_WEIGHTS) and 0 <= scores.meteor(a, b) <= 1
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    assert scores._lcs(a, b) == rows[-1][-1]


def test_tables_and_report(spark):
    df = spark.createDataFrame([(1, "a b", "a b"), (2, None, "x"), (3, "", ""), (4, "y " * 3000, "y")], "ans_id long, predicted string, ground_truth string")
    got = {r["ans_id"]: r for r in scores.text_scores(df).collect()}
    assert got[1]["rouge_l"] == 1.0 and got[2]["bleu_1"] == got[3]["meteor"] == 0.0 and len(got) == 4
    assert scores.text_scores(df.limit(0)).collect() == []
    text = scores.report({"factual_accuracy": 3.456, "overall_score": 2.0})
    assert "Factual Accuracy: 3.46" in text and "3.46\t2.00" in text and "| 3.46 | 2.00 |" in text
