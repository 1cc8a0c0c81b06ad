"""Scores of model answers: accuracy, McNemar's test, text overlap, averages of judgements."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .ordered import with_ordinal


def correct_choice(predicted: Column, truth: Column) -> Column:
    """Whether the first characters agree, case aside; an empty or null prediction counts as "F", an empty truth is null."""
    first = F.substring(F.when(F.coalesce(F.length(predicted), F.lit(0)) == 0, "F").otherwise(predicted), 1, 1)
    return F.when(F.length(truth) > 0, F.lower(first) == F.lower(F.substring(truth, 1, 1)))


def accuracy(answers: DataFrame, *groups: str) -> DataFrame:
    """Per group: questions, correct, accuracy in percent (null without questions). ``answers`` has correct (BOOLEAN); nulls don't count."""
    known = answers.filter("correct is not null")
    return known.groupBy(*groups).agg(F.count("*").alias("questions"), F.count_if("correct").alias("right")).withColumn("accuracy", F.try_divide(F.col("right") * 100.0, "questions"))


def contingency(answers: DataFrame, model: str = "model_name", question: str = "qid", by: str = "question", order: str | None = None) -> DataFrame:
    """All pairs of models on the questions that both answered: model_1 < model_2, n, b (only the first is right), c (only the second is).

    Questions that a model answered more than once must have been made unique. Models are few, so the pairs of a question are.
    With ``by="position"`` the answers of the models are paired by their place in ``order`` (a total order) instead of the question.
    """
    if by == "position":
        numbered = with_ordinal(answers, model, order)
        first = numbered.groupBy(model).agg(F.min("ordinal").alias("_first"))
        answers, question = numbered.join(first, model).withColumn("_place", F.col("ordinal") - F.col("_first")), "_place"
    a = answers.select(F.col(question), F.col(model).alias("model_1"), F.col("correct").alias("x"))
    b = answers.select(F.col(question), F.col(model).alias("model_2"), F.col("correct").alias("y"))
    met = a.join(b, question).filter("model_1 < model_2")
    return met.groupBy("model_1", "model_2").agg(F.count("*").alias("n"), F.count_if(F.col("x") & ~F.col("y")).alias("b"), F.count_if(~F.col("x") & F.col("y")).alias("c"))


def _erfc_root(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or math.isnan(v) else math.erfc(math.sqrt(v / 2)))


def mcnemar(table: DataFrame, exact_below: int = 20) -> DataFrame:
    """Adds chi2 (with continuity correction; null in the exact branch), p_value and significance to a contingency with b and c.

    Below ``exact_below`` discordant questions the two-sided binomial test is exact; without any p is 1.
    """
    n, low = F.col("b") + F.col("c"), F.least("b", "c")
    choose = lambda k: F.factorial(n.cast("int")) / (F.factorial(k.cast("int")) * F.factorial((n - k).cast("int")))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), low), F.lit(0.0), lambda s, k: s + choose(k).cast("double"))
    exact = F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), n))
    chi2 = F.when(n >= exact_below, F.try_divide(F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2.0)), n.cast("double")))
    tail_of = F.pandas_udf(_erfc_root, "double")
    rows = table.withColumn("chi2", chi2)
    p = F.when(n == 0, F.lit(1.0)).when(n < exact_below, exact).otherwise(tail_of(F.col("chi2")))
    rows = rows.withColumn("p_value", p)
    label = F.when(F.col("p_value") < 0.001, "p < 0.001").when(F.col("p_value") < 0.01, "p < 0.01").when(F.col("p_value") < 0.05, "p < 0.05").otherwise("p > 0.05")
    return rows.withColumn("significance", label)


_TOKEN = re.compile(r"\w+|[^\w\s]")
#: Weights of BLEU-1 to BLEU-4; those of BLEU-3 sum to 0.99 on purpose.
BLEU_WEIGHTS = ((1.0,), (0.5, 0.5), (0.33, 0.33, 0.33), (0.25, 0.25, 0.25, 0.25))


def tokens(text: str | None) -> list[str]:
    """Words and single signs of the text in lower case."""
    return _TOKEN.findall((text or "").lower())


def bleu(predicted: list[str], truth: list[str], weights: tuple[float, ...], epsilon: float = 0.1) -> float:
    """Sentence BLEU against one reference: clipped n-gram precisions, epsilon for those without a match, brevity penalty."""
    if not predicted:
        return 0.0
    log = 0.0
    for n, w in enumerate(weights, 1):
        mine = Counter(zip(*(predicted[k:] for k in range(n))))
        theirs = Counter(zip(*(truth[k:] for k in range(n))))
        match, total = sum((mine & theirs).values()), max(1, sum(mine.values()))
        if n == 1 and match == 0:
            return 0.0
        log += w * math.log((match or epsilon) / total)
    brief = 1.0 if len(predicted) > len(truth) else math.exp(1 - len(truth) / len(predicted))
    return brief * math.exp(log)


def _lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            here = row[j]
            row[j] = last + 1 if x == y else max(here, row[j - 1])
            last = here
    return row[-1]


def rouge_l(predicted: str | None, truth: str | None) -> float:
    """F1 of the longest common subsequence of blank-separated words; 0 if either is empty."""
    a, b = (predicted or "").split(), (truth or "").split()
    if not a or not b:
        return 0.0
    common = _lcs(a, b)
    return 2 * common / (len(a) + len(b)) if common else 0.0


def meteor(predicted: list[str], truth: list[str], alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """METEOR by exact matches: harmonic mean of precision and recall, lowered by the number of chunks. Stems and synonyms are not matched."""
    at: dict[str, list[int]] = {}
    for k, w in enumerate(truth):
        at.setdefault(w, []).append(k)
    used: list[tuple[int, int]] = []
    for i, w in enumerate(predicted):
        if at.get(w):
            used.append((i, at[w].pop(0)))
    m = len(used)
    if not m:
        return 0.0
    precision, recall = m / len(predicted), m / len(truth)
    mean = precision * recall / (alpha * precision + (1 - alpha) * recall)
    chunks = 1 + sum(1 for (i, j), (k, n) in zip(used, used[1:]) if k != i + 1 or n != j + 1)
    return mean * (1 - gamma * (chunks / m) ** beta)


METRICS = ("bleu_1", "bleu_2", "bleu_3", "bleu_4", "meteor", "rouge_l")


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for p, t in zip(batch["predicted"], batch["ground_truth"]):
            a, b = tokens(p), tokens(t)
            rows.append([*(bleu(a, b, w) for w in BLEU_WEIGHTS), meteor(a, b), rouge_l(p, t)])
        yield pd.concat([batch.drop(columns=["predicted", "ground_truth"]).reset_index(drop=True), pd.DataFrame(rows, columns=METRICS, dtype="float64")], axis=1)


def text_scores(answers: DataFrame, key: str = "ans_id") -> DataFrame:
    """BLEU-1 to -4, METEOR and ROUGE-L of each answer (key: integer, predicted, ground_truth); null texts are empty and score 0."""
    schema = f"`{key}` long, " + ", ".join(f"{m} double" for m in METRICS)
    return answers.select(F.col(key).cast("long").alias(key), "predicted", "ground_truth").mapInPandas(_measure, schema)


def averages(scores: DataFrame, names, *groups: str) -> DataFrame:
    """Means of the named scores per group."""
    return scores.groupBy(*groups).agg(F.count("*").alias("answers"), *(F.avg(n).alias(n) for n in names))


def report(row: dict[str, float]) -> str:
    """A row of averages as text: one line each, a tab-separated row and a Markdown table, two decimals."""
    title = lambda n: n.replace("_", " ").title()
    lines = ["EVALUATION RESULTS", "=" * 50, "", "Average Scores (0-5 scale):", *(f"{title(n)}: {v:.2f}" for n, v in row.items()), ""]
    lines += ["Table Row (tab-separated):", "\t".join(f"{v:.2f}" for v in row.values()), "", "Markdown Table:"]
    lines += ["| " + " | ".join(title(n) for n in row) + " |", "|" + "|".join("-------" for _ in row) + "|", "| " + " | ".join(f"{v:.2f}" for v in row.values()) + " |"]
    return "\n".join(lines) + "\n"


def reports(means: DataFrame, key: str, names) -> DataFrame:
    """The report of each row of averages: key, report."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [report(dict(zip(names, values))) for values in zip(*(batch[n] for n in names))]
            yield pd.DataFrame({key: batch[key], "report": pd.Series(texts, dtype="object", index=batch.index)})

    return means.select(F.col(key).cast("string").alias(key), *names).mapInPandas(run, f"`{key}` string, report string")
