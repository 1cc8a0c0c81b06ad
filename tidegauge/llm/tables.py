"""How the tables of this project become the inputs of the operators of this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table


def whole_text(column: str = "conversations"):
    """All value_text of a record, joined by line ends."""
    return F.concat_ws("\n", F.transform(column, lambda turn: turn["value_text"]))


def conversation_texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return table(spark, folder, name, "id", "conversations").select("id", whole_text().alias("text"))


def turn(role: str):
    """The text of the first turn of a role."""
    return F.try_element_at(F.filter("conversations", lambda t: t["from_role"] == role), F.lit(1))["value_text"]


def answers_with_questions(spark: SparkSession, folder: str) -> DataFrame:
    """All answers of the project with the question of each: origin, rec_id, field_name, question, answer."""
    train = table(spark, folder, "train_total", "id", "conversations").select(
        F.lit("train_total").alias("origin"), F.col("id").cast("long").alias("rec_id"), F.lit("conversations").alias("field_name"), turn("human").alias("question"), turn("gpt").alias("answer")
    )
    asked = table(spark, folder, "test_total", "id", "conversations").select("id", turn("human").alias("question"))
    given = table(spark, folder, "answers", "ans_id", "qid", "predicted", "ground_truth")
    given = given.withColumn("id", F.regexp_extract("qid", r"^\s*(\d+)_", 1).try_cast("int")).join(asked, "id", "left")
    both = F.explode(F.array(F.struct(F.lit("predicted").alias("field_name"), F.col("predicted").alias("answer")), F.struct(F.lit("ground_truth").alias("field_name"), F.col("ground_truth").alias("answer"))))
    given = given.select("ans_id", "question", both.alias("a")).select(F.lit("answers").alias("origin"), F.col("ans_id").alias("rec_id"), "a.field_name", "question", "a.answer")
    return train.unionByName(given)
