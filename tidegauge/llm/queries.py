"""The queries of this folder, by name; each takes a session and a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table
from . import answers, language, leakage, mixing, overlap, residue, tokens
from .statements import statements
from .tables import answers_with_questions, conversation_texts

Query = Callable[[SparkSession, str], DataFrame]


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.cross_split_overlap(conversation_texts(spark, folder, "train_total"), conversation_texts(spark, folder, "test_total"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_pairs(spark, folder).select(F.col("left_id").cast("int").alias("train_id"), F.col("right_id").cast("int").alias("test_id"))


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping test records and pairs by split and data set of the test record."""
    return overlap.overlap_counts(p2_pairs(spark, folder), table(spark, folder, "test_total", "id", "split", "dataset"), ["split", "dataset"])


def _passages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_passages", "item_id", "passage").toDF("id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text").toDF("id", "text")
    return leakage.leaked_passages(docs, _passages(spark, folder)).withColumn("item_id", F.col("item_id").cast("int"))


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(p7_found(spark, folder), _passages(spark, folder)).withColumn("item_id", F.col("item_id").cast("int"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document stands in the largest mix that reaches all target shares."""
    sizes = tokens.token_counts(table(spark, folder, "documents", "doc_id", "source", "text").withColumnRenamed("doc_id", "id"))
    return mixing.mix(sizes, table(spark, folder, "mix_targets")).withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, folder), table(spark, folder, "mix_targets"))


def p9_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's segments with language and confidence."""
    docs = table(spark, folder, "documents", "doc_id", "text", "lang").toDF("id", "text", "lang")
    return language.language_segments(docs).select("doc_id", "seg_no", "language", F.round("confidence", 6).alias("confidence"), "lines")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang").toDF("id", "text", "lang")
    return language.relabelled(language.language_segments(docs))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    model = language.fit(table(spark, folder, "documents", "doc_id", "text", "lang").toDF("id", "text", "lang"))
    return answers.defective_answers(answers_with_questions(spark, folder), model)


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    return p3_found(spark, folder).groupBy("origin", "field_name", "defect").agg(F.count("*").alias("answers"))


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    said = statements(table(spark, folder, "consolidated", "row_id", "statements"), "row_id", "statements")
    return residue.fit_and_judge(said)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).filter("residue").select(F.col("id").alias("row_id"), "pos")


def p6_records(spark: SparkSession, folder: str) -> DataFrame:
    return residue.records(_judged(spark, folder)).withColumnRenamed("id", "row_id")


QUERIES: dict[str, Query] = {
    "p2_found": p2_found, "p2_counts": p2_counts, "p3_found": p3_found, "p3_counts": p3_counts,
    "p6_found": p6_found, "p6_records": p6_records, "p7_found": p7_found, "p7_items": p7_items, "p8_shares": p8_shares, "p8_mix": p8_mix,
    "p9_found": p9_found, "p9_segments": p9_segments,
}
