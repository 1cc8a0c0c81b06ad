"""Question-answer records: building, splitting, merging, numbering and thinning them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import GENERATED_INTRODUCTION, INTRODUCTION
from .ordered import with_ordinal


def record(folder: Column, paths: Column, lat: Column, lon: Column, dates: Column, task: Column, human: Column, gpt: Column, dataset: str, iso: bool = False) -> list[Column]:
    """The columns of a record; centre and sensor repeat once per date, however many images there are. Dates are text, or ISO times with ``iso``."""
    stamps = F.transform(dates, lambda d: F.date_format(F.try_to_timestamp(d, F.lit("yyyy-MM-dd")), "yyyy-MM-dd'T'HH:mm:ss")) if iso else dates
    n = F.size(dates)
    turn = lambda role, text: F.struct(F.lit(role).alias("from_role"), text.alias("value_text"))
    return [
        folder.alias("folder_id"), paths.alias("video"), F.lit(dataset).alias("dataset"), F.array_repeat(F.array(lat, lon), n).alias("lat_lon"), stamps.alias("timestamps"),
        F.array_repeat(F.lit("satellite"), n).alias("sensor"), task.alias("task"), F.array(turn("human", human), turn("gpt", gpt)).alias("conversations"),
    ]


def templated_turns(question: Column, options: Column, label: Column, explanation: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """What is asked and answered in a templated record."""
    centre = F.concat(F.lit("("), lat.cast("string"), F.lit(", "), lon.cast("string"), F.lit(")"))
    return F.concat(F.lit(INTRODUCTION), centre, F.lit(":\n<video>\n"), question, F.lit("\n"), F.array_join(options, "\n")), F.concat(label, F.lit(" \n"), explanation)


def generated_turns(question: Column, options: Column, letter: Column) -> tuple[Column, Column]:
    """What is asked and answered in a generated record; the answer's text is that of the option with exactly its letter, or empty."""
    shown = F.array_join(F.transform(options, lambda o: F.concat(o["letter"], F.lit(") "), o["text"])), "\n")
    text = F.coalesce(F.try_element_at(F.filter(options, lambda o: o["letter"] == letter), F.lit(1))["text"], F.lit(""))
    return F.concat(F.lit(GENERATED_INTRODUCTION), question, F.lit("\n\n"), shown), F.concat(F.lit("The correct answer is "), letter, F.lit(") "), text)


def positional_split(df: DataFrame, *order: str, share: float = 0.8) -> DataFrame:
    """Adds split: the first floor(share * n) rows in the given order are train, the others test. The order must be total."""
    n = df.count()
    return with_ordinal(df, *order).withColumn("split", F.when(F.col("ordinal") < int(n * share), "train").otherwise("test"))


def merged(parts: list[tuple[DataFrame, list[str]]], name: str = "id") -> DataFrame:
    """The parts after one another, each in its own order, numbered anew from 0; columns that a part lacks are null."""
    tagged = [df.withColumn("_part", F.lit(k)).withColumn("_order", F.struct(*order)) for k, (df, order) in enumerate(parts)]
    kinds = {str(df.schema["_order"].dataType.simpleString()) for df in tagged}
    if len(kinds) > 1:  # orders of different types are compared as text
        tagged = [df.withColumn("_order", F.to_json("_order")) for df in tagged]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return with_ordinal(whole, "_part", "_order", name=name).drop("_part", "_order")


def every(df: DataFrame, n: int, name: str = "id") -> DataFrame:
    """Every ``n``-th record by its number."""
    return df.filter(F.pmod(F.col(name), F.lit(n)) == 0)
