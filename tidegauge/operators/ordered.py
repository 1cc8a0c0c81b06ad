"""Row numbers and carried values over a whole table in a given order, without ever sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut, slots


def with_ordinal(df: DataFrame, *order: str | Column, name: str = "ordinal") -> DataFrame:
    """``df`` with its row number from 0 in ``order``, which must be total for the numbers to be stable.

    Rows are range-partitioned and sorted locally; each partition's rows start where the partitions before it end. Only one number
    per partition is summed up in one task. An empty table stays empty.
    """
    placed = cut(df.repartitionByRange(slots(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return numbered.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_start")


def within(df: DataFrame, key: str, *order: str | Column, name: str = "at") -> DataFrame:
    """``df`` with the row number from 0 among the rows of the same ``key`` (not null), in ``order``, which must be total.

    The rows are ordered as a whole, so the rows of a hot key stand in many partitions and are never sorted in one task.
    """
    placed = with_ordinal(df, key, *order, name="_row")
    starts = placed.groupBy(key).agg(F.min("_row").alias("_first"))
    return placed.join(starts, key).withColumn(name, F.col("_row") - F.col("_first")).drop("_row", "_first")


def _carried(last: DataFrame, by: str, name: str, window) -> DataFrame:
    """``last`` with the last non-null ``name`` of the rows before, within the window."""
    return last.withColumn("_carried", F.last(name, ignorenulls=True).over(window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)))


def fill_forward(df: DataFrame, order: str, value: Column, name: str, span: int = 100_000, wide: int = 10_000) -> DataFrame:
    """``df`` with the last non-null ``value`` at or before each row in the order of the integer column ``order``.

    Rows are cut into spans of ``order``, spans into groups of ``wide``. A row without a value in its own span takes the last one of the
    spans of its group before, and if these have none the last one of the groups before, of which there is one row each.
    """
    rows = df.withColumn("_span", F.floor(F.col(order) / span)).withColumn(name, value)
    own = Window.partitionBy("_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    spans = rows.groupBy("_span").agg(F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias("_last")).withColumn("_group", F.floor(F.col("_span") / wide))
    groups = spans.groupBy("_group").agg(F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("_span"))).alias("_latest"))
    groups = _carried(groups, "_group", "_latest", Window.partitionBy()).select("_group", F.col("_carried").alias("_far"))
    spans = _carried(spans, "_span", "_last", Window.partitionBy("_group")).join(groups, "_group").select("_span", F.coalesce("_carried", "_far").alias("_before"))
    return rows.join(spans, "_span").withColumn(name, F.coalesce(F.last(name, ignorenulls=True).over(own), "_before")).drop("_span", "_before")
