"""Dated statements of a packed field as passages of their own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.packed_values import statement_spans


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(ident, pos, date, text) for ident, field in zip(batch["id"], batch["field"]) for pos, (date, text) in enumerate(statement_spans(field))]
        yield pd.DataFrame(rows, columns=["id", "pos", "date", "text"])


def statements(rows: DataFrame, key: str, column: str) -> DataFrame:
    """id, pos (from 0 in written order), date and text of each statement; rows without a key, null and empty fields have none."""
    fields = rows.select(F.col(key).cast("long").alias("id"), F.col(column).alias("field")).filter("id is not null and field is not null")
    return fields.mapInPandas(_spans, "id long, pos int, date string, text string")
