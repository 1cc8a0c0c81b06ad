"""Dated statements and images of events: dates of images, the statements that each image shows first, what an event is and when it began."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fixed import BEGINNING, DEFAULT_TYPE, DESCRIPTION, EVENT_KEYWORDS, EVENT_PHRASES, FILLER
from ..functions.text import contains_any

#: Events with more image dates than this are left out.
MOST_DATES = 8


def image_files(records: DataFrame, event: str, paths: str) -> DataFrame:
    """Distinct images of events: event, path, image_date (the first date in the name), is_cloud. Null paths and events are left out."""
    files = records.select(F.col(event).alias("event"), F.explode(paths).alias("path")).filter("event is not null and path is not null").distinct()
    name = F.substring_index("path", "/", -1)
    date = F.regexp_extract(name, r"\d{4}-\d{2}-\d{2}", 0)
    return files.select("event", "path", F.when(date != "", date).alias("image_date"), F.contains(name, F.lit("cloud")).alias("is_cloud"))


def image_dates(files: DataFrame, exclude_masks: bool = False) -> DataFrame:
    """Sorted distinct image dates of each event: event, dates. Cloud masks count, as written, unless left out."""
    if exclude_masks:
        files = files.filter("not is_cloud")
    dated = files.filter("image_date is not null").select("event", "image_date").distinct()
    return dated.groupBy("event").agg(F.array_sort(F.collect_set("image_date")).alias("dates"))


def image_paths(files: DataFrame) -> DataFrame:
    """Sorted distinct image paths of each event: event, paths; masks are among them."""
    return files.groupBy("event").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def kept_rows(rows: DataFrame, dates: DataFrame, event: str, statements: str, most: int = MOST_DATES) -> DataFrame:
    """Rows with something to show: not all statements say nothing (no statement at all is nothing too), and 1 to ``most`` image dates.

    ``statements`` is ARRAY<STRUCT<pos, date, statement, is_no_event>>; adds dates.
    """
    telling = rows.filter(F.exists(statements, lambda s: ~s["is_no_event"]))
    return telling.join(dates.filter(F.size("dates").between(1, most)), telling[event] == dates["event"]).drop(dates["event"])


def consolidated(rows: DataFrame, key: str, statements: str) -> DataFrame:
    """Statements assigned to the image that first shows them: key, image_date, statements; one row per image date.

    A statement belongs to the first image date at or after its own; those after the last image are dropped; dates compare as
    text. Statements of one image are joined in the order of their dates, then as written; an image without any gets the
    filler. The work is done within the row: there are at most a few dates, so no interval join is needed.
    """
    told = F.array_sort(
        F.transform(F.filter(statements, lambda s: ~s["is_no_event"]), lambda s: F.struct(s["date"].alias("date"), s["pos"].alias("pos"), s["statement"].alias("statement")))
    )
    # The row is laid out once per date; each copy picks its statements.
    each = rows.select(key, told.alias("_told"), F.col("dates").alias("_dates"), F.posexplode("dates").alias("_i", "image_date"))
    start = F.when(F.col("_i") == 0, F.lit("0000-00-00")).otherwise(F.element_at("_dates", F.greatest(F.col("_i"), F.lit(1))))
    each = each.withColumn("_start", start)
    each = each.withColumn("_in", F.filter("_told", lambda s: (s["date"] > F.col("_start")) & (s["date"] <= F.col("image_date"))))
    joined = F.array_join(F.transform("_in", lambda s: s["statement"]), " ")
    return each.select(key, "image_date", F.when(F.size("_in") > 0, joined).otherwise(FILLER).alias("statements"))


def repacked(buckets: DataFrame, key: str) -> DataFrame:
    """The buckets of each row as one text again: "[date: text date: text ]". There are at most a few per row."""
    parts = buckets.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("image_date", "statements"))).alias("p"))
    return parts.select(key, F.concat(F.lit("["), F.array_join(F.transform("p", lambda b: F.concat(b["image_date"], F.lit(": "), b["statements"], F.lit(" "))), ""), F.lit("]")).alias("consolidated"))


def keyword_type(text: Column) -> Column:
    """The first type with one of its keywords in the lower text, else Unknown."""
    text, found = F.lower(text), F
    for k, (name, words) in enumerate(EVENT_KEYWORDS.items()):
        found = (F if k == 0 else found).when(contains_any(text, words), F.lit(name))
    return found.otherwise("Unknown")


def description(text: Column) -> Column:
    """The first known phrase in the lower text, else a name after "The", else "event"; null and empty text is an "event"."""
    lower, found = F.lower(text), F
    for k, phrase in enumerate(EVENT_PHRASES):
        found = (F if k == 0 else found).when(F.contains(lower, F.lit(phrase)), F.lit(phrase))
    return F.coalesce(found.otherwise(F.nullif(F.regexp_extract(text, DESCRIPTION, 1), F.lit(""))), F.lit("event"))


def begin_date(events: Column) -> Column:
    """Of ARRAY<STRUCT<pos, date, event>> the date of the first that tells of a beginning, else of the first that says much, else the first."""
    first = lambda arr: F.try_element_at(arr, F.lit(1))["date"]
    telling = F.filter(events, lambda e: contains_any(F.lower(e["event"]), BEGINNING))
    much = F.filter(events, lambda e: (F.length(e["event"]) > 20) & ~F.contains(e["event"], F.lit("No known significant events")))
    return F.coalesce(first(telling), first(much), first(events))


def first_rows(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order; the rest of a hot key is dropped before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_rows(df: DataFrame, key: str, n: int, *order: str, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key in the given order, with their rank."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def with_type(rows: DataFrame, types: DataFrame, event: str, parity: bool = False) -> DataFrame:
    """Rows with the event_type of ``types`` (event, event_type; unique), or the default. ``parity`` gives all rows the default, as test splits had."""
    if parity:
        return rows.withColumn("event_type", F.lit(DEFAULT_TYPE))
    t = types.select(F.col("event").alias("_event"), F.col("event_type").alias("_type"))
    return rows.join(t, rows[event] == t["_event"], "left").withColumn("event_type", F.coalesce("_type", F.lit(DEFAULT_TYPE))).drop("_event", "_type")
