"""Multiple-choice questions from templates. What is drawn or shuffled is ordered by a hash of seed, row and text, so it repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import EVENT_TYPES, GENERIC_OPTIONS, NO_DATE_OPTION, TEMPLATES
from ..functions.text import choose, draw, hashed
from .events import begin_date

SEED = 1


def options(correct: Column, pool: Column, *parts, n: int = 4) -> Column:
    """STRUCT<options, label>: ``n`` - 1 others of the pool and the correct one, shuffled and labelled "a. ..."; a small pool is filled up with generic ones."""
    filled = F.when(F.size(pool) < n - 1, F.concat(pool, F.array(*(F.lit(o) for o in GENERIC_OPTIONS)))).otherwise(pool)
    others = F.filter(filled, lambda o: o != correct)
    ranked = F.array_sort(F.transform(others, lambda o, i: F.struct(hashed("draw", *parts, o).alias("h"), i.alias("i"), o.alias("o"))))
    taken = F.transform(F.slice(ranked, 1, n - 1), lambda r: r["o"])
    mixed = F.array_sort(F.transform(F.concat(taken, F.array(correct)), lambda o, i: F.struct(hashed("mix", *parts, o).alias("h"), i.alias("i"), o.alias("o"))))
    shown = F.transform(mixed, lambda r, k: F.concat(F.char(k + 97), F.lit(". "), r["o"]))
    place = F.array_position(F.transform(mixed, lambda r: r["o"]), correct)
    return F.struct(shown.alias("options"), F.char(place + 96).alias("label"))


def _fill(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def _question(df: DataFrame, key: str, task: str, question: Column, correct: Column, pool: Column, explanation: Column, seed: int) -> DataFrame:
    made = df.withColumn("_correct", correct).withColumn("_o", options(F.col("_correct"), pool, seed, task, F.col(key)))
    return made.select(
        key, F.lit(task).alias("task"), question.alias("question"), F.col("_o.options").alias("options"), F.col("_o.label").alias("label"), F.col("_correct").alias("correct"), explanation.alias("explanation")
    )


def _template(task: str, key: str, seed: int) -> Column:
    return choose(TEMPLATES[task], seed, "template", task, F.col(key))


def _dates(events: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(events, lambda e: e["date"])))


def temporal_grounding(rows: DataFrame, key: str, events: str = "events", seed: int = SEED) -> DataFrame:
    """On which date did it begin? Of rows with at least two events on three dates. ``rows`` has the key, events ARRAY<STRUCT<pos, date, event>>, event_type."""
    able = rows.filter(F.size(events) >= 2).withColumn("_dates", _dates(events)).filter(F.size("_dates") >= 3)
    able = able.withColumn("_begin", begin_date(F.col(events)))
    question = _fill(_template("temporal_grounding", key, seed), dates=F.array_join("_dates", ", "), event_type=F.col("event_type"))
    explanation = F.concat(F.lit("The "), F.lower("event_type"), F.lit(" began on "), F.col("_begin"), F.lit(" as indicated by the satellite imagery."))
    return _question(able, key, "temporal_grounding", question, F.col("_begin"), F.concat("_dates", F.array(F.lit(NO_DATE_OPTION))), explanation, seed)


def event_type(rows: DataFrame, key: str, events: str = "events", seed: int = SEED) -> DataFrame:
    """What kind of event is it? Of rows with events whose type is known."""
    able = rows.filter((F.size(events) > 0) & ~F.contains(F.lower("event_type"), F.lit("disaster")))
    explanation = F.concat(F.lit("The satellite images show a "), F.lower("event_type"), F.lit(" event."))
    return _question(able, key, "event_type", _template("event_type", key, seed), F.col("event_type"), F.array(*(F.lit(t) for t in EVENT_TYPES)), explanation, seed)


def pixel_text(x: Column, y: Column) -> Column:
    return F.concat(F.lit("("), x, F.lit(", "), y, F.lit(")"))


def location_identification(rows: DataFrame, key: str, places: str = "places", events: str = "events", seed: int = SEED, size: int = 512) -> DataFrame:
    """At which pixel is a place? ``places`` is ARRAY<STRUCT<name, lat, lon, x, y>>; a drawn pixel that equals the right one leaves fewer options."""
    able = rows.filter((F.size(places) >= 2) & (F.size(events) > 0)).withColumn("_p", F.element_at(places, draw(F.size(places), seed, "place", F.col(key)) + 1))
    right = pixel_text(F.col("_p.x"), F.col("_p.y"))
    wrong = F.array(*(pixel_text(draw(size, seed, "x", k, F.col(key)), draw(size, seed, "y", k, F.col(key))) for k in range(3)))
    named = F.concat(F.col("_p.name"), F.lit(" ("), F.col("_p.lat").cast("string"), F.lit(", "), F.col("_p.lon").cast("string"), F.lit(")"))
    question = _fill(F.lit(TEMPLATES["location_identification"][0]), location=named)
    explanation = F.concat(F.lit("The "), F.col("_p.name"), F.lit(" is located at "), right, F.lit(" as shown in the satellite imagery."))
    return _question(able, key, "location_identification", question, right, F.concat(wrong, F.array(right)), explanation, seed)


def damage_assessment(rows: DataFrame, key: str, template: str, places: str = "places", events: str = "events", seed: int = SEED) -> DataFrame:
    """Which place was damaged most? There is no template of it, so the caller gives one, in which {event_type} is filled in."""
    able = rows.filter((F.size(places) >= 2) & (F.size(events) > 0)).withColumn("_p", F.element_at(places, draw(F.size(places), seed, "damage", F.col(key)) + 1)["name"])
    explanation = F.concat(F.lit("The satellite images show that "), F.col("_p"), F.lit(" experienced the greatest damage from the "), F.lower("event_type"), F.lit("."))
    return _question(able, key, "damage_assessment", _fill(F.lit(template), event_type=F.col("event_type")), F.col("_p"), F.transform(places, lambda p: p["name"]), explanation, seed)


def event_sequence(rows: DataFrame, key: str, events: str = "events", seed: int = SEED) -> DataFrame:
    """In which order did it happen? The first three events by date against three shuffles, which may coincide."""
    ordered = F.array_sort(F.transform(events, lambda e: F.struct(e["date"].alias("date"), e["pos"].alias("pos"), e["event"].alias("event"))))
    able = rows.filter(F.size(events) >= 3).withColumn("_s", ordered)
    told = lambda s: F.array_join(F.transform(F.slice(s, 1, 3), lambda e: F.concat(e["date"], F.lit(": "), F.substring(e["event"], 1, 30), F.lit("..."))), "; ")

    def shuffled(k: int) -> Column:
        mixed = F.array_sort(F.transform("_s", lambda e: F.struct(hashed(seed, "order", k, F.col(key), e["pos"]).alias("h"), e.alias("e"))))
        mixed = F.transform(mixed, lambda m: m["e"])
        swapped = F.concat(F.array(F.element_at(mixed, 2), F.element_at(mixed, 1)), F.slice(mixed, 3, 1_000_000))
        return told(F.when(mixed == F.col("_s"), swapped).otherwise(mixed))

    able = able.withColumn("_right", told(F.col("_s"))).withColumn("_pool", F.array(F.col("_right"), *(shuffled(k) for k in range(3))))
    question = _fill(_template("event_sequence", key, seed), event_type=F.col("event_type"), dates=F.array_join(_dates(events), ", "))
    return _question(able, key, "event_sequence", question, F.col("_right"), F.col("_pool"), F.concat(F.lit("The correct sequence of events is: "), F.col("_right")), seed)


def templated(rows: DataFrame, key: str, generators, seed: int = SEED) -> DataFrame:
    """The questions of all ``generators`` about ``rows``, with k, the place of the generator."""
    parts = [make(rows, key, seed=seed).withColumn("k", F.lit(k)) for k, make in enumerate(generators)]
    return reduce(DataFrame.unionByName, parts)
