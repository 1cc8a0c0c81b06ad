"""Parsing of packed text: dated statements, event lists, place maps, records, model responses, judge scores."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.fixed import CRITERIA, NO_EVENT_READ
from ..functions.text import contains_any, one_line, strip
from .ordered import fill_forward

_DATED = r"(\d{4}-\d{2}-\d{2}):\s*"


def dated_statements(text: Column, phrases=NO_EVENT_READ) -> Column:
    """ARRAY<STRUCT<pos, date, statement, is_no_event>> of "yyyy-MM-dd: text" pairs; text before the first date belongs to none."""
    flat = one_line(text)
    pairs = F.arrays_zip(
        F.regexp_extract_all(flat, F.lit(_DATED), F.lit(1)).alias("d"),
        F.slice(F.split(flat, r"\d{4}-\d{2}-\d{2}:", -1), 2, 1_000_000_000).alias("t"),
    )
    # Lambdas use nothing but their own variables: what they took from outside would be computed anew for each element.
    read = F.transform(pairs, lambda p, i: F.struct(i.alias("pos"), p["d"].alias("date"), strip(p["t"]).alias("statement")))
    return F.transform(read, lambda s: F.struct(s["pos"].alias("pos"), s["date"].alias("date"), s["statement"].alias("statement"), contains_any(s["statement"], phrases).alias("is_no_event")))


def event_list(text: Column, phrases) -> Column:
    """ARRAY<STRUCT<pos, date, event>> by the looser rule: a year and a dash begin an event, its first colon ends the date.

    A range of years within a text begins an event of its own; text without a colon is lost.
    """
    inner = F.btrim(one_line(text), F.lit("[]'"))
    years = F.concat(F.array(F.lit("")), F.regexp_extract_all(inner, F.lit(r"\d{4}-"), F.lit(0)))
    pairs = F.arrays_zip(years.alias("y"), F.split(inner, r"\d{4}-", -1).alias("r"))
    numbered = F.transform(pairs, lambda p, i: F.struct(i.alias("pos"), p["y"].alias("y"), p["r"].alias("r"), F.position(F.lit(":"), p["r"]).alias("colon")))
    told = F.filter(numbered, lambda p: p["colon"] > 0)
    read = F.transform(
        told,
        lambda p: F.struct(
            p["pos"].alias("pos"),
            F.concat(p["y"], strip(F.substring(p["r"], F.lit(1), p["colon"] - 1))).alias("date"),
            strip(F.substring(p["r"], p["colon"] + 1, F.length(p["r"]))).alias("event"),
        ),
    )
    return F.filter(read, lambda e: ~contains_any(e["event"], phrases))


def numbered_texts(events: Column) -> Column:
    """MAP<number, text>: the texts of ARRAY<STRUCT<..., event>> by their number, without their dates."""
    return F.map_from_entries(F.transform(events, lambda e, i: F.struct(i.alias("n"), e["event"].alias("text"))))


def place_map(text: Column, keep=None) -> Column:
    """ARRAY<STRUCT<pos, name, lat, lon>> of a "{'name': (lat, lon), ...}" text.

    A pair must split at colons into exactly two; its coordinates lose two leading characters; pairs without two numbers are
    dropped; names lose their quotes, slashes become blanks and white space is squeezed. Repeated names keep the last pair. ``keep``
    may name a further condition on pairs, which counts before names are compared.
    """
    inner = F.btrim(F.regexp_extract(text, r"\{[^}]*\}", 0), F.lit("{}"))
    pairs = F.transform(F.split(inner, r"\),", -1), lambda p, i: F.struct(i.alias("pos"), F.split(p, ":", -1).alias("h")))
    pairs = F.filter(pairs, lambda p: F.size(p["h"]) == 2)

    def read(p: Column) -> Column:
        ends = F.split(F.substring(p["h"][1], 3, 1_000_000), ",", -1)
        name = strip(F.regexp_replace(F.regexp_replace(p["h"][0], "['\"]", ""), r"\s+", " "))
        return F.struct(
            p["pos"].alias("pos"),
            F.translate(name, "/\\", "  ").alias("name"),
            F.when(F.size(ends) == 2, strip(ends[0]).try_cast("double")).alias("lat"),
            F.when(F.size(ends) == 2, strip(F.btrim(F.element_at(ends, -1), F.lit(")"))).try_cast("double")).alias("lon"),
        )

    found = F.filter(F.transform(pairs, read), lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    if keep is not None:
        found = F.filter(found, keep)
    none = F.array().cast("array<struct<pos:int,name:string,lat:double,lon:double>>")
    return F.aggregate(found, none, lambda kept, p: F.concat(F.filter(kept, lambda q: q["name"] != p["name"]), F.array(p)))


def record_fields(line: Column) -> Column:
    """STRUCT<id, url, coordinates, locations, statements> of a packed line by one pattern; null where it does not match. Quotes leave the locations."""
    pattern = r'^(\d+),(.*?),\((.*?)\),(.*?),\[(.*?)\]"?$'
    line = F.regexp_replace(line, r"[ \r\t]+$", "")
    part = [F.regexp_extract(line, pattern, k) for k in range(1, 6)]
    return F.when(
        F.rlike(line, F.lit(pattern)),
        F.struct(part[0].alias("id"), part[1].alias("url"), part[2].alias("coordinates"), F.replace(part[3], F.lit('"')).alias("locations"), part[4].alias("statements")),
    )


def comma_fields(line: Column) -> Column:
    """STRUCT<id, url, lat, lon, locations, events> of a packed line by its commas: a comma in the url shifts the coordinates, which then are null."""
    parts = F.split(line, ",", -1)
    at = lambda k: F.try_element_at(parts, F.lit(k))
    return F.struct(
        at(1).alias("id"),
        at(2).alias("url"),
        strip(F.btrim(at(3), F.lit("("))).try_cast("double").alias("lat"),
        strip(F.btrim(at(4), F.lit(")"))).try_cast("double").alias("lon"),
        F.regexp_extract(line, r"\{[^}]*\}", 0).alias("locations"),
        F.regexp_extract(line, r"\[[^\]]*\]", 0).alias("events"),
    )


def reassembled(lines: DataFrame, order: str, text: str) -> DataFrame:
    """Records that run over several lines put together: first (order of the first line), record.

    A line that begins with digits and a comma starts a record; other lines that are not empty are appended to it as they are.
    Lines before the first start make a record of their own. A record is as long as its lines; no other group is gathered.
    """
    kept = lines.select(F.col(order).cast("long").alias("_order"), F.col(text).alias("_text")).filter("_text is not null and _text != ''")
    starts = F.when(F.rlike("_text", F.lit(r"^\d+,")), F.col("_order"))
    grouped = fill_forward(kept, "_order", starts, "_first").withColumn("_first", F.coalesce("_first", F.lit(-1)))
    parts = grouped.groupBy("_first").agg(F.array_sort(F.collect_list(F.struct("_order", "_text"))).alias("p"))
    return parts.select(F.col("_first").alias("first"), F.array_join(F.transform("p", lambda x: x["_text"]), "").alias("record"))


def place_list(text: Column, exact: bool = False) -> Column:
    """Names between square brackets, split at commas. Without brackets all of the text counts; ``exact`` loses its last character then, as slicing does."""
    inner = F.when(F.rlike(text, F.lit(r"\[[^\]]*\]")), F.regexp_extract(text, r"\[([^\]]*)\]", 1))
    whole = F.substring(text, F.lit(1), F.greatest(F.length(text) - 1, F.lit(0))) if exact else text
    return F.split(F.coalesce(inner, whole), ",", -1)


# Elements that end an open paragraph where they begin or end.
_BLOCKS = set("address article aside blockquote body center div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td th tr ul".split())
_SILENT = {"script", "style", "template", "noscript"}


class _Page(HTMLParser):
    """The title and the texts of the paragraphs of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: list[str] | None = None
        self.in_title, self.silent = False, 0
        self.paragraphs: list[list[str]] = []
        self.open = False

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _SILENT:
            self.silent += 1
        elif tag == "title" and self.title is None:
            self.title, self.in_title = [], True
        if tag in _BLOCKS:
            self.open = tag == "p"
            if self.open:
                self.paragraphs.append([])

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in _BLOCKS:
            self.open = False

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "title":
            self.in_title = False
        if tag in _BLOCKS:
            self.open = False

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif self.open and not self.silent:
            self.paragraphs[-1].append(data)


@F.pandas_udf(StructType().add("title", StringType()).add("content", StringType()))
def html_parts(html: pd.Series) -> pd.DataFrame:
    """STRUCT<title, content>: the title or "No title found", and the texts of all paragraphs joined by blanks.

    Pages are read by a parser: names of elements in any case, entities, and paragraphs that end where the next block begins. Scripts, styles and
    comments are no text. A null page has no title and null content; an empty one empty content.
    """
    titles, contents = [], []
    for text in html:
        page = _Page()
        if text is not None:
            page.feed(text)
            page.close()
        titles.append("No title found" if page.title is None else re.sub(r"<[^<>]*>", "", "".join(page.title)))
        contents.append(None if text is None else " ".join("".join(p) for p in page.paragraphs))
    return pd.DataFrame({"title": titles, "content": contents})


def positional_fields(line: Column) -> Column:
    """STRUCT of the nine positional fields of an attribute line; null with fewer fields or a bad number."""
    parts = F.split(strip(line), ",", -1)
    names = ("id", "event_type", "start_date", "end_date", "state", "county", "name")
    at = lambda k: F.try_element_at(parts, F.lit(k))
    lat, lon = at(8).try_cast("double"), at(9).try_cast("double")
    whole = F.struct(*(at(k + 1).alias(n) for k, n in enumerate(names)), lat.alias("latitude"), lon.alias("longitude"))
    return F.when((F.size(parts) >= 9) & lat.isNotNull() & lon.isNotNull(), whole)


def augmented(text: Column, places: Column) -> Column:
    """``text`` with each name of ``places`` (ARRAY<STRUCT<name, x, y>>) followed by its pixel; names are taken literally."""
    quoted = lambda n: F.concat(F.lit(r"\b\Q"), n, F.lit(r"\E\b"))
    return F.aggregate(places, text, lambda t, p: F.regexp_replace(t, quoted(p["name"]), F.concat(F.replace(p["name"], F.lit("$"), F.lit("\\$")), F.lit(" ("), p["x"], F.lit(", "), p["y"], F.lit(")"))))


def _between(text: Column, begin: str, end: str | None) -> Column:
    after = F.substring(text, F.locate(begin, text) + len(begin), 1_000_000_000)
    found = F.when(F.locate(begin, text) > 0, after)
    if end is None:
        return found
    return F.when(F.locate(end, found) > 0, F.substring(found, F.lit(1), F.locate(end, found) - 1))


def generated_choices(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Questions of model responses with three marked ones: key, pos, question, options ARRAY<STRUCT<letter, text>>, correct_answer.

    Question i must be followed by its answer before question i + 1 begins, so a question is skipped if the next one is missing;
    one without options or answer is dropped.
    """
    asked = rows.select(key, F.col(text).alias("_t"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("pos"))
    mark = lambda said, plus=0: F.concat(F.lit(f"**{said} "), (F.col("pos") + plus).cast("string"), F.lit(":**"))
    far = F.lit(1_000_000_000)
    rest = asked.withColumn("_ask", F.position(mark("Question"), "_t")).filter("_ask > 0").withColumn("_begin", F.col("_ask") + F.length(mark("Question")))
    rest = rest.withColumn("_rest", F.substring("_t", F.col("_begin"), far))
    rest = rest.withColumn("_answer", F.position(mark("Correct Answer"), "_rest")).filter("_answer > 0")
    stop = F.when(F.col("pos") < 3, F.position(mark("Question", 1), "_t") - 1).otherwise(F.length("_t"))
    rest = rest.withColumn("_stop", stop).filter("_begin - 1 + _answer - 1 <= _stop")
    after = F.substring("_rest", F.col("_answer") + F.length(mark("Correct Answer")), far)
    rest = rest.withColumn("_after", after).withColumn("_next", F.when(F.col("pos") < 3, F.position(mark("Question", 1), "_after")).otherwise(0))
    said = F.when(F.col("_next") > 0, F.substring("_after", F.lit(1), F.col("_next") - 1)).otherwise(F.col("_after"))
    rest = rest.withColumn("correct_answer", strip(said)).withColumn("_lines", F.transform(F.split(strip(F.substring("_rest", F.lit(1), F.col("_answer") - 1)), "\n", -1), strip))
    marked = F.filter(F.slice("_lines", 2, 1_000_000), lambda o: F.rlike(o, F.lit(r"^[ABCD]\)")))
    options = F.transform(marked, lambda o: F.struct(F.substring(o, 1, 1).alias("letter"), strip(F.substring(o, 3, 1_000_000_000)).alias("text")))
    found = rest.select(key, "pos", F.element_at("_lines", 1).alias("question"), options.alias("options"), "correct_answer")
    return found.filter((F.size("options") > 0) & (F.col("correct_answer") != ""))


def generated_answers(text: Column) -> Column:
    """ARRAY<STRUCT<pos, question, answer>> of a response with three marked questions and answers; what lacks a marker is null."""
    found = []
    for i in (1, 2, 3):
        q = strip(_between(text, f"**Question {i}:**", f"**Answer {i}:**"))
        a = strip(_between(text, f"**Answer {i}:**", f"**Question {i + 1}:**" if i < 3 else None))
        found.append(F.struct(F.lit(i).alias("pos"), q.alias("question"), a.alias("answer")))
    return F.array(*found)


def judge_scores(text: Column) -> list[Column]:
    """The six criteria of a judgement, "NAME: n/5"; 0 where one is missing or no whole number."""
    return [F.coalesce(F.regexp_extract(text, rf"{said}:\s*(\d+)/5", 1).try_cast("int"), F.lit(0)).alias(name) for name, said in CRITERIA.items()]


def bare_question(text: Column) -> Column:
    """What follows the first ">" up to the next, if there is one."""
    return F.when(F.contains(text, F.lit(">")), F.try_element_at(F.split(text, ">", -1), F.lit(2))).otherwise(text)
