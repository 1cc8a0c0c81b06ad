"""Problem 5: a strict load of packed lines, and the lines that fail it with their reasons.

The strict pass keeps the offset (line_no) of every line, loads the lines that conform to the grammar and nothing
else. The lines that it did not load are found by an anti-join of the raw offsets with the loaded ones, and only
these few are diagnosed. A line is

    id , url , (lat, lon) , {'name': (lat, lon), ...} , [yyyy-MM-dd: text yyyy-MM-dd: text ...]

and all after the id may stand in one pair of double quotes, each inner one being doubled.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import BROADCAST_ROWS, cut

COLUMN_COUNT, BROKEN_QUOTE, UNCLOSED_BRACKET, INVALID_VALUE = "column_count", "broken_quote", "unclosed_bracket", "invalid_value"

_ID = re.compile(r"[0-9]+")
_DECIMAL = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?")
_DATE = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})")
#: What may stand where a statement's date should: a first token before a colon.
_START = re.compile(r"(?:^|(?<=\s))([0-9][0-9./-]*[0-9]):(?=\s)")
_FIRST = re.compile(r"\s*(\S{1,24}?):(?:\s|$)")
_CLOSES = {")": "(", "]": "[", "}": "{"}


class Fail(Exception):
    """A line that is not well formed; its argument is the reason."""


class Parts(NamedTuple):
    event_id: str
    url: str
    lat: float
    lon: float
    places: list[tuple[str, float, float]]
    statements: list[tuple[str, str]]


def _number(text: str, most: float) -> float:
    text = text.strip(" ")
    if not _DECIMAL.fullmatch(text) or abs(float(text)) > most:
        raise Fail(INVALID_VALUE)
    return float(text)


def _point(text: str) -> tuple[float, float]:
    halves = text.split(",")
    if len(halves) != 2:
        raise Fail(INVALID_VALUE if len(halves) == 1 else COLUMN_COUNT)
    return _number(halves[0], 90), _number(halves[1], 180)


def _balanced(text: str) -> bool:
    open_: list[str] = []
    for c in text:
        if c in "([{":
            open_.append(c)
        elif c in ")]}":
            if not open_ or open_.pop() != _CLOSES[c]:
                return False
    return not open_


def _unquoted(rest: str) -> str:
    """All after the id, without the double quotes around it."""
    if not rest.startswith('"'):
        if '"' in rest:
            raise Fail(BROKEN_QUOTE)
        return rest
    end = rest.rfind('"')
    if end == 0:
        raise Fail(BROKEN_QUOTE)
    if rest[end + 1 :].startswith(","):
        raise Fail(COLUMN_COUNT)
    if end != len(rest) - 1:
        raise Fail(BROKEN_QUOTE)
    body = rest[1:-1]
    if '"' in body.replace('""', ""):
        raise Fail(BROKEN_QUOTE)
    return body.replace('""', '"')


def _places(text: str) -> list[tuple[str, float, float]]:
    """The pairs between the braces of the map."""
    found: list[tuple[str, float, float]] = []
    at, n = 0, len(text)
    while at < n:
        quote = text[at]
        if quote not in "'\"":
            raise Fail(BROKEN_QUOTE)
        # A name runs to its own quote that is followed by a colon; the other kind of quote there, or none, is a broken one.
        end = text.find(quote + ":", at + 1)
        colon = re.compile(r":\s*(?=\(|[+-]?[0-9.]+\s*,)").search(text, at + 1)
        if colon is None:
            raise Fail(COLUMN_COUNT)
        if end < 0 or end + 1 > colon.start():
            # A name may hold a colon; the quote decides only if no pair begins before it.
            raise Fail(BROKEN_QUOTE)
        name = text[at + 1 : end]
        at = end + 2
        while at < n and text[at] == " ":
            at += 1
        if at >= n:
            raise Fail(COLUMN_COUNT)
        if text[at] != "(":
            raise Fail(UNCLOSED_BRACKET if ")" in text[at:] else COLUMN_COUNT)
        stop = at + 1
        while stop < n and text[stop] not in "(){}[]":
            stop += 1
        if stop >= n or text[stop] != ")":
            raise Fail(UNCLOSED_BRACKET)
        lat, lon = _point(text[at + 1 : stop])
        found.append((name, lat, lon))
        at = stop + 1
        if at < n:
            more = re.compile(r",\s*").match(text, at)
            if more is None or more.end() >= n:
                raise Fail(COLUMN_COUNT)
            at = more.end()
    return found


def _statements(text: str) -> list[tuple[str, str]]:
    first = _FIRST.match(text)
    if not first or not _DATE.fullmatch(first[1]):
        raise Fail(INVALID_VALUE)
    starts = list(_START.finditer(text))
    found = []
    for a, b in zip(starts, [*starts[1:], None]):
        date = _DATE.fullmatch(a[1])
        if not date:
            raise Fail(INVALID_VALUE)
        try:
            datetime.date(*map(int, date.groups()))
        except ValueError:
            raise Fail(INVALID_VALUE) from None
        found.append((a[1], text[a.end() : b.start() if b else None].strip()))
    return found


def parse(line: str) -> Parts:
    """The parts of a well-formed line; raises Fail with the reason otherwise. Blanks and carriage returns may end it."""
    line = line.rstrip(" \t\r\n")
    ident, comma, rest = line.partition(",")
    if not comma:
        raise Fail(COLUMN_COUNT)
    if rest.strip('" ') == "":
        raise Fail(COLUMN_COUNT)
    body = _unquoted(rest)

    # The statements are the first part that opens with a square bracket.
    cut = body.find(",[")
    head, tail = (body[:cut], body[cut + 2 :]) if cut >= 0 else (body, None)
    if tail is None:
        bare = re.search(r"\}\s*,(?=\S+:\s)", body)
        if bare:
            raise Fail(UNCLOSED_BRACKET)
        if body.endswith("]") and not _balanced(body):
            raise Fail(UNCLOSED_BRACKET)
    brace = head.find(",{")
    if brace < 0:
        if "}" in head or "{" in head:
            raise Fail(UNCLOSED_BRACKET if not _balanced(head) else COLUMN_COUNT)
        if not _balanced(head):
            raise Fail(UNCLOSED_BRACKET)
        raise Fail(COLUMN_COUNT)
    front, places = head[:brace], head[brace + 2 :]
    if not front.endswith(")"):
        raise Fail(UNCLOSED_BRACKET if re.search(r"(?:^|,)\([^()]*$", front) else COLUMN_COUNT)
    opened = front.rfind("(")
    if opened < 0:
        raise Fail(UNCLOSED_BRACKET)
    url = front[: opened - 1] if opened else ""
    if opened == 0 or front[opened - 1] != "," or not url:
        raise Fail(COLUMN_COUNT)
    if re.search(r"(?:^|,)\([^()]*\)$", url):  # a url may hold commas, but a second point is a part too many
        raise Fail(COLUMN_COUNT)
    if not places.endswith("}"):
        raise Fail(COLUMN_COUNT if "}" in places else UNCLOSED_BRACKET)
    if tail is None:
        raise Fail(COLUMN_COUNT)
    pairs = _places(places[:-1])
    if not tail.endswith("]"):
        ended = re.match(r"(.*)\](?:,[^\[\]]*)+$", tail, re.S)
        raise Fail(COLUMN_COUNT if ended and _balanced(ended[1]) else UNCLOSED_BRACKET)
    if not _balanced(tail[:-1]):
        ended = re.match(r"(.*)\](?:,.*)$", tail, re.S)
        raise Fail(COLUMN_COUNT if ended and _balanced(ended[1]) and _balanced(tail[ended.end(1) + 1 :]) else UNCLOSED_BRACKET)
    statements = _statements(tail[:-1])
    lat, lon = _point(front[opened + 1 : -1])
    if not _ID.fullmatch(ident):
        raise Fail(INVALID_VALUE)
    return Parts(ident, url, lat, lon, pairs, statements)


LOADED = "line_no long, event_id string, url string, lat double, lon double, locations array<struct<name:string,lat:double,lon:double>>, statements array<struct<date:string,text:string>>"


def _load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for line_no, raw in zip(batch["line_no"], batch["raw_line"]):
            try:
                p = parse(raw or "")
            except Fail:
                continue
            rows.append((line_no, p.event_id, p.url, p.lat, p.lon, [dict(name=n, lat=a, lon=b) for n, a, b in p.places], [dict(date=d, text=t) for d, t in p.statements]))
        yield pd.DataFrame(rows, columns=["line_no", "event_id", "url", "lat", "lon", "locations", "statements"])


def load_rows(lines: DataFrame) -> DataFrame:
    """The conforming lines of ``lines`` (line_no, raw_line), parsed; see LOADED.

    Lines without a number are left out; null and empty lines do not conform; repeated lines load each under its own line_no; an id stays text, for it may have any
    number of digits. Other columns are ignored.
    """
    return lines.select(F.col("line_no").cast("long").alias("line_no"), "raw_line").filter("line_no is not null").mapInPandas(_load, LOADED)


def _diagnose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        reasons = []
        for raw in batch["raw_line"]:
            try:
                parse(raw or "")
                reasons.append(None)
            except Fail as e:
                reasons.append(str(e))
        yield pd.DataFrame({"line_no": batch["line_no"], "reason": reasons})


def failed_rows(lines: DataFrame) -> DataFrame:
    """The lines that load_rows leaves out, with one reason each: line_no, reason.

    line_no must be unique. Up to BROADCAST_ROWS failed offsets are sent to the lines, more are joined with them. An empty table gives an empty result; null and empty lines lack their columns.
    """
    raw = lines.select(F.col("line_no").cast("long").alias("line_no"), "raw_line").filter("line_no is not null")
    # Only offsets are shuffled; the texts of what is left are fetched from the lines.
    left = cut(raw.select("line_no").join(load_rows(raw).select("line_no"), "line_no", "left_anti"))
    few = left.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return raw.join(F.broadcast(left) if few else left, "line_no", "left_semi").mapInPandas(_diagnose, "line_no long, reason string")
