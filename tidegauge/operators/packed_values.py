"""Problem 1: several values packed in one field, each put in a row of its own with its position.

Dictionary-guided segmentation. Values that stand where their limits can't be mistaken (in quotes, or before
coordinates) are the known whole values; those of them that hold a delimiter are the dictionary, for only they can be
torn apart. A multi-pattern automaton finds them in a field, and dynamic programming picks the cover of the
field that explains it best: a known or quoted value is one piece however many delimiters it holds, a stretch without
delimiters is a piece, and the cover with the fewest pieces wins, ties going to known values that begin first.

The dictionary grows with the data, so it is sent to all tasks only if it was counted and is small. Otherwise the stretches of pieces of
each field are joined with the entries by equality, and each field has an automaton of those that it holds.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import BROADCAST_ROWS, cut

_DELIMITERS = ",;|/\n\r\t"
_SPLIT = re.compile(r"[,;|/\n\r\t]+")
_NUMBER = r"[+-]?\d+(?:\.\d+)?"
_COORDS = re.compile(rf"\s*:?\s*\(\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\)")
#: What may follow a quoted value: the end, a delimiter, coordinates, or brackets around the field.
_AFTER_QUOTE = re.compile(rf"\s*(?:$|[{re.escape(_DELIMITERS)}]|:?\s*\(\s*{_NUMBER}\s*,|[\])}}]+\s*(?:$|[{re.escape(_DELIMITERS)}]))")
_QUOTES = "\"'“”‘’«»`"
_WRAP = {"[": "]", "{": "}", "(": ")"}

#: A statement begins with a date that a colon or a spaced dash follows; other dates belong to the text.
STATEMENT = re.compile(r"(?<![\d/-])(\d{4})([-/])(\d{2})\2(\d{2})(?:\s*:|\s+[-–—](?=\s))")


def unwrap(text: str) -> str:
    """The field without brackets that enclose all of it, however deep."""
    text = text.strip()
    while text and text[0] in _WRAP and text[-1] == _WRAP[text[0]]:
        depth = 0
        for k, c in enumerate(text):
            if c == text[0]:
                depth += 1
            elif c == text[-1]:
                depth -= 1
                if depth == 0 and k < len(text) - 1:
                    return text
        if depth:
            return text
        text = text[1:-1].strip()
    return text


def bare(value: str) -> str:
    """The value without surrounding quotes, spaces and left-over brackets that have no partner."""
    before = None
    while before != value:
        before = value
        value = value.strip()
        if len(value) > 1 and value[0] in _QUOTES and value[-1] in _QUOTES:
            value = value[1:-1]
        elif value[:1] in _QUOTES and value.count(value[0]) % 2 == 1 and value[0] != "'":
            value = value[1:]
    return value


def automaton(known: list[str]):
    """The multi-pattern automaton of the known values; None if there is none."""
    if not known:
        return None
    found = ahocorasick.Automaton()
    for value in known:
        found.add_word(value, value)
    found.make_automaton()
    return found


def _quoted(text: str) -> list[tuple[int, int]]:
    """Spans of quoted values; a quote opens only where a value may begin."""
    spans, at = [], 0
    closing = {c: [m.start() for m in re.finditer(c, text) if _AFTER_QUOTE.match(text, m.end())] for c in "\"'"}
    while at < len(text):
        c = text[at]
        if c in closing:
            k = bisect_right(closing[c], at)
            if k < len(closing[c]):
                spans.append((at, closing[c][k] + 1))
                at = closing[c][k] + 1
        # On to where the next value may begin; coordinates are passed over whole.
        while at < len(text) and text[at] not in _DELIMITERS:
            pair = _COORDS.match(text, at) if text[at] in ":( " else None
            at = pair.end() if pair else at + 1
        while at < len(text) and (text[at] in _DELIMITERS or text[at].isspace()):
            at += 1
    return spans


def segments(text: str | None, known) -> list[tuple[str, bool]]:
    """The values of a field in written order, each with whether its limits can't be mistaken (quoted, or followed by coordinates)."""
    if not text:
        return []
    text = unwrap(text)
    n = len(text)
    inside = bytearray(n + 1)  # positions where no cut may fall: inside coordinates
    for m in _COORDS.finditer(text):
        inside[m.start() + 1 : m.end()] = b"\1" * (m.end() - m.start() - 1)
    quoted = _quoted(text)
    jumps: dict[int, list[tuple[int, int]]] = {}  # from a position: spans that are one piece, with their cost
    for a, b in quoted:
        jumps.setdefault(a, []).append((b, 0))
        inside[a + 1 : b] = b"\1" * (b - a - 1)
    delimiter = [c in _DELIMITERS and not inside[k] for k, c in enumerate(text)]
    if known is not None:
        for last, value in known.iter(text):
            a, b = last - len(value) + 1, last + 1
            before, after = a - 1, b
            while before >= 0 and text[before] == " ":
                before -= 1
            while after < n and text[after] == " ":
                after += 1
            left = before < 0 or text[before] in _DELIMITERS
            right = after >= n or text[after] in _DELIMITERS or _COORDS.match(text, b)
            if not inside[a] and left and right and any(delimiter[a:b]):
                jumps.setdefault(a, []).append((b, 0))
    following = [n] * (n + 1)  # the next delimiter at or after each position
    for k in range(n - 1, -1, -1):
        following[k] = k if delimiter[k] else following[k + 1]
    # cost[k]: fewest pieces that cover the text up to k; a piece runs on to the next delimiter.
    none = (n + 1, 0)
    cost, back = [none] * (n + 1), [0] * (n + 1)
    cost[0] = (0, 0)
    for k in range(n):
        if cost[k] == none:
            continue
        here = cost[k]
        if delimiter[k] or text[k].isspace():
            if here < cost[k + 1]:
                cost[k + 1], back[k + 1] = here, k
            continue
        ends = list(jumps.get(k, ()))
        ends.append((following[k], 1))
        for end, extra in ends:
            stop = following[end]  # coordinates and blanks after a known value
            new = (here[0] + 1, here[1] + extra)
            if new < cost[stop]:
                cost[stop], back[stop] = new, k
    pieces, k = [], n
    while k > 0:
        a = back[k]
        piece = text[a:k]
        if piece.strip() and not (k - a == 1 and delimiter[a]):
            pieces.append(piece)
        k = a
    found = []
    for piece in reversed(pieces):
        name, pairs = _COORDS.subn("", piece)
        sure = bool(pairs) or piece.strip()[:1] in "\"'"
        value = bare(name.strip().rstrip(":"))
        if value:
            found.append((value, sure))
    return found


def statement_spans(text: str | None) -> list[tuple[str, str]]:
    """(date as yyyy-MM-dd, text) of each dated statement of a field, in written order."""
    if not text:
        return []
    starts = list(STATEMENT.finditer(text))
    found = []
    for a, b in zip(starts, [*starts[1:], None]):
        said = text[a.end() : b.start() if b else len(text)]
        found.append((f"{a[1]}-{a[3]}-{a[4]}", said.strip(" \n\r\t,;|/\"'")))
    return found


def _learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Known whole values that hold a delimiter. Only quotes keep a delimiter from cutting, so only quoted values are looked at."""
    seen: set[str] = set()
    for batch in batches:
        known = set()
        for text in batch["field"]:
            if "'" in text or '"' in text:
                text = unwrap(text)
                known.update(v for v in (bare(text[a:b]) for a, b in _quoted(text)) if _SPLIT.search(v))
        known -= seen
        if len(seen) < BROADCAST_ROWS:
            seen |= known
        if known:
            yield pd.DataFrame({"value": list(known)})


def learn_values(fields: DataFrame) -> DataFrame:
    """The dictionary: known whole values that hold a delimiter. ``fields`` has the column field; no field is shuffled."""
    return fields.select("field").filter("field is not null").mapInPandas(_learn, "value string").distinct()


def _cut_all(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = automaton(shared.value)
        for batch in batches:
            yield batch.drop(columns="field").assign(items=[[v for v, _ in segments(t, known)] for t in batch["field"]])

    return run


def _cut_own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        items = [[v for v, _ in segments(t, automaton(list(own)) if own is not None and len(own) else None)] for t, own in zip(batch["field"], batch["known"])]
        yield batch[["id"]].assign(items=items)


def spans(text: str, most: int) -> set[str]:
    """All stretches of two to ``most`` pieces of the field that might be one value: coordinates end a stretch."""
    found = set()
    text = _COORDS.sub("\0", unwrap(text))
    ends = [(m.start(), m.end()) for m in _SPLIT.finditer(text)] + [(len(text), len(text))]
    begin = 0
    for k, (_, after) in enumerate(ends):
        for stop, _ in ends[k + 1 : k + most]:
            whole = text[begin:stop].strip(" ")
            if "\0" in whole[:-1]:
                break
            found.add(whole.rstrip("\0").strip(" "))
        begin = after
    return found


def _spans(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, v) for k, text in zip(batch["row"], batch["field"]) for v in spans(text, most)]
            if rows:
                yield pd.DataFrame(rows, columns=["row", "value"])

    return run


def split_names(rows: DataFrame, sent_values: int = BROADCAST_ROWS) -> DataFrame:
    """Each row of ``rows`` (id: an integer, field) with the values of its field in written order: id, items.

    Null fields give no row, empty fields and values no item. The dictionary is learnt from the same fields; with up to
    ``sent_values`` entries it is sent to all tasks, beyond that each field gets the entries that equal one of its stretches of pieces.
    """
    rows = rows.select(F.col("id").cast("long").alias("id"), "field").filter("id is not null and field is not null")
    known = cut(learn_values(rows))
    if known.limit(sent_values + 1).count() <= sent_values:
        sent = rows.sparkSession.sparkContext.broadcast(sorted(r[0] for r in known.toLocalIterator()))
        return rows.mapInPandas(_cut_all(sent), "id long, items array<string>")
    most = 1 + known.agg(F.max(F.size(F.regexp_extract_all("value", F.lit(f"({_SPLIT.pattern})"), F.lit(1))))).first()[0]
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    own = rows.select("row", "field").mapInPandas(_spans(most), "row long, value string").join(known, "value").groupBy("row").agg(F.collect_set("value").alias("known"))
    return rows.join(own, "row", "left").select("id", "field", "known").mapInPandas(_cut_own, "id long, items array<string>")


def _dates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.drop(columns="field").assign(items=[[d for d, _ in statement_spans(t)] for t in batch["field"]])


def split_packed(rows: DataFrame, key: str, names: str, statements: str, least: int = 2) -> DataFrame:
    """One row per value of the two packed columns of ``rows``: key, field_name, pos, item; of fields with at least ``least`` values.

    The item is the bare name, coordinates left out, or the date of the statement. Positions count from 0 in written order.
    Repeated rows count for themselves. Rows without a key and null, empty and blank fields, fields without a value and an empty table give no rows;
    other columns are ignored.
    """
    places = split_names(rows.select(F.col(key).alias("id"), F.col(names).alias("field")))
    dated = rows.select(F.col(key).cast("long").alias("id"), F.col(statements).alias("field")).filter("id is not null and field is not null").mapInPandas(_dates, "id long, items array<string>")
    both = places.withColumn("field_name", F.lit(names)).unionByName(dated.withColumn("field_name", F.lit(statements)))
    return both.filter(F.size("items") >= least).select(F.col("id").alias(key), "field_name", F.posexplode("items").alias("pos", "item"))
