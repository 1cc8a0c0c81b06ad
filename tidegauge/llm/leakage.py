"""Problem 7: passages of evaluation texts that stand, wholly or partly, in a corpus.

Wu-Manber multi-pattern search over words. The patterns are all runs of ``span`` words of the passages, so a
document that holds ``span`` consecutive words of a passage holds a pattern whole. Words get numbers, those of
no passage get none. A window of ``span`` words moves over the document; the last block of two words in it looks up
in the shift table how far the window can move without passing the end of any pattern. Where the shift is zero, the
bucket of that block names the patterns that end so; a hash of their first block sorts out most, and
the rest are compared word by word. Only the passages are sent to the tasks; the corpus is read once, without a shuffle.

If there are more passages than fit in one table, the tables are built in blocks and each block reads the corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.words import words

#: Words of passages in one table; more passages are searched for in several blocks.
TABLE_WORDS = 200_000
_BLOCK = 2


class Patterns:
    """Shift table, and buckets of patterns by their last block, of all runs of ``span`` words of the passages."""

    def __init__(self, passages: list[tuple[int, list[str]]], span: int) -> None:
        if span < _BLOCK:
            raise ValueError("a span has two words or more")
        self.span = span
        self.number: dict[str, int] = {}
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[tuple[int, tuple[int, ...], tuple[int, ...]]]] = {}
        number = self.number
        runs: dict[tuple[int, ...], set[int]] = {}
        for item, found in passages:
            ids = [number.setdefault(w, len(number) + 1) for w in found]
            for k in range(len(ids) - span + 1):
                runs.setdefault(tuple(ids[k : k + span]), set()).add(item)
        for run, items in runs.items():
            for end in range(_BLOCK, span + 1):
                block = self.block(run[end - 2], run[end - 1])
                self.shift[block] = min(self.shift.get(block, span), span - end)
            self.bucket.setdefault(self.block(run[-2], run[-1]), []).append((self.block(run[0], run[1]), run, tuple(sorted(items))))

    @staticmethod
    def block(a: int, b: int) -> int:
        """Blocks with a word of no passage are all the same, and in no pattern."""
        return a << 32 | b if a and b else 0

    def search(self, text: str | None) -> set[int]:
        """Items of which ``text`` holds a pattern."""
        span, shift, bucket, number = self.span, self.shift, self.bucket, self.number
        found = words(text)
        n = len(found)
        hits: set[int] = set()
        if n < span:
            return hits
        ids = [number.get(w, 0) for w in found]
        farthest = span - _BLOCK + 1
        end = span
        while end <= n:
            a, b = ids[end - 2], ids[end - 1]
            if not b:  # no window that holds this word can match
                end += span
                continue
            if not a:
                end += farthest
                continue
            move = shift.get(a << 32 | b, farthest)
            if move:
                end += move
                continue
            first = self.block(ids[end - span], ids[end - span + 1])
            for head, run, items in bucket[a << 32 | b]:
                if head == first and not hits.issuperset(items) and tuple(ids[end - span : end]) == run:
                    hits.update(items)
            end += 1
        return hits


#: The tables that this worker built last, by the name they were sent under; a worker runs many tasks.
_BUILT: dict[str, Patterns] = {}


def _search(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, block, span = shared.value
        patterns = _BUILT.get(name)
        if patterns is None:
            _BUILT.clear()
            patterns = _BUILT[name] = Patterns(block, span)
        for batch in batches:
            ids, items = [], []
            for ident, text in zip(batch["id"], batch["text"]):
                for item in sorted(patterns.search(text)):
                    ids.append(ident)
                    items.append(item)
            yield pd.DataFrame({"id": ids, "item": items}, dtype="int64")

    return run


def leaked_passages(corpus: DataFrame, passages: DataFrame, span: int = 12, table_words: int = TABLE_WORDS) -> DataFrame:
    """Each document with each passage of which it holds at least ``span`` consecutive words: doc_id, item_id.

    ``corpus`` and ``passages`` have id (integer) and text. Rows without an id and null, empty and short texts match nothing; a passage of fewer than ``span`` words
    matches nowhere; documents that repeat under another id match each; passages that share words match each; either table may
    be empty. Other columns are ignored.
    """
    spark = corpus.sparkSession
    docs = corpus.select(F.col("id").cast("long").alias("id"), "text").filter("id is not null and text is not null")
    result, block, held = None, [], 0

    def add(result, block):
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, block, span))
        part = docs.mapInPandas(_search(sent), "id long, item long")
        return part if result is None else result.unionByName(part)

    for row in passages.select(F.col("id").cast("long").alias("id"), "text").filter("id is not null and text is not null").toLocalIterator():
        found = words(row["text"])
        if held + len(found) > table_words and block:
            result, block, held = add(result, block), [], 0
        block.append((row["id"], found))
        held += len(found)
    result = add(result, block)
    return result.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def leaked_items(found: DataFrame, passages: DataFrame) -> DataFrame:
    """Which passages leaked: item_id and the number of documents that hold it, 0 for those that did not."""
    per = found.groupBy("item_id").agg(F.count("*").alias("documents"))
    items = passages.select(F.col("id").cast("long").alias("item_id"))
    return items.join(per, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"))
