"""Sizes of texts in tokens of a public tokenizer; the folder of its files is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

FOLDER = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are encoded in pieces of about this many characters, cut before white space, which no token of the pattern spans.
PIECE = 100_000


def encoding(folder: str = FOLDER, ranks: str = RANKS):
    """The byte-level tokenizer of a rank file."""
    import tiktoken

    with open(os.path.join(folder, ranks), "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(ranks, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def _count(text: str, encode) -> int:
    total, at = 0, 0
    while len(text) - at > 2 * PIECE:
        cut = text.rfind(" ", at + 1, at + PIECE)
        while cut > at and text[cut - 1].isspace():
            cut -= 1
        if cut <= at:
            cut = at + PIECE
        total += len(encode(text[at:cut]))
        at = cut
    return total + len(encode(text[at:]))


def _counts(folder: str, ranks: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(folder, ranks).encode_ordinary
        for batch in batches:
            yield batch.drop(columns="text").assign(tokens=[_count(t, encode) if isinstance(t, str) else 0 for t in batch["text"]])

    return run


def token_counts(documents: DataFrame, folder: str = FOLDER, ranks: str = RANKS) -> DataFrame:
    """``documents`` (id, source, text) with the number of tokens instead of the text; null texts have none; rows without an id are left out."""
    rows = documents.select(F.col("id").cast("long").alias("id"), "source", "text").filter("id is not null")
    return rows.mapInPandas(_counts(folder, ranks), "id long, source string, tokens long")
