"""Search texts of declarations and the links that a search finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import BLACKLIST
from ..functions.text import contains_any


def search_text(*parts: str) -> Column:
    """The parts joined by blanks; a null part is written as nan."""
    return F.concat_ws(" ", *(F.coalesce(F.col(p).cast("string"), F.lit("nan")) for p in parts))


def kept_links(links: DataFrame, url: str = "url", unwanted=BLACKLIST, strict: bool = True) -> DataFrame:
    """Links whose address holds none of the unwanted substrings; null addresses go. Without ``strict`` only nulls go, as when the list had no effect."""
    known = links.filter(F.col(url).isNotNull())
    return known.filter(~contains_any(F.col(url), unwanted)) if strict else known
