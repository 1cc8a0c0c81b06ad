"""Column expressions on text that built-in functions do not offer by name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strip(c: Column) -> Column:
    """The text without white space of any kind at its ends (trim() takes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def one_line(c: Column) -> Column:
    """The text with line ends and tabs as blanks."""
    return F.translate(c, "\n\r\t", "   ")


def contains_any(c: Column, phrases) -> Column:
    """Whether the text holds one of the phrases, as written."""
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(c, F.lit(p))
    return found


def hashed(*parts) -> Column:
    """md5 of the parts joined by colons: the order of everything that is drawn or shuffled."""
    return F.md5(F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def draw(n, *parts) -> Column:
    """A number from 0 to n - 1, the same for the same parts."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(F.conv(F.substring(hashed(*parts), 1, 8), 16, 10).cast("long"), n).cast("int")


def choose(choices, *parts) -> Column:
    """One of a fixed list of texts."""
    return F.element_at(F.array(*(F.lit(c) for c in choices)), draw(len(choices), *parts) + 1)
