"""Words as all text comparisons of this package see them."""

from __future__ import annotations

import re
import unicodedata

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters or digits of the compatibility-normalised text in lower case; none for null."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return WORD.findall(text.lower())
