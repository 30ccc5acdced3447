"""Places of quotations in texts that differ from them in white space and quotation marks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

from .text import LEAST_SEGMENT, QUOTE_GLYPHS

_ONE_MARK = str.maketrans(QUOTE_GLYPHS, '"' * len(QUOTE_GLYPHS))
_PAUSE = re.compile("…+|\\.{3,}")


def segments_of(quote: str | None) -> list[str]:
    """A quotation's parts between ellipses."""
    return [s.strip() for s in _PAUSE.split(quote or "") if s.strip()]


class Places:
    """A text without white space and with one quotation mark, and where each character of that stands in the text."""

    def __init__(self, text: str):
        marked = text.translate(_ONE_MARK)
        self.flat = "".join(marked.split())
        self.at = [m.start() for m in re.finditer(r"\S", marked)]

    def find(self, segment: str, least: int = LEAST_SEGMENT) -> tuple[int, int] | None:
        """(start, end) in the text of a segment's first place, as it is or without marks around it."""
        bare = "".join(segment.translate(_ONE_MARK).split())
        for needle in (bare, bare.strip('"')):
            if len(needle) >= least and (k := self.flat.find(needle)) >= 0:
                return self.at[k], self.at[k + len(needle) - 1] + 1
        return None


def around(text: str | None, quote: str | None, reach: int) -> str | None:
    parts = [s for s in segments_of(quote) if len(s) >= LEAST_SEGMENT]
    if not text or not parts:
        return None
    longest = max(parts, key=len)
    start = text.find(longest)
    place = (start, start + len(longest)) if start >= 0 else Places(text).find(longest)
    return None if place is None else text[max(0, place[0] - reach) : place[1] + reach]


def neighborhood(text: Column, quote: Column, reach: int = 200) -> Column:
    """The text around a quotation's longest part, which may differ in white space and quotation marks.

    Null where no part is long enough to tell (``LEAST_SEGMENT``), or none stands in the text.
    """

    def run(texts: pd.Series, quotes: pd.Series) -> pd.Series:
        return pd.Series([around(t, q, reach) for t, q in zip(texts, quotes)], dtype=object)

    return F.pandas_udf(run, "string")(text, quote)
