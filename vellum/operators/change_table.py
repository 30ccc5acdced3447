"""The table of changes: every sentence that a word of change stands in, told by a model's row or as it is."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, functions as F

from ..functions.positions import Places, segments_of
from ..functions.summaries import CHANGE_MARKS
from ..functions.text import SENTENCE_ENDS

# A clause's name, the beginning of a sub-item.
CLAUSE = re.compile("第[一二三四五六七八九十百零两0-9]{1,6}条(?:第[一二三四五六七八九十]{1,3}款)?")
SUB_ITEM = re.compile(r"\s*[（(][一二三四五六七八九十0-9]{1,3}[）)]")
_SENTENCE = re.compile(f"[^{SENTENCE_ENDS}\n]*(?:[{SENTENCE_ENDS}\n]|$)")
_MARKS = [(kind, re.compile(words, re.I)) for kind, words in CHANGE_MARKS.items()]

ROW = "pos int, type string, change int, clause string, kinds array<string>, marks array<string>, sentence string"


def table_rows(text: str | None, quotes: list[str | None] | None):
    """Rows (as ``ROW``) in order of sentences, then the model's rows that belong to none.

    A model's row belongs to the first sentence with a word of change that its quotation touches, else
    to the first that it touches. A heading, without quotation marks and before a sub-item, is no row;
    what belongs to it comes last, as no row of the model's is lost.
    """
    text, quotes = text or "", quotes or []
    marks = sorted((m.start(), kind, m[0]) for kind, pattern in _MARKS for m in pattern.finditer(text))
    if not marks:
        return
    spans = [m.span() for m in _SENTENCE.finditer(text) if m.end() > m.start()]
    starts, places = [a for a, _ in spans], Places(text)
    held: dict[int, list] = {}
    for mark in marks:
        held.setdefault(bisect_right(starts, mark[0]) - 1, []).append(mark)
    sentences = [text[a:b].strip() for a, b in spans]
    owned: dict[int, list[int]] = {}
    for n, quote in enumerate(quotes):
        touched = set()
        for segment in segments_of(quote):
            if place := places.find(segment):
                touched.update(range(bisect_right(starts, place[0]) - 1, bisect_left(starts, place[1])))
        if touched:
            owned.setdefault(min(touched & held.keys() or touched), []).append(n)
    shown, pos = set(), 0
    told = [k for k in sorted(held) if sentences[k]]
    for k, after in zip(told, [*told[1:], None]):
        following = [next((s for s in sentences[k + 1 :] if s), ""), "" if after is None else sentences[after]]
        if not re.search('[“”"]', sentences[k]) and any(map(SUB_ITEM.match, following)):
            continue
        for n in owned.get(k, ()):
            yield pos, "described", n, None, None, None, sentences[k]
            shown.add(n)
            pos += 1
        if k not in owned:
            clause = CLAUSE.search(sentences[k])
            yield pos, "fact", None, clause[0] if clause else "", list(dict.fromkeys(m[1] for m in held[k])), list(dict.fromkeys(m[2] for m in held[k])), sentences[k]
            pos += 1
    for n in range(len(quotes)):
        if n not in shown:
            yield pos, "described", n, None, None, None, None
            pos += 1


def change_table(rows: DataFrame) -> DataFrame:
    """(id, pos, type, change, clause, kinds, marks, sentence) for texts with a model's quotations (id, text, quotes)."""

    class Rows:
        def eval(self, text: str, quotes: list):
            yield from table_rows(text, quotes)

    told = F.udtf(Rows, returnType=ROW)
    return rows.select("id", "text", "quotes").lateralJoin(told(F.col("text").outer(), F.col("quotes").outer())).drop("text", "quotes")
