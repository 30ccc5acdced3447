"""Excerpts of long texts within a budget: around anchors first, then what else fits, and the outline."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

# What scopes and duties are introduced by, headings, marks of an excerpt.
ANCHORS = ("适用范围", "本文件适用于", "本办法适用于", "适用于", "起草说明", "编制说明", "征求意见", "第一条", "第二条", "第三条", "第一章", "第二章", "各单位、各")
HEADING = re.compile(r"第[一二三四五六七八九十百零〇\d]+[章节编部分]|[一二三四五六七八九十]+、")
GAP, OUTLINE = "\n……（中间省略）……\n", "\n【全文结构（标题骨架）】\n"
BUDGET, REACH, HITS = 8000, 300, 3
LINES, LINE, OUTLINE_CHARS = 12, 60, 900


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def excerpt_of(text: str | None, anchors: tuple[str, ...] = ANCHORS, budget: int = BUDGET, reach: int = REACH) -> str | None:
    if text is None or len(text) <= budget:
        return text
    headings = [line.strip()[:LINE] for line in text.split("\n") if HEADING.match(line.strip())][:LINES]
    for_outline = min(OUTLINE_CHARS, budget // 8) if headings else 0
    left = budget - for_outline - len(OUTLINE) - len(GAP)
    hits = [m.span() for a in anchors for m, _ in zip(re.finditer(re.escape(a), text), range(HITS))]
    near = _union([(max(0, a - reach), min(len(text), b + reach)) for a, b in hits])
    between = list(zip([0, *(b for _, b in near)], [*(a for a, _ in near), len(text)]))
    taken: list[tuple[int, int]] = []
    for group in (near, [(a, b) for a, b in between if a < b]):
        for a, b in group:
            room = left - (len(GAP) if taken else 0)
            if room <= 0:
                break
            taken.append((a, min(b, a + room)))
            left = room - (taken[-1][1] - a)
            if taken[-1][1] < b:
                break
    out = GAP.join(text[a:b] for a, b in sorted(taken))
    if headings:
        out += GAP + OUTLINE + "\n".join(headings)[:for_outline]
    return out[:budget]


def excerpt(text: Column, anchors: tuple[str, ...] = ANCHORS, budget: int = BUDGET, reach: int = REACH) -> Column:
    """At most ``budget`` characters of a text; a text that fits is whole.

    Windows around the anchors' first places come first, made one where they meet; what is left of the
    budget goes to the rest in order of place; what was left out is marked, and the headings come last.
    """

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([excerpt_of(t, anchors, budget, reach) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")(text)
