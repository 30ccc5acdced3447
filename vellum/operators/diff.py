"""Clause diff of two versions of a text.

Clauses come from a split by lines with a window; a pair's clauses are aligned by a small Python
helper that sees one pair at a time, as the alignment is sequential by nature.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

CHAPTER = r"^\s*第[0-9一二三四五六七八九十百零〇]+[章编节]"
ARTICLE = r"^\s*(第[0-9一二三四五六七八九十百千零〇]+条|\d+[.、)])"
LEAST_SIMILAR = 0.5
#: Cells of the table of common lengths that are held at once; larger tables are made again part by part.
MOST_CELLS = 4_000_000
LONGEST_CHARS = 1500


def clauses(texts: DataFrame) -> DataFrame:
    """(id, pos, kind, label, text): chapters, articles with the lines that follow them, loose paragraphs."""
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).withColumn("raw", F.trim("raw")).where("raw <> ''")
    kind = F.when(F.col("raw").rlike(CHAPTER), "chapter").when(F.col("raw").rlike(ARTICLE), "article").otherwise("paragraph")
    w = Window.partitionBy("id").orderBy("line")
    marked = lines.withColumn("kind", kind).withColumn("head", F.last(F.when(F.col("kind") != "paragraph", F.struct("line", "kind")), ignorenulls=True).over(w))
    joins = (F.col("kind") == "paragraph") & (F.col("head.kind") == "article")
    grouped = marked.withColumn("pos", F.when(joins, F.col("head.line")).otherwise(F.col("line"))).withColumn("kind", F.when(joins, "article").otherwise(F.col("kind")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), "\n")
    out = grouped.groupBy("id", "pos", "kind").agg(text.alias("text"))
    return out.select("id", "pos", "kind", F.trim(F.regexp_extract("text", ARTICLE, 0)).alias("label"), "text")


def similarity(a: str, b: str) -> float:
    """Dice of the multisets of two-character pieces, white space aside."""
    a, b = re.sub(r"\s+", "", a), re.sub(r"\s+", "", b)
    if a == b:
        return 1.0
    ga, gb = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    total = ga.total() + gb.total()
    return 2 * (ga & gb).total() / total if total else 0.0


def _above(old: int, new: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The row above ``below`` in the table of common lengths: at j, that of the texts from this old and new[j] on."""
    row = below.copy()
    np.maximum(row[:-1], np.where(new == old, below[1:] + 1, 0), out=row[:-1])
    return np.maximum.accumulate(row[::-1])[::-1]


def _walk(old: np.ndarray, new: np.ndarray, i: int, stop: int, row: np.ndarray, j: int, most_cells: int, out: list[tuple[int, int]]) -> int:
    """Adds the pairs of old positions ``i`` to ``stop`` and new ones from ``j``; gives the new position reached.

    ``row`` is the table's row ``stop``, from column ``j`` on. A table too large is cut into 16 parts,
    of which only the last rows are held, so memory is in proportion to the new text.
    """
    rest = new[j:]
    if stop - i > 1 and (stop - i) * len(row) > most_cells:
        step = -(-(stop - i) // 16)
        ends = [*range(i + step, stop, step), stop]
        last = {stop: row}
        for k in range(stop - 1, ends[0] - 1, -1):
            row = _above(old[k], rest, row)
            if (k - i) % step == 0:
                last[k] = row
        first = j
        for end in ends:
            j = _walk(old, new, i, end, last.pop(end)[j - first :], j, most_cells, out)
            i = end
        return j
    rows = [row]
    for k in range(stop - 1, i - 1, -1):
        rows.append(_above(old[k], rest, rows[-1]))
    start, first = i, j
    rows.reverse()
    while i < stop and j < len(new):
        if old[i] == new[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rows[i + 1 - start][j - first] >= rows[i - start][j + 1 - first]:
            i += 1
        else:
            j += 1
    return j


def common_pairs(old: list[str], new: list[str], most_cells: int = MOST_CELLS) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence; the earliest old positions where there is a choice."""
    same = 0  # a common beginning is paired in any case; a common end may have other partners
    while same < min(len(old), len(new)) and old[same] == new[same]:
        same += 1
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(x, len(number)) for x in side[same:]], np.int64) for side in (old, new))
    out: list[tuple[int, int]] = []
    if len(a) and len(b):
        _walk(a, b, 0, len(a), np.zeros(len(b) + 1, np.int32), 0, most_cells, out)
    return [(k, k) for k in range(same)] + [(same + i, same + j) for i, j in out]


def align(old: list[tuple[str, str]], new: list[tuple[str, str]]) -> list[tuple[str, int | None, int | None]]:
    """(change, old position, new position) of clauses (label, text): same, modified, removed, added.

    Equal clauses anchor the alignment. In the gaps between anchors clauses of one label belong
    together, then the most similar ones, the earlier old and then new one first among equals.
    """
    bare = [[re.sub(r"\s+", "", t) for _, t in side] for side in (old, new)]
    anchors = common_pairs(*bare)
    rows: list[tuple[str, int | None, int | None]] = []
    i = j = 0
    for a, b in [*anchors, (len(old), len(new))]:
        left, right, pairs = list(range(i, a)), list(range(j, b)), {}
        for x in left:
            match = next((y for y in right if old[x][0] and new[y][0] == old[x][0] and y not in pairs.values()), None)
            if match is not None:
                pairs[x] = match
        scored = sorted((-similarity(old[x][1], new[y][1]), x, y) for x in left if x not in pairs for y in right if y not in pairs.values())
        for score, x, y in scored:
            if -score >= LEAST_SIMILAR and x not in pairs and y not in pairs.values():
                pairs[x] = y
        of_new = {y: x for x, y in pairs.items()}
        rows += [("removed", x, None) for x in left if x not in pairs]
        for y in right:
            x = of_new.get(y)
            rows.append(("added", None, y) if x is None else ("modified", x, y))
        if a < len(old) and b < len(new):
            rows.append(("same", a, b))
        i, j = a + 1, b + 1
    return rows


def clause_diff(pairs: DataFrame) -> DataFrame:
    """(pair_id, row, change, old_text, new_text) for pairs (pair_id, old, new) of texts; a pair is one unit of work."""
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("old").alias("side"), F.col("old").alias("text")), F.struct(F.lit("new").alias("side"), F.col("new").alias("text")))).alias("x"))
    split = clauses(sides.select(F.struct("pair_id", "x.side").alias("id"), F.coalesce("x.text", F.lit("")).alias("text")))
    listed = split.groupBy(F.col("id.pair_id").alias("pair_id")).agg(*[F.sort_array(F.collect_list(F.when(F.col("id.side") == s, F.struct("pos", "label", "text")))).alias(s) for s in ("old", "new")])

    def run(frames):
        for pdf in frames:
            out = []
            for pair, old, new in pdf[["pair_id", "old", "new"]].itertuples(index=False):
                a, b = [(c["label"], c["text"]) for c in old], [(c["label"], c["text"]) for c in new]
                for k, (change, x, y) in enumerate(align(a, b)):
                    out.append((pair, k, change, a[x][1] if x is not None else None, b[y][1] if y is not None else None))
            yield pd.DataFrame(out, columns=["pair_id", "row", "change", "old_text", "new_text"])

    return listed.mapInPandas(run, f"pair_id {pairs.schema['pair_id'].dataType.simpleString()}, row int, change string, old_text string, new_text string")


def char_segments(old: str, new: str, least: int = 2) -> list[tuple[str, str]]:
    """(change, characters) of two texts; short common runs between changes count as changed."""
    if len(old) > LONGEST_CHARS or len(new) > LONGEST_CHARS:
        return [s for s in (("removed", old), ("added", new)) if s[1]] if old != new else [("same", old)]
    out: list[list[str]] = []
    i = j = 0

    def put(change: str, text: str) -> None:
        if text:
            if out and out[-1][0] == change:
                out[-1][1] += text
            else:
                out.append([change, text])

    pairs, kept = common_pairs(list(old), list(new)), []
    runs: list[list[tuple[int, int]]] = []
    for p in pairs:
        if runs and p == (runs[-1][-1][0] + 1, runs[-1][-1][1] + 1):
            runs[-1].append(p)
        else:
            runs.append([p])
    for k, run in enumerate(runs):
        if len(run) >= least or (k == 0 and run[0] == (0, 0)) or (k == len(runs) - 1 and run[-1] == (len(old) - 1, len(new) - 1)):
            kept += run
    for a, b in [*kept, (len(old), len(new))]:
        put("removed", old[i:a])
        put("added", new[j:b])
        put("same", old[a : a + 1])
        i, j = a + 1, b + 1
    return [tuple(s) for s in out]


def dice(pairs: DataFrame) -> DataFrame:
    """(pair_id, dice) of pairs (pair_id, old, new): Dice of the multisets of two-character pieces, white space aside."""
    flat = pairs.select("pair_id", *[F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "").alias(c) for c in ("old", "new")])

    def grams(side: str) -> DataFrame:
        at = F.explode(F.sequence(F.lit(1), F.length(side) - 1))
        long = flat.where(F.length(side) >= 2).select("pair_id", side, at.alias("k"))
        return long.groupBy("pair_id", F.substr(side, F.col("k"), F.lit(2)).alias("gram")).agg(F.count("*").alias(f"n_{side}"))

    shared = grams("old").join(grams("new"), ["pair_id", "gram"]).groupBy("pair_id").agg(F.sum(F.least("n_old", "n_new")).alias("shared"))
    total = F.greatest(F.length("old") - 1, F.lit(0)) + F.greatest(F.length("new") - 1, F.lit(0))
    value = F.when(F.col("old") == F.col("new"), 1.0).when(total == 0, 0.0).otherwise(2 * F.coalesce("shared", F.lit(0)) / total)
    return flat.join(shared, "pair_id", "left").select("pair_id", value.alias("dice"))


def comparability(has_old: Column, has_new: Column, old_draft: Column, new_draft: Column) -> Column:
    return F.when(~has_old | ~has_new, "missing").when(old_draft & new_draft, "comparable").when(old_draft | new_draft, "one side").otherwise("no drafts")
