"""Excerpts, neighbourhoods and the table of changes against plainer versions of themselves."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import excerpts as E
from vellum.functions.positions import Places, around, neighborhood
from vellum.operators import change_table as C


def long_text(seed):
    r = random.Random(seed)
    words = ["适用于甲", "第一条 内容", "一般文字", "第二章 总则\n", "\n三、小节标题\n", "abc ", "。", "施工范围很大的一段普通文字，没有什么要点"]
    return "".join(r.choice(words) * r.randrange(1, 4) for _ in range(r.randrange(20, 160)))


def plain_excerpt(text, anchors, budget, reach):
    """Characters marked one by one, in the order in which they are taken."""
    if len(text) <= budget:
        return text
    lines = [x.strip()[:60] for x in text.split("\n") if E.HEADING.match(x.strip())][:12]
    share = min(900, budget // 8) if lines else 0
    room = budget - share - len(E.OUTLINE) - len(E.GAP)
    near = [False] * len(text)
    for a in anchors:
        at = -1
        for _ in range(3):
            at = text.find(a, at + 1 if at < 0 else at + len(a))
            if at < 0:
                break
            near[max(0, at - reach) : at + len(a) + reach] = [True] * len(near[max(0, at - reach) : at + len(a) + reach])
    runs = [(m.start(), m.end(), m[0][0] == "1") for m in re.finditer("1+|0+", "".join("01"[x] for x in near))]
    taken = []
    for wanted in (True, False):
        for a, b, is_near in runs:
            if is_near != wanted:
                continue
            left = room - sum(y - x for x, y in taken) - len(E.GAP) * len(taken)
            if left <= 0:
                break
            taken.append((a, min(b, a + left)))
            if taken[-1][1] < b:
                break
    out = E.GAP.join(text[a:b] for a, b in sorted(taken))
    return (out + (E.GAP + E.OUTLINE + "\n".join(lines)[:share] if lines else ""))[:budget]


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("budget, reach", [(120, 10), (300, 25), (700, 60)])
def test_excerpts(seed, budget, reach):
    text = long_text(seed)
    got = E.excerpt_of(text, budget=budget, reach=reach)
    assert got == plain_excerpt(text, E.ANCHORS, budget, reach) and len(got) <= budget


def test_excerpts_as_a_column(spark):
    texts = [long_text(1) * 3, "short", "", None]
    got = [r.e for r in spark.createDataFrame([(t,) for t in texts], "t string").select(E.excerpt(F.col("t"), budget=200).alias("e")).collect()]
    assert got == [E.excerpt_of(texts[0], budget=200), "short", "", None]


def test_neighbourhoods(spark):
    text = "前文 “若干  规定应当\n 公开” 后文，以及 另外一些文字"
    rows = [(text, "「若干规定 应当公开」", "前文 “若干  规定应当\n 公开” 后文"), (text, "…以及另外 一些文字…短", "”后文，以及 另外一些文字"), (text, "短", None), (text, None, None), (None, "若干规定应当公开", None), (text, "不在里面的一段文字", None)]
    got = [r[0] for r in spark.createDataFrame([r[:2] for r in rows], "t string, q string").select(neighborhood(F.col("t"), F.col("q"), 3)).collect()]
    assert got[0] == rows[0][2] and got[2:] == [None] * 4
    assert got[1] == around(text, rows[1][1], 3) and "另外一些文字" in got[1]
    for k in range(40):  # any stretch is found where its characters stand
        r = random.Random(k)
        body = "".join(r.choice('ab “”"\n　') for _ in range(60))
        a = r.randrange(0, 40)
        place = Places(body).find(body[a : a + 20])
        bare = "".join(body[a : a + 20].split()).translate(str.maketrans("“”", '""'))
        if len(bare.strip('"')) >= 8:
            found = "".join(body[place[0] : place[1]].split()).translate(str.maketrans("“”", '""'))
            assert found in (bare, bare.strip('"'))


TEXT = "八、对部分条文作以下修改：\n（一）将第五条中的\n“贫困地区”修改为\n“欠发达地区”。（二）删除第七条第二款；普通的一句。\n新增第九条：“甲乙丙丁戊己庚辛壬癸”"


def test_the_change_table(spark):
    quotes = ["中的 “贫困地区” 修改为“欠发达地区”", "新增第九条：「甲乙丙丁戊己庚辛壬癸」", "这一段引文不在文件里面", None, "（二）删除第七条第二款"]
    rows = list(C.table_rows(TEXT, quotes))
    assert [(r[0], r[1], r[2]) for r in rows] == [(0, "described", 0), (1, "described", 4), (2, "described", 1), (3, "described", 2), (4, "described", 3)]
    facts = list(C.table_rows(TEXT, []))
    assert [(r[1], r[3], r[4], r[5]) for r in facts] == [("fact", "", ["modified"], ["修改"]), ("fact", "第七条第二款", ["removed"], ["删除"]), ("fact", "第九条", ["added"], ["新增"])]
    table = spark.createDataFrame([(1, TEXT, quotes), (2, TEXT, None), (3, None, quotes), (4, "没有改动", quotes)], "id long, text string, quotes array<string>")
    got = sorted((r.id, r.pos, r.type, r.change) for r in C.change_table(table).collect())
    assert got == [(1, *r[:3]) for r in rows] + [(2, *r[:3]) for r in facts]


def plain_owner(text, quote):
    """The sentence of a quotation, by comparing characters one by one."""
    spans, start = [], 0
    for k, c in enumerate(text):
        if c in "。；！？\n":
            spans.append((start, k + 1))
            start = k + 1
    spans += [(start, len(text))] if start < len(text) else []
    marked = [any(p.search(text[a:b]) for _, p in C._MARKS) for a, b in spans]
    touched = set()
    for segment in re.split("…+", quote):
        bare = "".join(segment.split())
        if len(bare) < 8:
            continue
        for s in range(len(text)):
            k, n = s, 0
            while n < len(bare) and k < len(text) and (text[k].isspace() and k > s or text[k] == bare[n]):
                n += not text[k].isspace()
                k += 1
            if n == len(bare):
                touched |= {i for i, (a, b) in enumerate(spans) if a < k and b > s}
                break
    own = [i for i in sorted(touched) if marked[i]] or sorted(touched)
    return own[0] if own else None, spans


@pytest.mark.parametrize("seed", range(25))
def test_quotations_find_their_sentence(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["删除了某项条文", "普通文字若干个", "。", "\n", "；", " ", "修改为另一段话"]) for _ in range(30))
    a = r.randrange(len(text) - 15)
    quote = text[a : a + r.randrange(9, 24)].replace("\n", " ") + r.choice(["", "…" + text[-12:]])
    owner, spans = plain_owner(text, quote)
    rows = [x for x in C.table_rows(text, [quote]) if x[1] == "described"]
    if not any(p.search(text) for _, p in C._MARKS):
        assert rows == []
    else:
        wanted = text[slice(*spans[owner])].strip() if owner is not None else None
        has = wanted is not None and any(p.search(wanted) for _, p in C._MARKS)
        assert [x[6] for x in rows] == [wanted if has else None]
