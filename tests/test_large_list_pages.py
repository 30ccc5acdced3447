"""List pages with many rows: a worker holds the open row, not the page's tree or all that was picked."""

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from vellum.sources import adapters as A

ROW = '<li><a href="/n/{0}.html">关于第{0}号办法的通知</a><span class="rightData">2024-03-05</span></li><li><a href="/">首页</a>'


def page(n):
    return '<nav><ul><li><a href="/about">关于</a></ul></nav><ul class="newsMsgList_zzy">' + "\n".join(ROW.format(k) for k in range(n)) + "</ul>"


def test_rows_are_told_as_they_close():
    html = page(20_000)
    tracemalloc.start()
    n = sum(1 for _ in A.rows_of(html, A.ADAPTERS["moj"].rows))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 40_000 and peak < 10e6


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_rows_are_those_of_the_whole_tree(monkeypatch, piece):
    monkeypatch.setattr(A, "PIECE", piece)
    bits = ["<li>", '<li class="x">', "</li>", "<ul>", '<ul class="x">', "</ul>", '<a href="/q">', "</a>", "text ", "a & b &amp; c &#65;", "&am", "<br>", "<br/>", "<p>", "</p>", '<div class="x">', "</div>", "<td>", "<tr class=x>", '<script>"<li>"</script>', "<!-- c ", "-->", "<", "< ", '<a href="', '">', "<table>", "</table>"]
    r = random.Random(1)
    for _ in range(400):
        html = "".join(r.choice(bits) for _ in range(r.randrange(30)))
        for selector in ("li", "li.x", "ul.x li", ".x", "div .x li", "tr.x"):
            told = lambda nodes: [(n.tag, n.attrs, n.text()) for n in nodes if n.tag not in A.VOID]
            assert told(A.rows_of(html, selector)) == told(A.select(A.tree(html), selector)), html


def test_many_rows_of_a_page(spark):
    pages = spark.createDataFrame([("moj", "http://s.cn/l", page(2500), 1), ("unknown", "http://s.cn/l", page(3), 2), ("moj", "http://s.cn/m", page(10), 3), ("moj", None, None, 4)], "source_id string, url string, html string, own int")
    df = A.list_rows(pages, keep=("own",))
    got = df.groupBy("own", "page_url").agg(F.count("*").alias("n"), F.max("pos").alias("last"), F.count_distinct("url").alias("urls")).collect()
    assert {tuple(x) for x in got} == {(1, "http://s.cn/l", 2500, 2499, 2500), (3, "http://s.cn/m", 10, 9, 10)}
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
