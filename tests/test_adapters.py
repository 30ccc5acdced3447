"""Pages through their sources' adapters, by column functions and as a data source."""

import datetime

import pytest

from vellum.sources import adapters as A

DAY = datetime.date
LISTS = {
    "cac": '<div id="loadingInfoPage"><ul><li><a href="a.htm" title="关于《数据办法》公开征求意见的通知[已结束]">关于《数据…</a><span class="times">2024-03-05</span><li><a href="b.htm">一般的通知公告</a></ul></div>',
    "mee": '<ul><li><a href="../x/a.html">关于某标准的意见函</a><span class="date">2024年3月5日</span></li><li><a href="/nav">没有日期的导航</a></li></ul>',
    "miit": '<li class="cf"><a href="/a.html" title="关于公开征求某目录意见的公示">关于公开征求...</a><span class="fr">2024/3/5</span><span class="endtime">1792252800000</span></li><li class="empty"><a href="/b">空的列表条目</a></li>',
    "moe": '<div id="list"><li><a href="a.html">[进行中] 教育部办公厅关于《办法》的通知</a><span>2024.3.5</span><li><a href="a.html">[进行中] 又是同一个地址</a><span>2024.3.6</span></div>',
    "mohurd": '<ul><li class="long-deta other"><a href="/a"><span class="title-info">关于国家标准的通知</span></a><span class="date-info">截止日期 2024-10-18</span></li></ul>',
    "moj": '<ul class="newsMsgList_zzy"><li><a href="/a.html">司法部、财政部关于《条例》的通知</a><span class="rightData">2024-03-05</span></li><li><a>没有地址的条目</a></li></ul>',
    "mot": '<ul class="news-list"><li class="news-item"><a class="news-link" href="/a"><b class="news-title">[已结束]关于某办法的公告</b><i class="news-date">2024-02-30</i></a></li></ul>',
    "samr": '<li class="zjnav04Left02_content">表头</li><li class="zjnav04Left02_content"><p class="doctitle"><a href="/a">关于某规定的公告</a></p><p class="doctime">2024-03-05 至 2024-04-06</p><p class="docstatus">（征集中）</p></li>',
}
ROWS = {
    "cac": [("关于《数据办法》公开征求意见的通知", "http://s.cn/l/a.htm", "国家互联网信息办公室", DAY(2024, 3, 5), None, "closed")],
    "mee": [("关于某标准的意见函", "http://s.cn/x/a.html", "生态环境部办公厅", DAY(2024, 3, 5), None, None)],
    "miit": [("关于公开征求某目录意见的公示", "http://s.cn/a.html", "工业和信息化部", DAY(2024, 3, 5), DAY(2026, 10, 17), None)],
    "moe": [("教育部办公厅关于《办法》的通知", "http://s.cn/l/a.html", "教育部办公厅", DAY(2024, 3, 5), None, "open")],
    "mohurd": [("关于国家标准的通知", "http://s.cn/a", "住房城乡建设部", None, DAY(2024, 10, 18), None)],
    "moj": [("司法部、财政部关于《条例》的通知", "http://s.cn/a.html", "司法部、财政部", DAY(2024, 3, 5), None, None)],
    "mot": [("关于某办法的公告", "http://s.cn/a", "交通运输部", None, None, "closed")],
    "samr": [("关于某规定的公告", "http://s.cn/a", "市场监管总局", DAY(2024, 3, 5), DAY(2024, 4, 6), "open")],
}
DETAILS = {
    "mee": '<h1> 部令 </h1><p class="xqLyPc">2024-03-05 来源</p><div class="content_body"><p>征求意见时间为2024年3月20日至2024年4月19日。</p>文<a href="/f.pdf"></a></div>',
    "mohurd": '<meta name="PubDate" content="2024-03-05 08:00"><div class="editor-content">只有文字 <b>没有块</b></div><div class="editorContent-download"><a href="/document/download?id=1">附件1</a></div>',
    "cac": "<h1>没有要的东西</h1>",
}


def pages(spark, named):
    return spark.createDataFrame([(s, "http://s.cn/l/index.html", h) for s, h in named.items()], "source_id string, url string, html string")


@pytest.fixture(scope="module")
def listed(spark):
    extra = {"unknown": LISTS["moj"], "npc": None}
    return {s: [tuple(r)[3:] for r in rows] for s, rows in _by_source(A.list_rows(pages(spark, LISTS | extra))).items()}


def _by_source(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r[2] if isinstance(r[2], int) else 0):
        out.setdefault(r.source_id, []).append(r)
    return out


@pytest.mark.parametrize("source", sorted(ROWS))
def test_list_rows(listed, source):
    assert listed[source] == ROWS[source]


def test_pages_of_no_known_source_give_nothing(listed):
    assert set(listed) == set(ROWS)


def test_details(spark):
    got = {r.source_id: r for r in A.details(pages(spark, DETAILS)).collect()}
    mee, mohurd, cac = got["mee"], got["mohurd"], got["cac"]
    assert (mee.title, mee.published, mee.deadline, mee.body) == ("部令", DAY(2024, 3, 5), DAY(2024, 4, 19), "征求意见时间为2024年3月20日至2024年4月19日。")
    assert [tuple(f) for f in mee.files] == [("f.pdf", "http://s.cn/f.pdf")]
    assert (mohurd.title, mohurd.published, mohurd.body) == (None, DAY(2024, 3, 5), "只有文字 没有块") and [tuple(f) for f in mohurd.files] == [("附件1", "http://s.cn/document/download?id=1")]
    assert tuple(cac)[2:] == (None,) * 6


def test_details_stand_in_for_what_the_list_gave(spark):
    rows = spark.createDataFrame([("u1", "短标题", None, DAY(2024, 1, 1), DAY(2024, 2, 2)), ("u2", "另一个", "部", None, None)], "url string, title string, agency string, published date, deadline date")
    found = spark.createDataFrame([("u1", "完整的标题", "厅", None, DAY(2024, 3, 3), "正文", None)], "url string, title string, agency string, published date, deadline date, body string, files array<struct<name:string,url:string>>")
    got = sorted(tuple(r) for r in A.with_details(rows, found).collect())
    assert got == [("u1", "完整的标题", "厅", DAY(2024, 1, 1), DAY(2024, 3, 3), "正文", None), ("u2", "另一个", "部", None, None, None, None)]


@pytest.mark.parametrize("part, fn", [("list", A.list_rows), ("details", A.details)])
def test_the_data_source_reads_the_same(spark, tmp_path, part, fn):
    stored = pages(spark, LISTS | DETAILS).unionByName(pages(spark, {"mee": LISTS["mee"], "unknown": LISTS["mee"]})).repartition(3)
    stored.write.parquet(str(tmp_path / "pages"))
    key = lambda df: sorted(map(repr, df.collect()))
    got = A.read_pages(spark, str(tmp_path / "pages"), part)
    assert key(got) == key(fn(stored.where("source_id <> 'unknown'"))) and got.count() > 0
    assert {r.source_id for r in A.read_pages(spark, str(tmp_path / "pages"), part, ("mee", "mot")).collect()} <= {"mee", "mot"}
    assert spark.read.format("notice_pages").option("path", str(tmp_path / "pages")).load().rdd.getNumPartitions() == 3


def test_selectors():
    root = A.tree('<div id=a class="x y"><p class=x>1<p>2<ul><li>3<li class="y z">4</ul></div><p data-k="v">5')
    texts = lambda s: [n.text() for n in A.select(root, s)]
    assert texts("p") == ["1", "2", "5"] and texts("#a .x") == ["1"] and texts("div.x.y li.y") == ["4"] and texts('p[data-k="v"]') == ["5"] and texts("ul div li") == [] and texts("li") == ["3", "4"]
