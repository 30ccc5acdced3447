"""Documents and state that come out of the notices, and the full rule tables (M18-M28, F18-F20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rulebook
from ..operators import matching, merge as g, sinks
from .join_queries import _ACTIVE, _MATCH, _active
from .registry import query
from .views import TODAY

SITE, BUILT = "https://notices.example.org/", "Mon, 01 Jun 1998 00:00:00 GMT"
_URL = "'https://notices.example.org/notices/' || id"
_XML = lambda e: f"replace(replace(replace(replace(replace({e}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_ITEM = f"""'    <item>' || chr(10) || '      <title>' || {_XML('title')} || '</title>' || chr(10) || '      <link>' || {_URL} || '</link>' || chr(10) || '      <guid isPermaLink="false">' || id || '</guid>' || chr(10)
 || '      <pubDate>' || strftime(published, '%a, %d %b %Y') || ' 00:00:00 GMT</pubDate>' || chr(10) || '      <description>' || {_XML("concat_ws('; ', 'By ' || agency, 'Until ' || deadline::varchar, 'Summary: ' || summary, 'Source: ' || " + _URL + ")")} || '</description>' || chr(10) || '    </item>'"""
_NEWEST = f"select row_number() over (order by published desc, id) as place, id, {_ITEM} as item from notices order by published desc, id limit 200"


@query("m18_feed_items", _NEWEST)
def _(t):
    return sinks.feed_items(t.notices, SITE)


@query(
    "m18_feed",
    f"""with newest as ({_NEWEST})
 select '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom">' || chr(10) || '  <channel>' || chr(10) || '    <title>Notices &amp; drafts: agency &lt;A&gt;</title>' || chr(10)
 || '    <link>https://notices.example.org/</link>' || chr(10) || '    <description>What is new (agency &lt;A&gt;)</description>' || chr(10) || '    <language>zh-cn</language>' || chr(10) || '    <lastBuildDate>{BUILT}</lastBuildDate>' || chr(10) || '    <atom:link href="https://notices.example.org/feed.xml?agency=A&amp;p=1" rel="self" type="application/rss+xml" />' || chr(10) || string_agg(item, chr(10) order by place) || chr(10) || '  </channel>' || chr(10) || '</rss>' || chr(10) as xml from newest""",
)
def _(t):
    return sinks.feed(t.notices, SITE, "Notices & drafts", "What is new", BUILT, label="agency <A>", own="https://notices.example.org/feed.xml?agency=A&p=1")


@query("m19_sitemap", f"select {_URL} as url, coalesce(published::varchar, fetched_at::varchar) as last_modified, 'weekly' as change, 0.7::double as priority from notices union all values ('https://notices.example.org/', null, 'daily', 1.0::double), ('https://notices.example.org/stats', null, 'daily', 0.5::double)")
def _(t):
    return sinks.sitemap(t.notices, SITE)


_QUOTED = lambda e: f"replace(to_json({e})::varchar, '<', '\\u003c')"


@query(
    "m20_linked_data",
    f"""select id, '{{"@context":"https://schema.org","@type":"Article","headline":' || {_QUOTED('title')} || ',"url":"' || {_URL} || '","creativeWorkStatus":"' || status || '","publisher":{{"@type":"Organization","name":"Notices"}},"datePublished":"' || published || '"'
 || coalesce(',"author":{{"@type":"Organization","name":' || {_QUOTED('agency')} || '}}', '') || coalesce(',"expires":"' || deadline || '"', '') || ',"keywords":' || {_QUOTED("array_to_string(tags, ',')")}
 || coalesce(',"additionalProperty":[{{"@type":"PropertyValue","name":"deadline","value":"' || deadline || '"}}]', '') || '}}' as document from notices""",
)
def _(t):
    return sinks.linked_data(t.notices, SITE, "Notices")


@query(
    "m20_linked_list",
    f"""select '{{"@context":"https://schema.org","@type":"ItemList","numberOfItems":' || (select count(*) from orders) || ',"itemListElement":[' || string_agg('{{"@type":"ListItem","position":' || (place + 40) || ',"url":"' || {_URL} || '","name":' || {_QUOTED('title')} || '}}', ',' order by place) || ']}}' as document
 from (select place, id, title from (select row_number() over (order by published desc, id) as place, id, title from (select id, title, published from notices order by published desc, id limit 20 offset 40)))""",
)
def _(t):
    from pyspark.sql import Window

    page = t.notices.orderBy(F.desc("published"), "id").offset(40).limit(20)
    placed = page.select(F.row_number().over(Window.orderBy(F.desc("published"), "id")).alias("place"), "id", "title")  # of one page
    return sinks.linked_list(placed.join(t.orders.agg(F.count("*").alias("total"))), SITE, F.col("total"), 41)


@query(
    "m21_digests",
    f"""with due as (select s.id as subscription_id, n.id, n.title, n.deadline, n.deadline - date '{TODAY}' as days from subscriptions s join notices n on {_MATCH} where {_ACTIVE} and n.deadline between date '{TODAY}' and date '{TODAY}' + 15),
 r as (select *, row_number() over (partition by subscription_id order by days, id) as rank, count(*) over (partition by subscription_id) as n_all from due),
 m as (select subscription_id, count(*) as n, greatest(max(n_all) - 20, 0) as overflow, min_by(title, rank) as first_title, min(days) as first_days, string_agg('- ' || title || ' (' || deadline || ')', chr(10) order by rank) as lines from r where rank <= 20 group by 1)
 select subscription_id, n, overflow, case when n = 1 then 'Closing soon: ' || first_title else 'Closing soon: ' || n || ' notices, the first in ' || first_days || ' days' end as subject,
 lines || case when overflow > 0 then chr(10) || overflow || ' more in the next mail' else '' end as body from m""",
)
def _(t):
    today = F.lit(TODAY).cast("date")
    near = t.notices.where(F.col("deadline").between(today, F.date_add(today, 15)))
    near = near.withColumn("days", F.datediff("deadline", today))
    due = matching.first_matches(_active(t), near, sinks.MAIL_ITEMS, "days", "id")
    totals = matching.match_counts(_active(t), near, total=F.lit(True))
    return sinks.digests(due.select("subscription_id", "id", "title", "deadline", "days"), "Closing soon", totals=totals)


@query(
    "m27_confirmations",
    """select id, 'Please confirm your subscription' as subject, 'You asked for ' || case when scope = 'all' then 'all notices' else coalesce(nullif(concat_ws('; ', case when len(categories) > 0 then 'tags: ' || array_to_string(categories, ', ') end,
 case when len(agencies) > 0 then 'agencies: ' || array_to_string(agencies, ', ') end, case when len(keywords) > 0 then 'words: ' || array_to_string(keywords, ', ') end, case when len(audiences) > 0 then 'audiences: ' || array_to_string(audiences, ', ') end), ''), 'nothing yet') end
 || chr(10) || 'https://notices.example.org/subscriptions/confirm/' || id as body from subscriptions where confirmed_at is null""",
)
def _(t):
    return sinks.confirmations(t.subscriptions, SITE)


@query("m27_failure_alerts", "select doc_id as source_id, 'Job failed: crawl' as subject, 'Source: ' || doc_id || chr(10) || 'Error: ' || case when text is null then 'no message' when length(text) > 600 then substr(text, 1, 600) || '…' else text end as body from documents")
def _(t):
    return sinks.failure_alerts(t.documents.select(F.col("doc_id").alias("source_id"), F.lit("crawl").alias("job"), F.col("text").alias("error")))


_LIVE = [("notices", "count(*)", "notices"), ("with summary", "count(summary)", "notices"), ("files", "count(*)", "files"), ("characters", "sum(chars)", "files"), ("subscriptions", "count(*)", "subscriptions"), ("sources", "count(distinct source_id)", "notices")]


@query("m23_backup_check", " union all ".join(f"select '{name}' as measure, (select {a} from {v})::bigint as live, (select {a} from {v}{lost})::bigint as restored, (select {a} from {v}) = (select {a} from {v}{lost}) as ok" for (name, a, v), lost in zip(_LIVE, ["", "", " where status <> 'blocked'", " where status <> 'blocked'", "", ""])))
def _(t):
    live = {"notices": t.notices, "files": t.files, "subscriptions": t.subscriptions}
    restored = live | {"files": t.files.where("status <> 'blocked'")}  # a restored copy that has lost files
    return g.backup_check(live, restored, {name: (view, F.expr(measure)) for name, measure, view in _LIVE})


_TITLES = ("关于数据出境安全管理办法（征求意见稿）的公告", "中华人民共和国公路法（修订草案）", "2024年度标准立项计划等 12 项", "拟表彰单位名单公示", "药品管理条例（修订草案征求意见稿）", "关于开展会议的通知", "民航货物运输指南", "车船税调整方案", "网络算法推荐技术标准")
_SQL_TITLE = "list_extract([" + ", ".join(f"'{x}'" for x in _TITLES) + "], (o_orderkey % 9)::int + 1)"


def _titled(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.get(F.array(*map(F.lit, _TITLES)), F.col("o_orderkey") % 9).alias("title"), F.col("o_custkey").alias("source"))


@query(
    "m24_reclassified",
    f"""with n as (select o_orderkey as id, {_SQL_TITLE} as title, case when o_orderkey % 4 = 0 then 'amendment' when o_orderkey % 4 = 1 then 'new_draft' end as genre, case when o_orderkey % 4 = 0 then 'attachment_text' when o_orderkey % 4 = 1 then 'title' end as grounds from orders),
 f as (select l_orderkey as id, max((l_linenumber = 5)::int) as compared, max((l_linenumber = 6)::int) as amends from lineitem group by 1),
 d as (select n.*, case when regexp_matches(title, '名单|表彰|表扬|通过审核|换届|备案公告|结果公示') then ['list_or_result', 'title'] when regexp_matches(title, '等\\s*\\d+\\s*[项个件]|立项') then ['package_plan', 'title'] when compared = 1 then ['amendment', 'attachment_names']
 when amends = 1 then ['amendment', 'attachment_text'] when regexp_matches(title, '修正|修订') then ['amendment', 'title'] when regexp_matches(title, '草案|征求意见稿|办法|规定|规范|指南|条例') then ['new_draft', 'title'] else ['unknown', 'none'] end as d from n left join f using (id)),
 r as (select *, list_position(['none', 'title', 'attachment_names', 'attachment_text'], d[2]) >= coalesce(list_position(['none', 'title', 'attachment_names', 'attachment_text'], grounds), 0) as better from d)
 select id, case when better then d[1] else genre end as genre, case when better then d[2] else grounds end as grounds, case when not better then 'kept' when genre is not distinct from d[1] then 'same' else 'changed' end as outcome from r""",
)
def _(t):
    key = F.col("id") % 4
    notices = _titled(t).select("id", "title", F.when(key == 0, "amendment").when(key == 1, "new_draft").alias("genre"), F.when(key == 0, "attachment_text").when(key == 1, "title").alias("grounds"))
    line = F.col("l_linenumber")
    files = t.lineitem.select(F.col("l_orderkey").alias("notice_id"), F.when(line == 5, "修订对照表.docx").otherwise("附件.docx").alias("name"), F.when(line == 6, "第三条修改为：……").otherwise("正文").alias("text"))
    return g.reclassified(notices, files)


@query("m25_sources", "with s as (select distinct 'S' || (o_custkey % 12) as id, (o_custkey % 12) % 5 <> 0 as enabled from orders) select id, enabled and id <> 'S3' as enabled from s union all select distinct 'S' || (s_suppkey % 20), true from supplier where 'S' || (s_suppkey % 20) not in (select id from s)")
def _(t):
    number = F.col("o_custkey") % 12
    state = t.orders.select(F.concat(F.lit("S"), number.cast("string")).alias("id"), (number % 5 != 0).alias("enabled")).distinct()
    more = g.registered(state, t.supplier.select(F.concat(F.lit("S"), (F.col("s_suppkey") % 20).cast("string")).alias("id")))
    return g.switched(more, t.spark.createDataFrame([("S3",), ("none",)], "id string"), "enabled", False)


@query("m26_flags", "select l_orderkey as id, l_linenumber as line, l_linenumber = 1 or l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT') as fed from lineitem")
def _(t):
    files = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") == 1).alias("fed"))
    return g.switched(files, t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id")), "fed", True)


@query(
    "m28_entries",
    """with e as (select o_orderkey, o_orderdate::date as p, o_orderdate::date + (o_orderkey % 60)::int - 5 as d from orders)
 select substr(sha256(case when o_orderkey % 5 = 1 then 'ftp://x/' || o_orderkey else 'https://x.example/' || o_orderkey end), 1, 16) as id, case when o_orderkey % 7 = 0 then '' else 'Entry ' || o_orderkey end as title, p::varchar as published, d::varchar as deadline,
 case when o_orderkey % 7 = 0 then 'title' when o_orderkey % 5 = 1 then 'url' when d < p then 'order' end as problem from e""",
    dates="published deadline",
)
def _(t):
    key = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    entries = t.orders.select(
        F.when(key % 7 == 0, "  ").otherwise(F.concat(F.lit(" Entry \n"), key.cast("string"))).alias("title"),
        F.concat(F.when(key % 5 == 1, "ftp://x/").otherwise(" https://x.example/"), key.cast("string")).alias("url"),
        F.date_format(day, "yyyy'年'M'月'd'日'").alias("published"),
        F.date_format(F.date_add(day, (key % 60).cast("int") - 5), "yyyy-MM-dd").alias("deadline"),
    )
    return g.entries_by_hand(entries).select("id", "title", "published", "deadline", "problem")


# What the titles and bodies below say, read by hand.
_TITLE_TAGS = (("数据与网络安全",), ("立法与司法", "交通运输"), (), (), ("立法与司法", "医疗卫生"), (), ("交通运输",), (), ("数据与网络安全",))
_BODIES = (None, "征求意见单位：\n5.国家能源局综合司\n9.中国电力企业联合会\n地址：北京市海淀区永丰产业基地", "建设法律数据库", "征求工业和信息化部意见", "1.加强源头防控，推进能源结构调整\n2.推进煤炭清洁利用", "处理个人信息", "附件：9.《固体废物 石油烃的测定》编制说明")
_BODY_TAGS = ((), (), (), (), ("经济与产业",), ("数据与网络安全",), ("经济与产业", "生态环境"))


@query(
    "f18_domains",
    "select o_orderkey as id, list_filter(["
    + ", ".join(f"case when (o_orderkey % 9) in ({', '.join(str(k) for k, tags in enumerate(_TITLE_TAGS) if d in tags) or -1}) or (o_orderkey % 7) in ({', '.join(str(k) for k, tags in enumerate(_BODY_TAGS) if d in tags) or -1}) then '{d}' end" for d in ("立法与司法", "经济与产业", "医疗卫生", "生态环境", "交通运输", "市场监管", "数据与网络安全"))
    + "], lambda x: x is not null) as tags from orders",
)
def _(t):
    body = F.get(F.array(*map(F.lit, _BODIES)), (F.col("id") % 7).cast("int"))
    return _titled(t).select("id", rulebook.domain_tags(F.col("title"), body).alias("tags"))


@query(
    "f20_audiences",
    """select o_orderkey as id, case when o_custkey = 7 then ['public', 'source'] else list_extract([['sector', 'administration:管理办法'], ['public', 'law:中华人民共和国公路法（修订草案'], ['sector', 'technical:标准'], ['sector', 'list:表彰'],
 ['public', 'law:条例（修订草案征求意见稿'], ['unknown', 'none'], ['sector', 'field:民航'], ['public', 'tax:税'], ['sector', 'technical:标准']], (o_orderkey % 9)::int + 1) end as decision from orders""",
)
def _(t):
    d = rulebook.audience_decision(F.col("title"), F.col("source"), public_sources=(7,))
    return _titled(t).withColumn("d", d).select("id", F.array("d.audience", "d.grounds").alias("decision"))
