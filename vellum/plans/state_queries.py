"""Merges, streams and sources (M, X, S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as g
from ..sources import files as src, html
from .registry import query
from .views import NOW


def _stored(t):
    return t.orders.where("o_orderkey % 4 <> 0").select("o_orderkey", "o_custkey", "o_orderstatus", F.lit(7).cast("long").alias("clicks"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("old note")).alias("note"))


def _incoming(t):
    rows = t.orders.where("o_orderkey % 3 = 0")
    return rows.select("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), F.lit("N").alias("o_orderstatus"), F.lit(0).cast("long").alias("clicks"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("new note")).alias("note"))


_UPSERT = """select o_orderkey, case when o_orderkey % 3 = 0 then o_custkey + 1 else o_custkey end as o_custkey, case when o_orderkey % 3 = 0 then 'N' else o_orderstatus end as o_orderstatus,
 case when o_orderkey % 4 <> 0 then 7 else 0 end as clicks,
 coalesce(case when o_orderkey % 3 = 0 and o_orderkey % 2 = 0 then 'new note' end, case when o_orderkey % 4 <> 0 and o_orderkey % 5 = 0 then 'old note' end) as note,
 case when o_orderkey % 3 = 0 and o_orderkey % 4 <> 0 then 'updated' when o_orderkey % 3 = 0 then 'inserted' else 'unchanged' end as outcome
 from orders where o_orderkey % 4 <> 0 or o_orderkey % 3 = 0"""


@query("m01_upsert", _UPSERT)
def _(t):
    return g.upserted(_stored(t), _incoming(t), "o_orderkey", kept=("clicks",), filled=("note",))


@query(
    "m02_evidence",
    """with p as (select o_orderkey, list_extract(['attachment_text', 'none', 'title', 'attachment_names'], (o_orderkey % 4)::int + 1) as new, list_extract(['attachment_names', 'title', 'attachment_text', 'none', null], (o_orderkey // 7 % 5)::int + 1) as old from orders)
 select o_orderkey, case when old is null or (new, old) in (('none', 'none'), ('title', 'none'), ('title', 'title'), ('attachment_names', 'none'), ('attachment_names', 'title'), ('attachment_names', 'attachment_names'), ('attachment_text', 'none'), ('attachment_text', 'title'), ('attachment_text', 'attachment_names'), ('attachment_text', 'attachment_text')) then 'new' else 'old' end as genre from p""",
)
def _(t):
    key = F.col("o_orderkey")
    pick = lambda k, names: F.get(F.array(*map(F.lit, names)), k.cast("int"))
    new, old = pick(key % 4, ("attachment_text", "none", "title", "attachment_names")), pick(F.floor(key / 7) % 5, ("attachment_names", "title", "attachment_text", "none", None))
    return t.orders.select("o_orderkey", F.when(g.wins(new, old), "new").otherwise("old").alias("genre"))


@query("m03_m04_overlay", "select c_custkey, coalesce(case when c_custkey % 2 = 0 then 'DETAIL' end, c_mktsegment) as c_mktsegment, c_name from customer")
def _(t):
    detail = t.customer.where("c_custkey % 3 <> 5").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lit("DETAIL")).alias("c_mktsegment"))
    return g.overlaid(t.customer.select("c_custkey", "c_mktsegment", "c_name"), detail, "c_custkey", ("c_mktsegment",))


@query("m05_counters", "select notice_id, day, count(*) + case when notice_id % 2 = 0 then 10 else 0 end as n from clicks group by 1, 2", dates="day")
def _(t):
    totals = t.clicks.where("notice_id % 2 = 0").select("notice_id", "day").distinct().withColumn("n", F.lit(10).cast("long"))
    return g.counted(totals, t.clicks, ["notice_id", "day"])


@query("m06_insert_or_ignore", "select distinct l_orderkey, l_suppkey from lineitem")
def _(t):
    pairs = t.lineitem.select("l_orderkey", "l_suppkey")
    return g.appended(pairs.where("l_orderkey % 2 = 0").distinct(), pairs, ["l_orderkey", "l_suppkey"])


@query(
    "m07_manifest",
    """select notice_id, url, min(name) as name, case when notice_id % 2 = 0 then min(status) else 'pending' end as status, case when notice_id % 2 = 0 then 'refreshed' else 'inserted' end as outcome from files where notice_id % 5 <> 0 group by 1, 2
 union all select notice_id, url, min(name), min(status), 'untouched' from files where notice_id % 5 = 0 and notice_id % 2 = 0 group by 1, 2""",
)
def _(t):
    one = t.files.groupBy("notice_id", "url").agg(F.min("name").alias("name"), F.min("status").alias("status"), F.min("attempts").alias("attempts"))
    state = one.where("notice_id % 2 = 0").withColumn("last_seen", F.lit("1998-01-01"))
    vanished = state.select("notice_id", F.concat("url", F.lit("?gone")).alias("url"), "name", "status", "attempts", "last_seen").where("notice_id % 5 <> 0")
    manifest = t.files.where("notice_id % 5 <> 0").select("notice_id", "url", "name")
    blank = manifest.select("notice_id", F.lit(" ").alias("url"), "name")
    return g.synced_manifest(state.unionByName(vanished), manifest.unionByName(blank), NOW).select("notice_id", "url", "name", "status", "outcome")


@query(
    "m08_m09_patch",
    """select notice_id, url, case when st = 'ok' then 'ok' when notice_id % 2 = 0 then 'error' else st end as status, attempts + case when notice_id % 2 = 0 then 1 else 0 end as attempts, case when st = 'ok' and notice_id % 2 = 0 then 'kept; refresh gave error' end as note
 from (select notice_id, url, min(status) as st, min(attempts) as attempts from files group by 1, 2)""",
)
def _(t):
    one = t.files.groupBy("notice_id", "url").agg(F.min("status").alias("status"), F.min("attempts").alias("attempts"))
    state = one.withColumn("text", F.when(F.col("status") == "ok", F.lit("body"))).withColumn("fetched_at", F.lit("1998-01-01"))
    results = one.where("notice_id % 2 = 0").select("notice_id", "url", F.lit("error").alias("status"), F.lit(None).cast("string").alias("text"), F.lit(NOW).alias("fetched_at"))
    return g.patched(state, results).select("notice_id", "url", "status", "attempts", "note")


@query("m10_hash_cache", "select doc_id, not exists (select 1 from documents e where e.text = d.text and e.source = 'src0') as parse from documents d")
def _(t):
    cache = t.documents.where("source = 'src0'").select(F.sha2("text", 256).alias("sha256"), "text")
    files = t.documents.select("doc_id", F.col("text").cast("binary").alias("content"))
    return g.reused_texts(files, cache).select("doc_id", "parse")


@query("m11_subscription_outcomes", "select id, case when id % 2 = 1 then 'created' when unsubscribed_at is not null then 'resubscribed' when confirmed_at is not null then 'confirmed_pending' else 'pending_refreshed' end as outcome from subscriptions")
def _(t):
    return t.subscriptions.select("id", g.subscription_outcome(F.col("id") % 2 == 0, F.col("confirmed_at").isNotNull(), F.col("unsubscribed_at").isNotNull()).alias("outcome"))


@query("m15_backfill", "select audience as old, case when o_p = '3' then null else 'x' end as new, count(*) as n, audience is distinct from case when o_p = '3' then null else 'x' end as changed from (select audience, substr(title, 7, 1) as o_p from notices) group by 1, 2")
def _(t):
    computed = F.when(F.substring("title", 7, 1) == "3", F.lit(None).cast("string")).otherwise("x")
    return g.backfill_report(t.notices, F.col("audience"), computed)


@query("m16_guarded_delete", "select s_suppkey from supplier where not (s_acctbal < 0) or s_suppkey in (select l_suppkey from lineitem where l_returnflag = 'R' and l_quantity > 49)")
def _(t):
    children = t.lineitem.where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return g.guarded_delete(t.supplier, F.col("s_acctbal") < 0, children, "s_suppkey")[0].select("s_suppkey")


@query("m17_seeded", "select c_custkey, case when c_acctbal < 0 then 1 else 0 end as failures from customer")
def _(t):
    from ..functions.rules import seeded_failures

    return t.customer.select("c_custkey", seeded_failures(F.col("c_acctbal") < 0).alias("failures"))


@query("x06_once_per_day", "select distinct user_id, (ts + interval 8 hour)::date as day from events where event_type = 'error'", dates="day")
def _(t):
    from ..functions.dates import site_day

    return t.events.where("event_type = 'error'").select("user_id", site_day(F.col("ts").cast("timestamp")).alias("day")).dropDuplicates()


@query("x10_backoff", "select event_id, case when event_id % 7 < 5 then 2 * power(2, event_id % 7)::bigint else 60 end as wait from events")
def _(t):
    from ..functions.rules import backoff

    return t.events.select("event_id", backoff(F.col("event_id") % 7).alias("wait"))


def _as_text(windows):
    return windows.withColumns({c: F.col(c).cast("string") for c in ("start", "end")})


def _streamed(build, complete: bool = False):
    from ..sources.paths import shared_folder
    from ..streaming import jobs

    def run(t):
        stream = build(jobs, jobs.events_stream(t.spark, f"{t.folder}/events.parquet*"))
        return (jobs.drained_complete if complete else jobs.drained)(stream, shared_folder(t.spark, "stream"))

    return run


query("x14_stream_daily_clicks", "select (ts + interval 8 hour)::date as day, event_type, count(*) as n from events group by 1, 2", dates="day")(_streamed(lambda jobs, e: jobs.daily_counts(e, "event_type"), complete=True))
query("x04_stream_once_per_key", "select user_id, event_type from events group by 1, 2")(_streamed(lambda jobs, e: jobs.once_per_key(e, ["user_id", "event_type"], "60 days").select("user_id", "event_type")))
query(
    "x_sliding_counts",
    "select * replace (start::varchar as start, \"end\"::varchar as \"end\") from (select time_bucket(interval 15 minute, ts) - to_minutes(15 * k::int) as start, time_bucket(interval 15 minute, ts) - to_minutes(15 * k::int) + interval 1 hour as \"end\", event_type, count(*) as n from events, range(0, 4) r(k) group by all)",
)(_streamed(lambda jobs, e: _as_text(jobs.sliding_counts(e, "event_type")), complete=True))
query(
    "x_session_counts",
    "with b as (select *, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as opens from events window w as (partition by user_id order by ts)), s as (select *, sum(opens) over (partition by user_id order by ts rows unbounded preceding) as k from b) select min(ts)::varchar as start, (max(ts) + interval 30 minute)::varchar as \"end\", user_id, count(*) as n from s group by user_id, k",
)(_streamed(lambda jobs, e: _as_text(jobs.session_counts(e, "user_id")), complete=True))


@query(
    "x12_stream_limiter",
    """with recursive e as (select *, row_number() over (partition by source_id order by "at", seq) as rn from run_log),
 r as (select source_id, "at", seq, rn, "at" as opened, 1 as n from e where rn = 1 union all
 select e.source_id, e."at", e.seq, e.rn, case when e."at" - r.opened >= interval 6 hour then e."at" else r.opened end, case when e."at" - r.opened >= interval 6 hour then 1 else r.n + 1 end
 from r join e on e.source_id = r.source_id and e.rn = r.rn + 1)
 select source_id as client, seq, n <= 3 as passed, case when n <= 3 then 0 else ceil((epoch_us(opened + interval 6 hour) - epoch_us("at")) / 1000)::bigint end as retry_ms from r""",
)
def _(t):
    """The log comes as files of successive spans of time, a micro-batch each."""
    from ..session import SETTINGS
    from ..sources.paths import shared_folder
    from ..streaming import limiter
    from ..streaming.jobs import drained

    folder, log = shared_folder(t.spark, "hits"), t.run_log.select("source_id", "seq", "at")
    first, last = log.agg(F.min("at"), F.max("at")).first()
    cuts = [first + (last - first) * k / 4 for k in range(1, 4)]
    for low, high in zip([None, *cuts], [*cuts, None]):
        span = log.where(F.lit(True) if low is None else F.col("at") >= F.lit(low)).where(F.lit(True) if high is None else F.col("at") < F.lit(high))
        span.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", SETTINGS["spark.sql.streaming.stateStore.providerClass"])
    hits = t.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return drained(limiter.limited(hits, "source_id", 6 * 3600.0, 3), folder).select("client", "seq", "passed", "retry_ms")


@query("s02_json_rows", "select event_id, k from (select event_id, unnest([(props->>'k')::bigint, event_id]) as k from events)")
def _(t):
    answers = t.events.select("event_id", F.concat(F.lit('{"data":{"rows":['), "props", F.lit(',{"k":'), F.col("event_id").cast("string"), F.lit("}]}}")).alias("answer"))
    return src.json_rows(answers, "answer", "data.rows", "struct<k:long>").select("event_id", "row.k")


@query("s03_envelope", "select page_id, length(html) as n_chars from pages")
def _(t):
    envelope = F.to_json(F.struct(F.struct("html").alias("data")))
    return t.pages.select("page_id", F.length(src.fragment(envelope)).alias("n_chars"))


@query(
    "s04_list_rows",
    r"""with a as (select page_id, regexp_extract(url, '^(https?://[^/]+)', 1) as site, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) as href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) as label, unnest(range(1000))::int as n from pages),
 u as (select page_id, n, label, site || href as url from a where href is not null),
 f as (select *, row_number() over (partition by page_id, url order by n) as k from u)
 select page_id, (row_number() over (partition by page_id order by n) - 1)::int as pos, coalesce(nullif(trim(regexp_replace(label, '\s+', ' ', 'g')), ''), regexp_extract(url, '[^/]*$')) as title, url from f where k = 1""",
)
def _(t):
    return html.list_rows(t.pages)


@query("s05_details")
def _(t):
    return html.details(t.pages)


_MARKED = """with named as (select id, 'S' || (id % 400) as list_id, id % 3 as kind, published, deadline, agency as nation, case when id % 2 = 0 then agency || '部关于《' || title || '》公开征求意见的通知' else '关于' || title || '的通知' end as title, '/n/' || id || '.html' as path from notices)"""


def _marked(t):
    """Notices as three sites would show them, beside their titles."""
    whole = F.when(F.col("id") % 2 == 0, F.concat("agency", F.lit("部关于《"), "title", F.lit("》公开征求意见的通知"))).otherwise(F.concat(F.lit("关于"), "title", F.lit("的通知")))
    return t.notices.select("id", (F.col("id") % 3).alias("kind"), "published", "deadline", F.concat(F.lit("S"), (F.col("id") % 400).cast("string")).alias("list_id"), "body", whole.alias("title"))


@query(
    "s04_source_lists",
    _MARKED + """ select list_id, ['moj', 'samr', 'mot'][(kind + 1)::int] as source_id, 'https://example.org' || path as url, title, case when id % 2 = 0 then nation || '部' else ['司法部', '市场监管总局', '交通运输部'][(kind + 1)::int] end as agency,
 published, case when kind = 1 then deadline end as deadline, case when kind = 1 and id % 5 <> 0 then 'open' when kind = 2 then 'closed' end as status from named""",
    dates="published deadline",
)
def _(t):
    from ..sources import adapters

    day = lambda pattern, c="published": F.date_format(c, pattern)
    href = F.concat(F.lit('href="/n/'), F.col("id").cast("string"), F.lit('.html"'))
    moj = F.concat(F.lit("<li><a "), href, F.lit(">"), "title", F.lit('</a><span class="rightData">'), day("yyyy年M月d日"), F.lit("</span></li><li><a href='/'>首页</a>"))
    state = F.when(F.col("id") % 5 == 0, "").otherwise("（进行中）")
    samr = F.concat(F.lit('<li class="x zjnav04Left02_content"><div class=doctitle><a '), href, F.lit(' title="'), "title", F.lit('">'), F.substring("title", 1, 8), F.lit('…</a></div><span class="doctime">'), day("yyyy-MM-dd"), F.lit(" 至 "), F.coalesce(day("yyyy/M/d", "deadline"), F.lit("")), F.lit('</span><b class="docstatus">'), state, F.lit("</b>"))
    mot = F.concat(F.lit('<li class="news-item"><a class="news-link" '), href, F.lit('><span class="news-title">[已结束] '), "title", F.lit('</span><span class="news-date">'), day("yyyy.MM.dd"), F.lit("</span></a></li>"))
    row = F.when(F.col("kind") == 0, moj).when(F.col("kind") == 1, samr).otherwise(mot)
    twice = F.when(F.col("id") % 10 == 0, F.concat(row, row)).otherwise(row)  # a row shown twice is one notice
    source = F.get(F.array(*map(F.lit, ("moj", "samr", "mot"))), F.col("kind").cast("int"))
    head = F.get(F.array(*map(F.lit, ('<nav><ul><li><a href="/about">关于本站</a></ul></nav><ul class="newsMsgList_zzy">', "<ul>", '<ul class="news-list">'))), F.col("kind").cast("int"))
    pages = _marked(t).groupBy("list_id", "kind").agg(F.array_join(F.collect_list(twice), "\n").alias("rows"))
    pages = pages.select("list_id", source.alias("source_id"), F.lit("https://example.org/list/index.html").alias("url"), F.concat(F.lit("<!DOCTYPE html><html><body>"), head, "rows", F.lit("</ul></body></html>")).alias("html"))
    return adapters.list_rows(pages, keep=("list_id",)).select("list_id", "source_id", "url", "title", "agency", "published", "deadline", "status")


@query(
    "s05_source_details",
    _MARKED + """ select 'https://example.org' || path as url, case when id % 7 > 0 and kind <> 1 then title end as title, case when id % 7 > 0 and kind <> 1 and id % 2 = 0 then nation || '部' end as agency,
 case when id % 7 > 0 then published end as published, case when id % 7 > 0 then deadline end as deadline, case when id % 7 > 0 then 2 + (deadline is not null)::int end as n_blocks, case when id % 7 > 0 and id % 4 > 0 then '附件' || id end as file from named""",
    dates="published deadline",
)
def _(t):
    from ..sources import adapters

    key = F.col("id").cast("string")
    day = lambda pattern, c="published": F.date_format(c, pattern)
    until = F.coalesce(F.concat(F.lit("<p>请于"), day("yyyy年M月d日", "deadline"), F.lit("前反馈。</p>")), F.lit(""))
    text = F.concat(F.lit("<p>第一段<script>var x = '<p>';</script></p><div><p> 正文\n&amp; "), key, F.lit("</p></div>"), until)
    file = F.when(F.col("id") % 4 > 0, F.concat(F.lit('<a href="/f/'), key, F.lit('.PDF?v=1">附件'), key, F.lit('</a><a href="/f/other.html">页</a><a href="/f/'), key, F.lit('.PDF?v=1">again</a>'))).otherwise(F.lit(""))
    moj = F.concat(F.lit("<h1>"), "title", F.lit('</h1><div class="sT">来源 发布时间：'), day("yyyy-MM-dd"), F.lit('</div><div class="news_content_style"><div class="TRS_Editor">'), text, F.lit('</div></div><div id="isShowFile">'), file, F.lit("</div>"))
    samr = F.concat(F.lit('<head><meta name="PubDate" content="'), day("yyyy-MM-dd"), F.lit(' 10:00"></head><h1>not the title</h1><div class="Three_xilan_07">'), text, F.lit('</div><ul class="contentLeft0102box"></ul><ul class="contentLeft0102box"><li>'), file, F.lit("</li></ul>"))
    mot = F.concat(F.lit('<h1 class="article-title">'), "title", F.lit('</h1><div class="article-meta"><i class="publish-date">'), day("yyyy-MM-dd"), F.lit('</i></div><div id="Zoom">'), text, file, F.lit("</div>"))
    html = F.when(F.col("id") % 7 == 0, "<html><body></body></html>").when(F.col("kind") == 0, moj).when(F.col("kind") == 1, samr).otherwise(mot)
    source = F.get(F.array(*map(F.lit, ("moj", "samr", "mot"))), F.col("kind").cast("int"))
    pages = _marked(t).select(source.alias("source_id"), F.concat(F.lit("https://example.org/n/"), key, F.lit(".html")).alias("url"), html.alias("html"))
    found = adapters.details(pages)
    return found.select("url", "title", "agency", "published", "deadline", F.size(F.split("body", "\n")).alias("n_blocks"), F.get("files.name", 0).alias("file"))


@query("s06_hops", "select o_orderkey::varchar as url, (o_orderkey // 16)::varchar as last from orders")
def _(t):
    hops = t.orders.select(F.col("o_orderkey").cast("string").alias("url"), F.expr("cast(o_orderkey div 2 as string)").alias("next"))
    return src.followed_hops(hops.select("url"), hops).select("url", "last")


@query("s08_kinds", "select page_id, list_extract(['html', 'pdf', 'zip', 'ole', 'other', 'other'], (page_id % 6)::int + 1) as kind from pages")
def _(t):
    from ..functions.files import kind_of

    heads = F.array(*[F.unhex(F.lit(h)) for h in ("", "255044462D312E37", "504B030414000600", "D0CF11E0A1B11AE1", "89504E470D0A1A0A", "")])
    sixth = (F.col("page_id") % 6).cast("int")
    body = F.when(sixth == 0, F.col("html").cast("binary")).when(sixth == 5, F.lit("plain text, no page").cast("binary")).otherwise(F.substring(F.col("html").cast("binary"), 1, 200))
    return t.pages.select("page_id", kind_of(F.concat(F.get(heads, sixth), body)).alias("kind"))


@query("s20_attachment_status", "select url, case when attempts = 4 then 'blocked' when attempts = 3 then 'html_page' when name like '%.docx' and attempts = 2 then 'unsupported_kind' when chars > 4500 then 'too_large' when status = 'error' then 'error' when status = 'pending' then 'unsupported_container' when chars < 300 then 'scanned' else 'ok' end as result from files")
def _(t):
    c = F.col
    kind = F.when(c("name").like("%.docx") & (c("attempts") == 2), "other").otherwise("pdf")
    text = F.when(c("status") != "pending", F.lit("text"))
    result = src.attachment_status(c("attempts") != 4, c("attempts") == 3, kind, c("chars"), c("status") != "error", text, F.when(c("chars") < 300, 0).otherwise(c("chars")), 4500)
    return t.files.select("url", result.alias("result"))


@query("s15_feed_items", "select o_custkey as feed_id, 'g' || o_orderkey as guid, case when o_orderkey % 3 = 0 then null else 'http://x/' || o_orderkey end as link, case when o_orderkey % 3 = 0 then 'no link' end as problem from orders")
def _(t):
    key = F.col("o_orderkey").cast("string")
    link = F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("<link>http://x/"), key, F.lit("</link>")))
    item = F.concat(F.lit("<item><guid>g"), key, F.lit("</guid>"), link, F.lit("<pubDate>Mon</pubDate></item>"))
    feeds = t.orders.groupBy(F.col("o_custkey").alias("feed_id")).agg(F.concat(F.lit("<rss>"), F.array_join(F.collect_list(item), ""), F.lit("</rss>")).alias("xml"))
    return src.feed_items(feeds).select("feed_id", "guid", "link", "problem")


@query("s16_model_json", "select event_id, case when event_id % 3 = 0 then null else props end as parsed from events")
def _(t):
    answer = F.when(F.col("event_id") % 3 == 0, F.lit("no object here")).otherwise(F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
    return t.events.select("event_id", src.model_json(answer).alias("parsed"))
