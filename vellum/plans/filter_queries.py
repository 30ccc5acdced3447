"""Filters, orders and pages (P, O) over notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import searchable
from ..operators import filters as f, ordering as o
from .registry import query
from .views import NOW, TODAY

COLS = ("id", "status", "deadline")

_FILTERED = "audience = 'public' and published >= date '1997-01-01' and published < date '1998-01-01' and (contains(lower(title), 'order') or contains(lower(body), 'order')) and (contains(lower(title), 'machinery') or contains(lower(body), 'machinery'))"
_QUERY = f.NoticeQuery.parse({"audience": "public", "from": "1997-01", "to": "1997-12", "q": "Order machinery"}, TODAY, NOW)


@query("p01_filtered_page", f"select id, title, status, deadline, published from notices where {_FILTERED} order by (status <> 'open'), deadline nulls last, fetched_at desc nulls last, id limit 50", dates="deadline published")
def _(t):
    return o.page_of(t.notices.where(_QUERY.condition()), "deadline", 1).select("id", "title", "status", "deadline", "published")


@query("a34_filtered_count", f"select count(*) as n from notices where {_FILTERED}")
def _(t):
    return t.notices.where(_QUERY.condition()).agg(F.count("*").alias("n"))


def _simple(name: str, condition, sql: str):
    query(name, f"select id, status, deadline from notices where {sql}", dates="deadline")(lambda t: t.notices.where(condition()).select(*COLS))


_simple("p02_audience_unknown", lambda: f.audience_is("unknown"), "audience = 'unknown' or audience is null")
_simple("p03_tag", lambda: f.has_tag("MACHINERY"), "list_contains(tags, 'MACHINERY')")
_simple("p04_agency_any", lambda: f.has_agency("BUILDING") | f.has_agency("NATION_3"), "list_contains(agencies, 'BUILDING') or agency = 'NATION_3' or list_contains(agencies, 'NATION_3')")
_simple("p04_agency_lead", lambda: f.has_agency("NATION_3", lead_only=True), "agencies[1] = 'NATION_3'")
_simple("p05_month_range", lambda: f.in_months("1996-03", "1996-07"), "strftime(published, '%Y-%m') between '1996-03' and '1996-07'")
_simple("p05_month_open_end", lambda: f.in_months("1998-03"), "strftime(published, '%Y-%m') >= '1998-03'")
_simple("p06_keywords", lambda: f.has_keywords("household 1-URGENT"), "(contains(lower(title), 'household') or contains(lower(body), 'household')) and (contains(lower(title), '1-urgent') or contains(lower(body), '1-urgent'))")
_simple("p06_keywords_literal", lambda: f.has_keywords("r#00000"), "contains(lower(title), 'r#00000') or contains(lower(body), 'r#00000')")
_simple("p07_source", lambda: F.col("source_id") == "S7", "source_id = 'S7'")
_simple("p08_still_open", lambda: f.still_open(TODAY), f"status = 'open' and (deadline is null or deadline >= date '{TODAY}')")
_simple("p09_recent", lambda: f.seen_since(NOW, 7), f"first_seen >= timestamp '{NOW}' - interval 7 day")
_simple("p10_period_le7", lambda: f.in_period_bucket("le7"), "deadline - published <= 7")
_simple("p10_period_d8_15", lambda: f.in_period_bucket("d8_15"), "deadline - published between 8 and 15")
_simple("p10_period_gt30", lambda: f.in_period_bucket("gt30"), "deadline - published > 30")
query("p14_review_queue", "select id, status, deadline from notices where summary_status = 'failed_review'", dates="deadline")(lambda t: f.review_queue(t.notices).select(*COLS))
_simple("p18_first_seen_since", lambda: F.col("first_seen") >= F.lit("1998-01-01").cast("timestamp_ntz"), "first_seen >= timestamp '1998-01-01'")
_simple("f50_new", lambda: f.is_new(F.col("first_seen"), NOW), f"first_seen > timestamp '{NOW}' - interval 7 day")
query("p31_searchable", r"select page_id, regexp_matches(case page_id % 3 when 0 then url when 1 then '!? —' else '' end, '[\p{L}\p{N}]') as ok from pages")(lambda t: t.pages.select("page_id", searchable(F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, "!? —").otherwise("")).alias("ok")))


@query("p11_effective_status", f"select id, case when status = 'open' and deadline < date '{TODAY}' then 'closed' else status end as effective from notices")
def _(t):
    return t.notices.select("id", f.effective_status(TODAY).alias("effective"))


@query("p12_ingest_status", f"select id, coalesce(case when deadline is not null then case when deadline < date '{TODAY}' then 'closed' else 'open' end end, status, 'open') as derived from notices")
def _(t):
    return t.notices.select("id", f.ingest_status(TODAY, F.col("status")).alias("derived"))


@query("p13_summary_queue", "select id, fetched_at from notices where summary is null and summary_status = 'pending' and status <> 'closed' order by fetched_at, id limit 40")
def _(t):
    return f.summary_queue(t.notices, 40).select("id", "fetched_at")


@query(
    "p15_extraction_due",
    f"""select url, status, case status when 'pending' then true when 'blocked' then date_diff('day', fetched_at::date, date '{TODAY}') >= 7
 when 'error' then attempts < 3 when 'ok' then date_diff('day', fetched_at::date, date '{TODAY}') >= 30 else false end as due from files""",
)
def _(t):
    return t.files.select("url", "status", f.extraction_due(F.col("status"), F.col("fetched_at"), F.col("attempts"), TODAY).alias("due"))


@query("p16_extraction_scan", "select id, source_id from notices where status <> 'closed' and source_id in ('S1', 'S2') order by fetched_at, id limit 100")
def _(t):
    return t.notices.where((F.col("status") != "closed") & F.col("source_id").isin("S1", "S2")).orderBy("fetched_at", "id").limit(100).select("id", "source_id")


@query("p17_open_with_deadline", "select id, deadline from notices where status = 'open' and deadline is not null", dates="deadline")
def _(t):
    return f.open_with_deadline(t.notices).select("id", "deadline")


@query("p19_active_subscriptions", "select id from subscriptions where confirmed_at is not null and unsubscribed_at is null")
def _(t):
    return f.active_subscriptions(t.subscriptions).select("id")


@query(
    "p21_countable_clicks",
    r"""select event_id, case when method = 'HEAD' then 'head' when agent = '' then 'no agent' when regexp_matches(agent, '(?i)bot|spider|crawl|slurp|facebookexternalhit|preview|monitor|headless') then 'robot'
 when regexp_matches(agent, '(?i)^(curl|wget|python|go-http|java|okhttp|libwww|axios|node-fetch)') then 'script' end as reason
 from (select event_id, case event_id % 5 when 0 then 'HEAD' else 'GET' end as method, case event_id % 7 when 0 then '' when 1 then 'Googlebot/2.1' when 2 then 'curl/8' else 'Mozilla/5.0' end as agent from events)""",
)
def _(t):
    k = F.col("event_id")
    agent = F.when(k % 7 == 0, "").when(k % 7 == 1, "Googlebot/2.1").when(k % 7 == 2, "curl/8").otherwise("Mozilla/5.0")
    return t.events.select("event_id", f.not_countable_reason(agent, F.when(k % 5 == 0, "HEAD").otherwise("GET"), F.lit(None).cast("string")).alias("reason"))


@query("p23_quality", "select id from notices where (audience is distinct from 'public') and deadline < published and regexp_matches(title, '^Order [1-3]') and source_id in ('S1', 'S5') and body like '%BUILDING%'")
def _(t):
    bad = ~F.col("audience").eqNullSafe("public") & (F.col("deadline") < F.col("published")) & F.col("title").rlike("^Order [1-3]") & F.col("source_id").isin("S1", "S5") & F.col("body").like("%BUILDING%")
    return t.notices.where(bad).select("id")


@query("p24_rule_problems", "select id, case when scope <> 'all' and len(categories) + len(agencies) + len(keywords) + len(audiences) = 0 then 'no rules' when list_contains(audiences, 'unknown') then 'unknown audience' end as problem from subscriptions")
def _(t):
    c = [F.col(x) for x in ("scope", "categories", "agencies", "keywords", "audiences")]
    return t.subscriptions.select("id", f.rule_problem(*c, ["1-URGENT"], ["public", "sector"]).alias("problem"))


@query("p28_token_status", "select id, case when unsubscribed_at is not null then 'unsubscribed' when confirmed_at is not null then 'confirmed' else 'confirmable' end as state from subscriptions")
def _(t):
    return t.subscriptions.select("id", f.token_status(F.col("confirmed_at"), F.col("unsubscribed_at"), F.lit(True)).alias("state"))


@query("p34_rebucket", "select case when regexp_matches(body, 'BUILDING|MACHINERY') then 'works' when body like '%HOUSEHOLD%' then 'home' else 'other' end as bucket, count(*) as n from notices where summary like 'Summary%' group by 1")
def _(t):
    bucket = F.when(F.col("body").rlike("BUILDING|MACHINERY"), "works").when(F.col("body").like("%HOUSEHOLD%"), "home").otherwise("other")
    return t.notices.where(F.col("summary").like("Summary%")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("p35_site_today", "select event_id from events where strftime(ts + interval 8 hour, '%Y-%m-%d') = '2024-01-10'")
def _(t):
    local = F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Shanghai"), "yyyy-MM-dd")
    return t.events.where(local == "2024-01-10").select("event_id")


_ORDER_SQL = {
    "deadline": "(status <> 'open'), deadline nulls last, fetched_at desc nulls last, id",
    "published": "published desc nulls last, id",
    "newest": "first_seen desc nulls last, id",
    "clicks": "clicks desc nulls last, id",
}
for _name, _order in _ORDER_SQL.items():
    query(f"o02_order_{_name}", f"select id, row_number() over (order by {_order}) as pos from (select * from notices order by {_order} limit 60)")(
        lambda t, name=_name: o.page_of(t.notices, name, 1, size=60).select("id", "status", "deadline", "fetched_at", "published", "first_seen", "clicks").transform(lambda d: _numbered(d, name))
    )


def _numbered(page, name):
    from pyspark.sql import Window

    return page.select("id", F.row_number().over(Window.orderBy(*o.ORDERS[name]())).alias("pos"))  # a page


@query("o03_page_3", f"select id from notices order by {_ORDER_SQL['published']} limit 50 offset 100")
def _(t):
    return o.page_of(t.notices, "published", 3).select("id")


@query("o03_last_page", f"select id from notices order by {_ORDER_SQL['published']} limit 50 offset (select (greatest(1, (count(*) + 49) // 50) - 1) * 50 from orders)")
def _(t):
    return o.page_of(t.notices, "published", 10**9, total=t.orders.count()).select("id")


@query("o04_top_clicked", "select id, clicks from notices where clicks > 0 order by clicks desc, id limit 10")
def _(t):
    return o.top_clicked(t.notices, 10).select("id", "clicks")


@query("o05_nulls_last", "select id, deadline from notices order by deadline nulls last, id limit 300", dates="deadline")
def _(t):
    return t.notices.orderBy(F.col("deadline").asc_nulls_last(), "id").limit(300).select("id", "deadline")


@query("o06_order_by_drift", "select id, abs(clicks - 50) as drift from notices order by abs(clicks - 50) desc, id limit 25")
def _(t):
    return t.notices.select("id", F.abs(F.col("clicks") - 50).alias("drift")).orderBy(F.desc("drift"), "id").limit(25)


@query("o07_every_kth", "select id from (select id, row_number() over (order by id) - 1 as r from notices) where r % 6 = 0 and r < 6 * 32")
def _(t):
    return o.every_kth(t.notices.select("id"), 6, 32, "id")


@query(
    "o08_ranked_attachments",
    """with scored as (select notice_id, name, (case when lower(name) like '%.docx' then 30 else 20 end) + (case when regexp_matches(lower(name), 'draft') then 40 else 0 end)
 + (case when regexp_matches(lower(name), 'explanation') then 30 else 0 end) - (case when regexp_matches(lower(name), 'form|table') then 50 else 0 end) as score,
 regexp_matches(lower(name), 'explanation') as explains from (select distinct notice_id, name from files)),
 ranked as (select *, row_number() over (partition by notice_id order by score desc, name) as rank from scored),
 marked as (select *, min(case when explains then rank end) over (partition by notice_id) as fe from ranked)
 select notice_id, name, score, rank from marked where case when fe > 2 then rank < 2 or rank = fe else rank <= 2 end""",
)
def _(t):
    return o.ranked_attachments(t.files.select("notice_id", "name").distinct(), 2).select("notice_id", "name", "score", "rank")


@query("s13_batch_lookup", "select id, title from notices where id in (5, 17, 4000)")
def _(t):
    wanted = t.spark.createDataFrame([(0, 4000), (1, 5), (2, 17), (3, -1)], "pos int, id long")
    return t.notices.join(F.broadcast(wanted), "id").orderBy("pos").select("id", "title")


@query("s12_full_scan", "select id, title, agency from notices")
def _(t):
    return t.notices.orderBy("id").select("id", "title", "agency")
