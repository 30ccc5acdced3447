"""Joins, set operations and rule matching (J, U, P20, X03, X04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as m
from .registry import query
from .views import TODAY


@query("j01_inner", "select f.url, n.agency from files f join notices n on n.id = f.notice_id where f.status = 'error'")
def _(t):
    return t.files.where("status = 'error'").join(t.notices, F.col("notice_id") == F.col("id")).select("url", "agency")


@query("j02_left_preaggregated", "select id, clicks, coalesce(n, 0) as counted from notices left join (select notice_id, count(*) as n from clicks group by 1) c on c.notice_id = id where clicks <> coalesce(n, 0)")
def _(t):
    counted = t.clicks.groupBy("notice_id").agg(F.count("*").alias("n"))
    joined = t.notices.join(counted, F.col("id") == F.col("notice_id"), "left").withColumn("counted", F.coalesce("n", F.lit(0)))
    return joined.where("clicks <> counted").select("id", "clicks", "counted")


@query("j03_anti", "select id from notices n where not exists (select 1 from files f where f.notice_id = n.id and f.status = 'ok')")
def _(t):
    return t.notices.join(t.files.where("status = 'ok'"), F.col("id") == F.col("notice_id"), "left_anti").select("id")


@query("j04_semi", "select id from notices n where exists (select 1 from files f where f.notice_id = n.id and f.status = 'pending' and f.chars > 4000)")
def _(t):
    return t.notices.join(t.files.where("status = 'pending' and chars > 4000"), F.col("id") == F.col("notice_id"), "left_semi").select("id")


@query("j05_semi_in", "select id, agency from notices where agency in (select distinct n_name from nation where n_regionkey = 2)")
def _(t):
    return t.notices.join(t.nation.where("n_regionkey = 2"), F.col("agency") == F.col("n_name"), "left_semi").select("id", "agency")


@query("j06_exists_in_filter", "select agency, count(*) filter (where exists (select 1 from files f where f.notice_id = n.id and f.status = 'ok')) as n_fed, count(*) as n from notices n group by 1")
def _(t):
    fed = t.files.where("status = 'ok'").select(F.col("notice_id").alias("id"), F.lit(True).alias("fed")).distinct()
    return t.notices.join(fed, "id", "left").groupBy("agency").agg(F.count_if(F.coalesce("fed", F.lit(False))).alias("n_fed"), F.count("*").alias("n"))


@query(
    "j07_source_facets",
    """with met as (select source_id, count(*) as n, count(*) filter (where status = 'open') as n_open, max(fetched_at) as last_fetch from notices group by 1),
 registry as (select 'S' || n_nationkey as source_id, n_name as name from nation where n_nationkey between 2 and 14)
 select coalesce(r.source_id, m.source_id) as source_id, coalesce(r.name, m.source_id) as name, coalesce(n, 0) as n, coalesce(n_open, 0) as n_open, r.source_id is not null as registered, last_fetch
 from registry r full outer join met m on m.source_id = r.source_id""",
)
def _(t):
    from ..operators.aggregates import source_facets

    registry = t.nation.where("n_nationkey between 2 and 14").select(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("source_id"), F.col("n_name").alias("name"))
    return source_facets(t.notices, registry)


_MATCH = """((scope = 'all' or list_has_any(categories, tags) or list_has_any(s.agencies, list_concat(n.agencies, [n.agency])) or len(list_filter(keywords, lambda k: contains(lower(n.title || chr(10) || n.body), lower(k)))) > 0
 or (len(audiences) > 0 and len(keywords) = 0)) and (len(audiences) = 0 or list_contains(audiences, coalesce(n.audience, 'unknown'))))"""
_ACTIVE = "confirmed_at is not null and unsubscribed_at is null"


def _active(t):
    from ..operators.filters import active_subscriptions

    return active_subscriptions(t.subscriptions)


@query("p20_j08_matched_pairs", f"select s.id as subscription_id, n.id as notice_id from subscriptions s join notices n on {_MATCH} where {_ACTIVE}")
def _(t):
    return m.matched_pairs(_active(t), t.notices)


@query("j09_unsent", f"select s.id as subscription_id, n.id as notice_id from subscriptions s join notices n on {_MATCH} where {_ACTIVE} and (s.id, n.id) not in (select l_suppkey, l_orderkey from lineitem)")
def _(t):
    sent = t.lineitem.select(F.col("l_suppkey").alias("subscription_id"), F.col("l_orderkey").alias("notice_id"))
    return m.unsent(_active(t), t.notices, sent)


@query("j10_predecessor", "select a.id, b.id as version_of, b.published as before from notices a join notices b on b.id = a.id - 500", dates="before")
def _(t):
    before = t.notices.select(F.col("id").alias("version_of"), F.col("published").alias("before"))
    return t.notices.select("id").join(before, F.col("id") - 500 == F.col("version_of")).select("id", "version_of", "before")


_FLAT = "regexp_replace(text, '[\\s\\x{00a0}\\x{3000}]+', '', 'g')"


@query("j11_contained_quotes", f"select b.item_id as needle_id, d.doc_id as haystack_id from (select item_id, {_FLAT} as flat from benchmark) b join (select doc_id, {_FLAT} as flat from documents) d on contains(d.flat, b.flat)")
def _(t):
    return m.contained_pairs(t.benchmark.select(F.col("item_id").alias("id"), "text"), t.documents.select(F.col("doc_id").alias("id"), "text"))


def _impacts(t):
    n = t.notices.where("summary is not null").select(F.col("id").alias("notice_id"), F.concat(F.lit("“"), "body", F.lit(" ”")).alias("quote"), F.lower("title").alias("impact"))
    status = F.when(F.col("notice_id") % 2 == 0, "revised").when(F.col("notice_id") % 5 == 0, "rejected").otherwise("kept")
    r = n.where("notice_id % 9 <> 0").select("notice_id", F.concat(F.lit('"'), F.replace("quote", F.lit(" "), F.lit("  ")), F.lit('"')).alias("quote"), status.alias("status"), F.when(F.col("notice_id") % 4 == 0, F.lit("as revised")).alias("revised"))
    return n, r


@query("j12_reviewed_impacts", "select id as notice_id, '“' || body || ' ”' as quote, case when id % 2 = 0 then case when id % 4 = 0 then 'as revised' else lower(title) end else lower(title) end as impact from notices where summary is not null and id % 9 <> 0 and not (id % 2 <> 0 and id % 5 = 0)")
def _(t):
    return m.reviewed_impacts(*_impacts(t))


@query("j12_orphan_reviews", "select id as notice_id from notices where summary is not null and id % 9 <> 0 and id % 6 = 0")
def _(t):
    impacts, reviews = _impacts(t)
    return m.orphan_reviews(impacts.where("notice_id % 6 <> 0"), reviews).select("notice_id")


@query("j13_scalar_subqueries", "select id, (select count(*) from files f where f.notice_id = n.id) as n_files, (select max(chars) from files f where f.notice_id = n.id) as most_chars from notices n")
def _(t):
    per = t.files.groupBy("notice_id").agg(F.count("*").alias("n_files"), F.max("chars").alias("most_chars"))
    return t.notices.join(per, F.col("id") == F.col("notice_id"), "left").select("id", F.coalesce("n_files", F.lit(0)).alias("n_files"), "most_chars")


@query("j14_unnest", "select tag, count(*) as n from (select unnest(tags) as tag from notices) group by 1")
def _(t):
    return t.notices.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("j15_lookup_ranked", "select c_custkey, o_orderkey from (select o_orderkey, o_custkey, row_number() over (order by o_totalprice desc, o_orderkey) as r from orders) join customer on c_custkey = o_custkey where r <= 50")
def _(t):
    top = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)
    return top.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey")


@query("j16_labels", "select n_name, r_name from nation left join region on r_regionkey = n_regionkey")
def _(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", "r_name")


@query("j17_count_right", "select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'P' group by 1")
def _(t):
    right = t.orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t.customer.join(right, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("j18_two_way_difference", "select doc_id, 'missing' as side from documents where doc_id not in (select doc_id from labels) union select doc_id, 'ghost' from labels where doc_id not in (select doc_id from documents)")
def _(t):
    return m.set_difference(t.documents.select("doc_id"), t.labels.select("doc_id"), "doc_id")


@query(
    "j19_prefixes",
    """with ids as (select substr(sha256(url), 1, 16) as id from pages), p as (select distinct substr(id, 1, 5) as prefix from ids union all select 'ab'), h as (select prefix, count(*) as n, min(id) as id from p join ids on starts_with(id, prefix) where length(prefix) >= 4 group by 1)
 select p.prefix, case when n = 1 then id end as id, case when length(p.prefix) < 4 then 'too short' when n is null then 'not found' when n > 1 then 'ambiguous' else 'ok' end as outcome from p left join h using (prefix)""",
)
def _(t):
    from ..functions.urls import notice_id

    ids = t.pages.select(notice_id(F.col("url")).alias("id"))
    prefixes = ids.select(F.substring("id", 1, 5).alias("prefix")).unionByName(t.spark.createDataFrame([("ab",)], "prefix string"))
    return m.resolved_prefixes(prefixes, ids)


@query("u01_labelled_union", "select 'orders' as what, count(*) as n from orders union all select 'open', count(*) from notices where status = 'open' union all select 'files', count(*) from files")
def _(t):
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(t.orders, "orders").unionByName(count(t.notices.where("status = 'open'"), "open")).unionByName(count(t.files, "files"))


@query("u02_distinct_union", "select distinct unnest(agencies) as agency from notices union select n_name from nation")
def _(t):
    return t.notices.select(F.explode("agencies").alias("agency")).unionByName(t.nation.select(F.col("n_name").alias("agency"))).distinct()


@query("u03_append_absent", "select id, list_concat(tags, list_filter(['5-LOW', 'EXTRA'], lambda x: not list_contains(tags, x))) as merged from notices")
def _(t):
    return t.notices.select("id", F.array_union("tags", F.array(F.lit("5-LOW"), F.lit("EXTRA"))).alias("merged"))


@query(
    "x03_due_stages",
    f"""select s.id as subscription_id, n.id as notice_id, n.deadline - date '{TODAY}' as days_left, case when sent7 then 'd3' else 'd7' end as stage
 from (select id from subscriptions where {_ACTIVE} and scope = 'all') s cross join (select id, deadline, id % 2 = 0 as sent7 from notices where status = 'open' and deadline between date '{TODAY}' and date '{TODAY}' + 7) n
 where not sent7 or n.deadline - date '{TODAY}' <= 3""",
)
def _(t):
    subs = t.subscriptions.where("confirmed_at is not null and unsubscribed_at is null and scope = 'all'").select(F.col("id").alias("subscription_id"))
    open_ = t.notices.where("status = 'open' and deadline is not null").where(F.col("deadline").between(F.lit(TODAY).cast("date"), F.date_add(F.lit(TODAY).cast("date"), 7))).select(F.col("id").alias("notice_id"), "deadline")
    every = lambda df: df.withColumn("key", F.lit(0))
    pairs = m.beside_few(every(open_), every(subs), "key").drop("key")  # every subscriber to all, with the few notices due
    sent = pairs.where("notice_id % 2 = 0").select("subscription_id", "notice_id", F.lit("d7").alias("stage"))
    return m.due_stages(pairs, sent, TODAY)


@query("x04_capped_round", f"with p as (select s.id as subscription_id, n.id as notice_id, n.first_seen from subscriptions s join notices n on {_MATCH} where {_ACTIVE} and n.first_seen >= timestamp '1998-05-25') select subscription_id, notice_id from (select *, row_number() over (partition by subscription_id order by first_seen, notice_id) as r from p) where r <= 20")
def _(t):
    recent = t.notices.where(F.col("first_seen") >= F.lit("1998-05-25").cast("timestamp_ntz")).drop("deadline")
    return m.first_matches(_active(t), recent, 20, "first_seen", "id").select("subscription_id", F.col("id").alias("notice_id"))
