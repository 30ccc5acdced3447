"""Queries of contacts, chosen files, chains of versions and subscriptions as a fold of events."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import contacts as c
from ..operators import aggregates, audits, merge, ordering, subscriptions as s
from ..sources import files as src
from .registry import query


def _text(n):
    """A notice's ways to comment; every fifth has no text."""
    key = F.col("id").cast("string")
    parts = (F.lit("请将意见发至邮箱 Desk"), key, F.lit("@office.gov.cn。\n也可登录 https://www.example.gov.cn/form/"), key, F.lit("，或登录中国政府网（www.gov"), (F.col("id") % 7).cast("string"), F.lit(".cn）。通信地址：北京市西城区"), F.col("agency"), F.lit("路"), (F.col("id") % 90).cast("string"), F.lit("号（邮政编码：100020），并注明意见。联系电话：010-6410"), F.lpad((F.col("id") % 10000).cast("string"), 4, "0"), F.lit("，010-68205261。联系电话及传真：010-68205261；附件见 https://www.example.gov.cn/f/a.pdf"))
    return n.select("id", "source_id", F.when(F.col("id") % 5 > 0, F.concat(*parts)).alias("text"))


@query(
    "f31_contacts",
    """with n as (select id, agency, '也可登录 https://www.example.gov.cn/form/' || id || '，或登录中国政府网（www.gov' || (id % 7) || '.cn）。' as web, '联系电话：010-6410' || lpad((id % 10000)::varchar, 4, '0') || '，010-68205261。' as tel from notices where id % 5 > 0),
 a as (select *, '北京市西城区' || agency || '路' || (id % 90) || '号（邮政编码：100020）' as address from n)
 select id, 1 as rank, 'online' as kind, 'https://www.example.gov.cn/form/' || id as value, 'https://www.example.gov.cn/form/' || id as href, web as context from a
 union all select id, 2, 'online', 'http://www.gov' || (id % 7) || '.cn', 'http://www.gov' || (id % 7) || '.cn', web from a
 union all select id, 3, 'email', 'Desk' || id || '@office.gov.cn', 'mailto:Desk' || id || '@office.gov.cn', '请将意见发至邮箱 Desk' || id || '@office.gov.cn。' from a
 union all select id, 4, 'address', address, null, '通信地址：' || address || '，并注明意见。' from a
 union all select id, 5, 'phone', '010-6410' || lpad((id % 10000)::varchar, 4, '0'), 'tel:0106410' || lpad((id % 10000)::varchar, 4, '0'), tel from a
 union all select id, 6, 'phone', '010-68205261', 'tel:01068205261', tel from a
 union all select id, 7, 'fax', '010-68205261', 'tel:01068205261', '联系电话及传真：010-68205261；' from a""",
)
def _(t):
    return c.contacts(_text(t.notices))


@query("t08_contact_audit", "select source_id, count(*) as n, count(*) filter (where id % 5 = 0) as n_none, count(*) filter (where id % 5 > 0) as n_online, count(*) filter (where id % 5 > 0) as n_email, count(*) filter (where id % 5 > 0) as n_address, count(*) filter (where id % 5 > 0) as n_phone, count(*) filter (where id % 5 > 0) as n_fax from notices group by 1")
def _(t):
    texts = _text(t.notices)
    return c.contact_audit(texts, c.contacts(texts), "source_id")


@query(
    "o08_chosen_files",
    """with f as (select l_orderkey as notice_id, l_linenumber as pos, ['草案', '编制说明', '反馈表', '关于方案的', '资料'][(l_partkey % 5)::int + 1] || l_linenumber || '-' || l_suppkey || ['.pdf', '.DOCX', '.zip', '.doc'][(l_suppkey % 4)::int + 1] as name, l_partkey % 5 as w, l_suppkey % 4 as e from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem)),
 s as (select *, (case when e < 2 then 2 else 1 end + [3, 3, -4, 1, 0][(w + 1)::int])::int as score, w = 1 as explains from f where e <> 2),
 r as (select *, case when explains then 'explanation' when score >= 3 then 'draft' else 'other' end as role, row_number() over (partition by notice_id order by score desc, pos, name) as rank from s),
 m as (select *, min(case when explains then rank end) over (partition by notice_id) as fe, count(*) filter (where role = 'draft' and rank < 2) over (partition by notice_id) as drafts from r)
 select notice_id, name, score, role, least(rank, 2)::int as rank from m where case when fe > 2 and drafts > 0 then rank < 2 or rank = fe else rank <= 2 end""",
)
def _(t):
    pick = lambda key, k, values: F.get(F.array(*map(F.lit, values)), (F.col(key) % k).cast("int"))
    name = F.concat(pick("l_partkey", 5, ("草案", "编制说明", "反馈表", "关于方案的", "资料")), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"), pick("l_suppkey", 4, (".pdf", ".DOCX", ".zip", ".doc")))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    return ordering.chosen_files(lines.select(F.col("l_orderkey").alias("notice_id"), F.col("l_linenumber").alias("pos"), name.alias("name")), 2).select("notice_id", "name", "score", "role", "rank")


@query(
    "a29_chain_findings",
    """with n as (select id, agency, title as base, case when id % 11 = 0 then id - 499 when id > 500 then id - 500 end as version_of, case when id % 13 = 0 then '关于《' || title || '（北方）条例（草案）》的通知' else '关于《' || title || '条例（二次征求意见稿）》的通知' end as title from notices),
 k as (select *, lower(regexp_replace(base, '[^\\p{L}\\p{N}]', '', 'g')) || case when id % 13 = 0 then '北方条例' else '条例' end as key, lower(regexp_replace(base, '[^\\p{L}\\p{N}]', '', 'g')) || '条例' as act from n),
 acts as (select agency, act, count(*) as members, count(distinct key) as n_keys from k group by all having count(distinct key) > 1)
 select 'dirty' as finding, a.id, a.agency, a.key as name, a.version_of, null::bigint as members, null::bigint as n_keys from k a where a.version_of is not null and not exists (select 1 from k b where b.id = a.version_of and b.agency = a.agency and b.key = a.key)
 union all select 'split', k.id, k.agency, k.act, k.version_of, members, n_keys from k join acts using (agency, act)""",
)
def _(t):
    plain = F.concat(F.lit("关于《"), "title", F.lit("条例（二次征求意见稿）》的通知"))
    north = F.concat(F.lit("关于《"), "title", F.lit("（北方）条例（草案）》的通知"))
    before = F.when(F.col("id") % 11 == 0, F.col("id") - 499).when(F.col("id") > 500, F.col("id") - 500)
    return audits.chain_audit(t.notices.select("id", F.when(F.col("id") % 13 == 0, north).otherwise(plain).alias("title"), "agency", before.alias("version_of")))


_EVENTS = """with recursive k as (select user_id, event_id as seq, case when event_id % 4 < 2 then 'submit' when event_id % 16 = 3 then 'unsubscribe' else 'confirm' end as kind, case when event_id % 4 < 2 then event_id end as own from events),
 p as (select *, row_number() over (partition by user_id order by seq) as rn, max(own) over (partition by user_id order by seq rows unbounded preceding) as last, min(own) over (partition by user_id order by seq rows unbounded preceding) as first from k),
 e as (select *, case when kind = 'unsubscribe' then first when seq % 10 = 2 then -1 when seq % 8 = 6 then first else last end as ref from p),
 r as (select distinct user_id, 0::bigint as rn, null::bigint as rules, null::bigint as pending, false as conf, null::bigint as tok, null::bigint as made, false as gone, null::varchar as outcome, null::bigint as seq from events union all
 select e.user_id, e.rn, case when act in ('created', 'pending-refreshed', 'resubscribed') then e.seq when act = 'confirm' then coalesce(pending, rules) else rules end,
 case when act = 'confirmed-pending' then e.seq when act in ('created', 'pending-refreshed', 'resubscribed', 'confirm') then null else pending end,
 case when act in ('created', 'pending-refreshed', 'resubscribed') then false when act = 'confirm' then true else conf end, case when e.kind = 'submit' then e.seq else tok end, coalesce(made, case when act = 'created' then e.seq end),
 case when act = 'done' then true when act = 'resubscribed' then false else gone end, case when act = 'confirm' then 'confirmed' else act end, e.seq
 from (select e.*, r.rules, r.pending, r.conf, r.tok, r.made, r.gone, case when e.kind = 'submit' then case when made is null then 'created' when conf and not gone then 'confirmed-pending' when gone then 'resubscribed' else 'pending-refreshed' end
  when made is null or e.ref is distinct from case when e.kind = 'confirm' then tok else made end then 'invalid' when e.kind = 'unsubscribe' then 'done' when gone then 'unsubscribed' when conf and pending is null then 'confirmed' else 'confirm' end as act
  from r join e on e.user_id = r.user_id and e.rn = r.rn + 1) e)"""


def _subscribed(t):
    """Events as submissions, confirmations by the last token, an old one or a wrong one, and unsubscribing."""
    e = t.events.select("event_id", F.col("user_id").cast("string").alias("address"), "ts")
    kind = F.when(F.col("event_id") % 4 < 2, "submit").when(F.col("event_id") % 16 == 3, "unsubscribe").otherwise("confirm")
    w = Window.partitionBy("address").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(kind == "submit", F.col("event_id"))
    last, first = F.max(own).over(w), F.min(own).over(w)
    ref = F.when(kind == "unsubscribe", first).when(F.col("event_id") % 10 == 2, -1).when(F.col("event_id") % 8 == 6, first).otherwise(last)
    p = e.select("event_id", "address", "ts", kind.alias("kind"), ref.alias("ref"))
    token = F.when(F.col("kind") == "confirm", s.token("confirm", F.col("address"), F.col("ref"))).when(F.col("kind") == "unsubscribe", s.token("unsubscribe", F.col("address"), F.col("ref")))
    submit = F.col("kind") == "submit"
    events = p.select(F.col("event_id").alias("seq"), F.col("ts").alias("at"), "kind", F.when(submit, F.col("address")).alias("email"), F.when(submit, F.col("event_id").cast("string")).alias("rules"), F.when(F.col("ref").isNotNull() & ~submit, token).alias("token"))
    return s.applied(t.spark.createDataFrame([], s.STATE), events)


@query("m12_subscription_states", _EVENTS + " select user_id::varchar as email, arg_max(rules, rn)::varchar as rules, arg_max(coalesce(pending, -1), rn) as pending, arg_max(conf, rn) as confirmed, arg_max(gone, rn) as unsubscribed from r where made is not null group by 1")
def _(t):
    return _subscribed(t)[0].select("email", "rules", F.coalesce(F.col("pending").cast("long"), F.lit(-1)).alias("pending"), "confirmed", F.col("unsubscribed_at").isNotNull().alias("unsubscribed"))


@query("m12_subscription_outcomes", _EVENTS + " select seq, outcome from r where rn > 0")
def _(t):
    return _subscribed(t)[1].select("seq", "outcome")


@query("a28_first_references", "with p as (select l_partkey, arg_min(l_suppkey, l_orderkey * 100 + l_linenumber) as source, count(*) as n from lineitem group by 1) select source, count(*) as n_urls, sum(n)::bigint as n_references from p group by 1")
def _(t):
    place = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    told = F.when(place.isNotNull(), F.struct(place, "_metadata.file_path", "_metadata.row_index"))  # of rows at one place the first in the table
    return aggregates.first_references(t.lineitem.select(F.col("l_partkey").alias("url"), told.alias("pos"), F.col("l_suppkey").alias("source")))


@query("a22_retention", "select event_type as model, count(*) as calls, round(avg(event_id % 1000), 3) as mean_ms, sum(case when event_id % 4 = 0 then least(event_id % 9, 2) else 0 end)::bigint as dropped, round(100 * sum(event_id % 9 - case when event_id % 4 = 0 then least(event_id % 9, 2) else 0 end) / sum(event_id % 9), 2) as kept_pct from events group by 1")
def _(t):
    listed = F.col("event_id") % 9
    kept = listed - F.when(F.col("event_id") % 4 == 0, F.least(listed, F.lit(2))).otherwise(0)
    return aggregates.model_diagnostics(t.events.select(F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("ms"), listed.alias("listed"), kept.alias("kept")))


_BACKFILL = "with n as (select id, audience as old, case when title like '%3-%' then null when id % 2 = 0 then 'public' else audience end as new, id % 10 = 0 as by_hand from notices)"


def _backfill(t):
    computed = F.when(F.col("title").like("%3-%"), F.lit(None).cast("string")).when(F.col("id") % 2 == 0, "public").otherwise(F.col("audience"))
    return t.notices, F.col("audience"), computed, F.col("id") % 10 == 0


@query("m15_backfill_totals", _BACKFILL + " select count(*) as total, count(*) filter (where not by_hand and old is distinct from new) as changed, count(*) filter (where by_hand) as skipped from n")
def _(t):
    return merge.backfill_totals(*_backfill(t))


@query("m15_backfill_samples", _BACKFILL + " select id, old, new from n where not by_hand and old is distinct from new order by id limit 400")
def _(t):
    rows, old, new, by_hand = _backfill(t)
    return merge.backfill_samples(rows, "id", old, new, by_hand)


@query(
    "s10_budgets",
    """with b(source_id, max_bytes, timeout_ms) as (select 'S' || n_nationkey, case when n_nationkey % 2 = 0 then 4500 end, 60000 from nation where n_nationkey in (3, 6, 7)),
 f as (select url, chars, source_id from files join notices on id = notice_id)
 select url, coalesce(max_bytes, 3000)::bigint as max_bytes, coalesce(timeout_ms, 15000)::bigint as timeout_ms, max_bytes is not null as own_limit, case when chars > coalesce(max_bytes, 3000) then 'too_large' else 'ok' end as status from f left join b using (source_id)""",
)
def _(t):
    budgets = t.nation.where("n_nationkey in (3, 6, 7)").select(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("source_id"), F.when(F.col("n_nationkey") % 2 == 0, 4500).alias("max_bytes"), F.lit(60_000).alias("timeout_ms"))
    files = t.files.select("notice_id", "url", "chars").join(t.notices.select(F.col("id").alias("notice_id"), "source_id"), "notice_id")
    told = src.with_budgets(files, budgets, 3000)
    yes, no = F.lit(True), F.lit(False)
    status = src.attachment_status(yes, no, F.lit("pdf"), F.col("chars"), yes, F.lit("text"), F.lit(1), F.col("max_bytes"))
    return told.select("url", "max_bytes", "timeout_ms", "own_limit", status.alias("status"))
