"""Summaries, feeds and policies (P25-P33, F28-F69, T02-T07, X08-X11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import list_queries as lq
from ..functions import summaries as s, urls as u
from ..functions.channels import inferred_kind, merged_channels
from ..operators import feeds, windows as w
from .registry import query


def _k() -> F.Column:
    return F.col("id")


def _docs(t):
    """Notices with a stored summary: of several forms, broken every seventh, without one every fifth."""
    item = lambda text: F.struct(text.alias("text"), F.lit("q").alias("quote"))
    who = F.array(item(F.col("title")), item(F.when(_k() % 2 == 0, F.lit(" ")).otherwise(F.repeat(F.lit("x"), 301))))
    full = F.to_json(F.struct(F.col("title").alias("what"), who.alias("who"), F.array().cast("array<string>").alias("changes"), F.array().cast("array<string>").alias("impacts")))
    plain = F.to_json(F.struct(F.col("title").alias("what"), who.alias("who")))
    changed = F.to_json(F.struct(F.col("title").alias("what"), who.alias("who"), F.array().cast("array<string>").alias("changes")))
    doc = F.when(_k() % 7 == 0, F.lit("{broken")).when(_k() % 5 == 0, F.lit(None).cast("string")).when(_k() % 3 == 0, plain).when(_k() % 3 == 1, changed).otherwise(full)
    return t.notices.select("id", "title", "body", "status", "audience", "clicks", doc.alias("doc"))


_FORM = "case when id % 7 = 0 or id % 5 = 0 then 'none' when id % 3 = 0 then 'plain' when id % 3 = 1 then 'changes' else 'impacts' end"


@query("p33_template", f"select id, {_FORM} as form from notices")
def _(t):
    return _docs(t).select("id", s.template(F.when(_k() % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("doc"))).alias("form"))


@query("p26_redraft", "select id, case when status = 'closed' then 'closed' when clicks > 95 then 'manual' when id % 7 = 0 or id % 5 = 0 then 'unparseable' when id % 3 <> 2 then 'no impacts key' end as reason from notices")
def _(t):
    doc = F.when(_k() % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("doc"))
    return _docs(t).select("id", s.redraft_reason(doc, F.col("status"), F.col("clicks") > 95).alias("reason"))


@query("f34_normalized", "select id, 1 as kept, case when id % 2 = 0 then 1 else 0 end as empty, case when id % 2 = 0 then 0 else 1 end as too_long from notices where id % 7 <> 0 and id % 5 <> 0")
def _(t):
    docs = _docs(t).where("id % 7 <> 0 and id % 5 <> 0").withColumn("p", s.parsed(F.col("doc")))
    kept, tally = s.normalized(F.col("p.who"))
    return docs.select("id", F.size(kept).alias("kept"), tally.alias("t")).select("id", "kept", "t.empty", "t.too_long")


@query("f54_parsed", "select id, title as what from notices where id % 7 <> 0 and id % 5 <> 0")
def _(t):
    return _docs(t).where("id % 7 <> 0").select("id", s.parsed(F.col("doc"))["what"].alias("what")).where("what is not null")


@query("f39_display_state", "select id, case when summary is not null then 'shown' when summary_status = 'failed_review' then 'in review' when summary_status = 'pending' then case when clicks % 2 > 0 then 'coming' else 'waiting for files' end else 'none' end as state from notices")
def _(t):
    return t.notices.select("id", s.display_state(F.col("summary"), F.col("summary_status"), F.col("clicks") % 2).alias("state"))


@query("f38_provenance", "select id, list_extract(['final', 'upgradeable by draft', 'upgradeable by draft', 'upgradeable', 'upgradeable', 'fixed', 'unknown', 'unknown'], (id % 8)::int + 1) as state from notices")
def _(t):
    bases = F.array(*map(F.lit, ("draft", "explanation", "body_as_draft", "body", "title", "manual", "", None)))
    return t.notices.select("id", s.provenance(F.get(bases, (F.col("id") % 8).cast("int"))).alias("state"))


@query("f37_coverage", "select agency, case when count(*) = 0 then 'none' when count(*) = count(summary) then 'complete' else 'partial' end as coverage from notices group by 1")
def _(t):
    return t.notices.groupBy("agency").agg(F.count("*").alias("n"), F.count("summary").alias("m")).select("agency", s.coverage(F.col("n"), F.col("m")).alias("coverage"))


@query("f51_marks", "select id, list_filter([case when clicks % 3 > 0 then 'impacts' end, case when clicks % 2 > 0 then 'changes' end], lambda x: x is not null) as marks from notices")
def _(t):
    return t.notices.select("id", s.marks(F.col("clicks") % 3, F.col("clicks") % 2).alias("marks"))


@query("p30_gates", "select id, coalesce(audience = 'sector', false) as shows, concat_ws(': ', agency || ' (' || status || ')', title) as line from notices")
def _(t):
    return t.notices.select("id", s.shows_who(F.col("audience")).alias("shows"), s.impact_line(F.col("agency"), F.col("status"), F.col("title")).alias("line"))


@query("p27_independence", "select s_suppkey, case when s_nationkey % 4 = 0 then 'invalid address' when s_nationkey % 3 = 0 then 'same host' when s_suppkey % 2 = 0 then 'same key' end as reason from supplier")
def _(t):
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    a = F.when(n % 4 == 0, F.lit("not a url")).otherwise("https://a.example.org/v1")
    b = F.when(n % 3 == 0, "https://a.example.org/v2").otherwise("https://b.example.org/v1")
    return t.supplier.select("s_suppkey", s.independence(u.host(a), u.host(b), F.lit("k"), F.when(k % 2 == 0, "k").otherwise("m")).alias("reason"))


@query("f53_verdicts", "select event_id, case when event_id % 3 = 0 then null else 1 end as n from events")
def _(t):
    status = F.when(F.col("event_id") % 3 == 0, "odd").otherwise("kept")
    answer = F.concat(F.lit('I think: [{"quote":"a","status":"'), status, F.lit('"},{"quote":"b"}] so'))
    return t.events.select("event_id", F.when(s.verdicts(answer).isNotNull(), F.size(s.verdicts(answer))).alias("n"))


@query("f55_diagnostics", "select event_id, concat_ws('; ', event_type, case when event_id % 4 > 0 then (event_id % 4) || ' dropped' end) as line from events")
def _(t):
    return t.events.select("event_id", s.diagnostics_line(F.col("event_type"), F.lit(None).cast("double"), F.col("event_id") % 4).alias("line"))


@query("f56_budgeted", "select doc_id, substr(coalesce(source, '') || chr(10) || text, 1, 0) as nothing, substr(source, 1, 600) || chr(10) || substr(text, 1, 600 - length(source)) as prompt from documents where length(text) > 0")
def _(t):
    return t.documents.where("length(text) > 0").select("doc_id", F.lit("").alias("nothing"), s.budgeted(F.array("source", "text"), 600).alias("prompt"))


@query("f60_codec", "select id, title, agency from notices")
def _(t):
    token = s.encoded(F.struct("title", "agency"))
    return t.notices.select("id", s.decoded(token, "title string, agency string").alias("d")).select("id", "d.title", "d.agency")


@query("f69_usage", "select event_id, greatest(event_id - 100, 0) as prompt, 0::bigint as completion from events")
def _(t):
    doc = F.concat(F.lit('{"prompt_tokens":'), (F.col("event_id") - 100).cast("string"), F.lit("}"))
    return t.events.select("event_id", s.usage(doc).alias("u")).select("event_id", "u.prompt", "u.completion")


@query("f64_client_key", "select event_id, case when event_id % 2 = 0 then '10.0.0.' || (event_id % 9) else 'r' || user_id end as client from events")
def _(t):
    forwarded = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" 10.0.0."), (F.col("event_id") % 9).cast("string"), F.lit(", 1.2.3.4")))
    return t.events.select("event_id", s.client_key(forwarded, F.concat(F.lit("r"), F.col("user_id").cast("string"))).alias("client"))


@query("f46_probe", "select id, case when id % 3 = 0 then title when id % 3 = 1 then substr('On ' || title, 1, 10) else '《abc》 of i' end as probe from notices")
def _(t):
    third = F.col("id") % 3
    title = F.when(third == 0, F.concat(F.lit("On 《"), "title", F.lit("》 and more"))).when(third == 1, F.concat(F.lit("On "), "title")).otherwise("《abc》 of it")
    return t.notices.select("id", s.probe_term(title).alias("probe"))


@query("f61_reminder_phrases", "select id, case when deadline - date '1998-06-01' = 0 then 'closes today' when deadline - date '1998-06-01' < 7 then 'catching up: ' || (deadline - date '1998-06-01') || ' days left' else (deadline - date '1998-06-01') || ' days left' end as phrase from notices where deadline >= date '1998-06-01'")
def _(t):
    days = F.datediff("deadline", F.lit("1998-06-01").cast("date"))
    return t.notices.where(days >= 0).select("id", s.reminder_note(F.lit("d7"), days).alias("phrase"))


@query(
    "f28_change_counts",
    """select id, (id % 3)::int as n_added, (id % 2)::int as n_removed, (case when id % 5 = 0 then 2 else 0 end)::int as n_modified from notices""",
)
def _(t):
    key = F.col("id")
    parts = [F.when(key % 3 == 1, F.lit("新增一条。")).when(key % 3 == 2, F.lit("A NEW rule; 增加两款。")), F.when(key % 2 == 1, F.lit("Rule 3 is deleted.")), F.when(key % 5 == 0, F.lit("Rule 4 is Amended, rule 5 调整。"))]
    return t.notices.select("id", *s.change_counts(F.concat_ws(" ", *parts)))


@query(
    "t06_change_table",
    """with n as (select id, body, (id % 9 + 1)::int as a, (id % 5 + 1)::int as b from notices),
 r as (select id, 0 as pos, case when id % 2 = 0 then 'described' else 'fact' end as type, case when id % 2 = 0 then 0 end as change, case when id % 2 = 1 then '第' || a || '条' end as clause, case when id % 2 = 1 then ['modified'] end as kinds, case when id % 2 = 1 then ['修改'] end as marks, '（一）第' || a || '条修改为“' || body || '”。' as sentence from n
 union all select id, 1, 'fact', null, '第二条第一款', ['removed'], ['删除'], '（二）删除第二条第一款。' from n
 union all select id, 2, 'fact', null, '第' || b || '条', ['added', 'modified'], ['增加', '调整'], '增加一款并调整顺序，作为第' || b || '条' from n
 union all select id, 3, 'described', 0, null, null, null, null from n where id % 2 = 1
 union all select id, 3 + (id % 2)::int, 'described', 1, null, null, null, null from n)
 select id, pos, type, change, clause, kinds, marks, sentence from r""",
)
def _(t):
    from ..operators.change_table import change_table

    numbered = lambda k: ((F.col("id") % k + 1).cast("int")).cast("string")
    first = F.concat(F.lit("（一）第"), numbered(9), F.lit("条修改为“"), "body", F.lit("”。"))
    text = F.concat(F.lit("一、对部分条文作以下修改：\n"), first, F.lit("\n（二）删除第二条第一款。普通的一句。\n增加一款并调整顺序，作为第"), numbered(5), F.lit("条"))
    quote = F.when(F.col("id") % 2 == 0, F.concat(F.lit("修改为\u3000\""), F.replace("body", F.lit(" "), F.lit("\n  ")), F.lit('"')))
    return change_table(t.notices.select("id", text.alias("text"), F.array(quote, F.lit("不在文中的一段引文，足够长")).alias("quotes")))


@query("u04_merged_channels", "select id, case when agency = agencies[1] then [agency, status] else [] end as merged from notices")
def _(t):
    return t.notices.select("id", merged_channels(F.array("agency", "status"), F.array(F.upper("status"), F.lit(" "), F.col("agency"))).alias("merged"))


@query("f52_kinds", "select page_id, list_extract(['url', 'email', 'phone', 'address', 'phone', 'address'], (page_id % 6)::int + 1) as kind from pages")
def _(t):
    values = F.array(F.col("url"), *map(F.lit, ("desk@office.example.org", "+86 (10) 1234-5678", "12 Long Road, Hall 3", "010-12345", "12345")))
    return t.pages.select("page_id", inferred_kind(F.get(values, (F.col("page_id") % 6).cast("int"))).alias("kind"))


def _ranked_files(t):
    from pyspark.sql import Window

    one = t.files.where("status = 'ok'").select("notice_id", "name", (F.col("chars") * 10).alias("chars")).distinct()
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("notice_id").orderBy("name", "chars")))


@query("t07_feed_plan", "select id as notice_id, '(body)' as name, least(length(body), 20000)::bigint as given from notices where id % 3 = 0 and id not in (select notice_id from files where status = 'ok')")
def _(t):
    audiences = t.notices.select(F.col("id").alias("notice_id"), "audience", (_k() % 3 == 0).alias("body_is_draft"), F.length("body").cast("long").alias("body_chars"))
    return feeds.feed_plan(_ranked_files(t), audiences).where("name = '(body)'")


@query(
    "t07_feed_within_budget",
    "select notice_id, sum(chars * 10) <= case when any_value(audience) = 'sector' then 40000 else 20000 end as whole, false as over from (select distinct notice_id, name, chars from files where status = 'ok') f left join notices n on n.id = notice_id group by 1",
)
def _(t):
    audiences = t.notices.select(F.col("id").alias("notice_id"), "audience", F.lit(False).alias("body_is_draft"), F.lit(0).cast("long").alias("body_chars"))
    plan = feeds.feed_plan(_ranked_files(t), audiences)
    budget = F.when(F.col("audience") == "sector", 40_000).otherwise(20_000)
    chars = _ranked_files(t).groupBy("notice_id").agg(F.sum("chars").alias("chars"))
    given = plan.groupBy("notice_id").agg(F.sum("given").alias("given")).join(chars, "notice_id").join(audiences, "notice_id", "left")
    return given.select("notice_id", (F.col("given") == F.col("chars")).alias("whole"), (F.col("given") > budget).alias("over"))


_BROKEN = """with i as (select *, sum(ok::int) over (partition by source_id order by seq rows unbounded preceding) as island from run_log),
 r as (select source_id, seq, case when ok then 0 else count(*) filter (where not ok) over (partition by source_id, island order by seq rows unbounded preceding) end as run from i)
 select source_id as batch, seq, coalesce(max((run >= 3)::int) over (partition by source_id order by seq rows between unbounded preceding and 1 preceding), 0) = 1 as skipped from r"""


@query("x08_circuit", _BROKEN)
def _(t):
    attempts = t.run_log.select(F.col("source_id").alias("batch"), "seq", (~F.col("ok")).alias("failed"))
    return feeds.circuit_broken(attempts).select("batch", "seq", "skipped")


@query(
    "x09_host_policy",
    """with recursive e as (select source_id::varchar as host, "at", seq, not ok as refused, row_number() over (partition by source_id order by "at", seq) as rn from run_log),
 r as (select host, rn, seq, "at" as last, refused::int as refusals, null::varchar as reason from e where rn = 1 union all
 select host, rn, seq, case when reason is null then "at" else last end, case when reason is not null then refusals when refused then refusals + 1 else 0 end, reason
 from (select e.*, r.last, r.refusals, case when r.refusals >= 3 then 'tripped' when e."at" - r.last < interval 1 hour then 'too early' end as reason from r join e on e.host = r.host and e.rn = r.rn + 1))
 select host, seq, reason is null as allowed, reason from r""",
)
def _(t):
    requests = t.run_log.select(F.col("source_id").cast("string").alias("host"), "seq", F.col("at").alias("at"), (~F.col("ok")).alias("refused"))
    return feeds.host_policy(requests, gap_seconds=3600.0)


@query("x11_round_limits", "with f as (select notice_id, url, fetched_at from files where status = 'pending' order by fetched_at, notice_id, url limit 120), n as (select notice_id from (select notice_id, row_number() over (order by min(fetched_at), notice_id) as r from f group by 1) where r <= 60) select f.notice_id, f.url from f join n using (notice_id)")
def _(t):
    due = t.files.where("status = 'pending'").select("notice_id", "url", "fetched_at")
    return feeds.round_limited(due, 120, 60).select("notice_id", "url")


@query("j20_relinked", "with c as (select id, title, case when id % 100 = 0 then 'NATION_1' else agency end as agency, published from notices), k as (select distinct title, agency from notices where id % 100 = 0 union select distinct title, 'NATION_1' from notices where id % 100 = 0) select id, lag(id) over (partition by title, agency order by published nulls last, id) as version_of, row_number() over (partition by title, agency order by published nulls last, id) as version_seq from c where exists (select 1 from k where k.title = c.title and k.agency = c.agency)")
def _(t):
    n = t.notices.select("id", F.col("title").alias("title_key"), "agency", "published")
    moved = F.col("id") % 100 == 0  # these go to another agency
    keys = n.where(moved).select("title_key", F.explode(F.array("agency", F.lit("NATION_1"))).alias("agency")).distinct()
    now = n.withColumn("agency", F.when(moved, "NATION_1").otherwise(F.col("agency")))
    return w.version_chain(now.join(keys, ["title_key", "agency"], "left_semi")).select("id", "version_of", "version_seq")


@query("p29_sent_before", "select id from notices where exists (select 1 from clicks c where c.notice_id = notices.id)")
def _(t):
    return t.notices.join(t.clicks.select(F.col("notice_id").alias("id")), "id", "left_semi").select("id")


_ASKED = """with a as (select o_orderkey as id, ['public', 'all', 'sector', ''][(o_orderkey % 4)::int + 1] as audience, case when o_orderkey % 3 = 0 then '  数据 & more ' end as q, strftime(o_orderdate, '%Y-%m') as m, strftime(o_orderdate + to_days(((o_orderkey % 5) * 40 - 60)::int), '%Y-%m') as n, ['7', '999', '30'][(o_orderkey % 3)::int + 1] as since, ['clicks', 'deadline', 'other'][(o_orderkey // 3 % 3)::int + 1] as sort, (o_orderkey % 3)::varchar as page from orders),
 v as (select id, case when audience in ('public', 'sector') then audience end as audience, case when m > n then null when id % 7 > 0 then m end as f, case when m > n and id % 7 > 0 then null else n end as t, trim(q) as q, case when since <> '999' then since end as since, case when sort = 'clicks' then sort end as sort, case when page = '2' then page end as page from a)"""


def _asked(t):
    key = F.col("o_orderkey")
    pick = lambda k, values: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    month = F.date_format("o_orderdate", "yyyy-MM")
    args = F.create_map(
        F.lit("audience"), pick(key, ("public", "all", "sector", "")), F.lit("q"), F.coalesce(F.when(key % 3 == 0, "  数据 & more "), F.lit("  ")), F.lit("from"), F.when(key % 7 == 0, "1996-13").otherwise(month),
        F.lit("to"), F.date_format(F.date_add(F.to_date("o_orderdate"), ((key % 5) * 40 - 60).cast("int")), "yyyy-MM"), F.lit("since"), pick(key, ("7", "999", "30")), F.lit("sort"), pick(F.floor(key / 3), ("clicks", "deadline", "other")), F.lit("page"), (key % 3).cast("string"),
    )
    return t.orders.select(key.alias("id"), lq.parsed(args).alias("query"))


@query("f48_description", _ASKED + " select id, coalesce(nullif(concat_ws('; ', 'audience ' || audience, 'from ' || f, 'to ' || t, 'text ' || q, 'days ' || since), ''), 'all notices') as says from v")
def _(t):
    return _asked(t).select("id", lq.described(F.col("query")).alias("says"))


@query("p22_canonical", _ASKED + " select id, coalesce('/?' || nullif(concat_ws('&', 'audience=' || audience, 'from=' || f, 'to=' || t, 'q=' || replace(replace(replace(q, '&', '%26'), ' ', '+'), '数据', '%E6%95%B0%E6%8D%AE'), 'since=' || since, 'sort=' || sort, 'page=' || page), ''), '/') as address from v")
def _(t):
    return _asked(t).select("id", lq.canonical(F.col("query")).alias("address"))


_FED = "with f as (select notice_id, name, any_value(chars * 10)::bigint as chars, any_value(chars) % 3 = 0 as cut, any_value(chars) % 5 = 0 as starved from (select distinct notice_id, name, chars from files where status = 'ok') group by 1, 2), s as (select id, count(name) as n, count(name) filter (where not starved) as fed, coalesce(sum(chars) filter (where not starved), 0)::bigint as chars, count(name) filter (where cut and not starved) as cut from notices left join f on notice_id = id group by 1)"


@query(
    "f58_gap_attribution",
    _FED + """, i as (select *, case when n = 0 then 'nothing was fed' when fed = 0 then n || ' sources were read, none was fed' else n || ' sources were read, ' || chars || ' characters fed' || case when cut = 0 and fed = n then ', each of them whole' else case when cut > 0 then ', ' || cut || ' in part' else '' end || case when fed < n then ', ' || (n - fed) || ' not at all' else '' end end end as told from s)
 select id, case when id % 11 = 0 then 'no record of what was fed' when cut > 0 or fed < n then told || '; the gap may lie in what was not fed, or in what the model left out' else told || '; the gap lies in what the model left out' end as told from i""",
)
def _(t):
    from ..functions.rules import gap_attribution

    files = t.files.where("status = 'ok'").select("notice_id", "name", "chars").distinct()
    source = F.struct((F.col("chars") * 10).cast("long").alias("chars"), (F.col("chars") % 3 == 0).alias("cut"), (F.col("chars") % 5 == 0).alias("starved"))
    fed = files.groupBy("notice_id").agg(F.collect_list(source).alias("sources"))
    rows = t.notices.select("id").join(fed, F.col("id") == F.col("notice_id"), "left")
    sources = F.when(F.col("id") % 11 != 0, F.coalesce("sources", F.array().cast("array<struct<chars:bigint,cut:boolean,starved:boolean>>")))
    return rows.select("id", gap_attribution(sources).alias("told"))


@query(
    "f49_guidance",
    """with f as (select notice_id, count(*) as files, count(*) filter (where status = 'ok') as readable from files group by 1), n as (select id, id % 4 = 0 as shown, case when id % 5 = 0 then 0 else length(body) end as chars, coalesce(files, 0) as files, coalesce(readable, 0) as readable from notices left join f on notice_id = id)
 select id, case when not shown then case when chars > 0 then 'not in the text' else 'no text' end end as reason, case when not shown then case when files = 0 then 'none' when readable > 0 then 'readable' else 'unreadable' end end as files from n""",
)
def _(t):
    from ..functions.rules import guidance

    per = t.files.groupBy("notice_id").agg(F.count("*").alias("n_files"), F.count_if(F.col("status") == "ok").alias("n_readable"))
    rows = t.notices.select("id", F.when(F.col("id") % 5 == 0, 0).otherwise(F.length("body")).alias("chars")).join(per, F.col("id") == F.col("notice_id"), "left")
    return rows.select("id", guidance(F.col("id") % 4 == 0, F.col("chars"), F.coalesce("n_files", F.lit(0)), F.coalesce("n_readable", F.lit(0))).alias("g")).select("id", "g.*")


@query("t02_comparability", "select b.id, case when a.id is null or b.id % 6 = 0 then 'missing' when a.id % 2 = 0 and b.id % 3 = 0 then 'comparable' when a.id % 2 = 0 or b.id % 3 = 0 then 'one side' else 'no drafts' end as verdict from notices b left join notices a on a.id = b.id - 501")
def _(t):
    from ..operators.diff import comparability

    old = t.notices.select((F.col("id") + 501).alias("id"), F.lit(True).alias("has_old"), (F.col("id") % 2 == 0).alias("old_draft"))
    pairs = t.notices.select("id", (F.col("id") % 6 != 0).alias("has_new"), (F.col("id") % 3 == 0).alias("new_draft")).join(old, "id", "left")
    known = lambda c: F.coalesce(c, F.lit(False))
    return pairs.select("id", comparability(known("has_old"), F.col("has_new"), known("old_draft"), F.col("new_draft")).alias("verdict"))


@query(
    "f36_quoted_tally",
    """with l as (select conv_id, turn, role, text, case when turn % 2 = 0 then substr(text, 11, 40) else reverse(substr(text, 11, 40)) end as quote from conversations where length(text) >= 60),
 q as (select *, regexp_replace(quote, '[\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', '', 'g') as bare, regexp_replace(text, '[\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', '', 'g') as flat from l where not regexp_matches(quote, '["“”„‟«»「」『』〝〞＂…]|[.][.][.]')),
 k as (select conv_id, role, turn, quote, length(bare) >= 8 and contains(flat, bare) as held from q)
 select conv_id, role as section, count(*) filter (where held) as kept, count(*) filter (where not held) as dropped, coalesce(string_agg(quote, chr(10) order by turn) filter (where held), '') as text from k group by 1, 2""",
)
def _(t):
    from ..operators.matching import quoted_summaries

    long = t.conversations.where("length(text) >= 60")
    piece = F.substring("text", 11, 40)
    items = long.select(F.struct("conv_id", "turn").alias("source"), F.col("conv_id").alias("id"), F.col("role").alias("section"), F.col("turn").alias("place"), F.when(F.col("turn") % 2 == 0, piece).otherwise(F.reverse(piece)).alias("quote"))
    items = items.where(~F.col("quote").rlike('["“”„‟«»「」『』〝〞＂…]|[.][.][.]')).withColumn("text", F.col("quote"))
    return quoted_summaries(items, long.select(F.struct("conv_id", "turn").alias("source"), "text")).withColumnRenamed("id", "conv_id")
