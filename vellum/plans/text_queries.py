"""Scalar functions, search and text operators (F, K, T, and A24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import channels as ch, dates as d, text as x, urls as u
from ..operators import diff, matching, search as se
from ..sources import html
from ..sources.paths import shared_folder
from .registry import query
from .views import TODAY


@query("f01_date_in", "select o_orderkey, o_orderdate::date as day from orders where o_orderkey % 7 <> 0 union all select o_orderkey, null from orders where o_orderkey % 7 = 0", dates="day")
def _(t):
    text = F.when(F.col("o_orderkey") % 7 == 0, F.lit("until 2021-02-30")).when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "'on 'yyyy/M/d' at')")).otherwise(F.date_format("o_orderdate", "'于'yyyy'年'M'月'd'日截止'"))
    return t.orders.select("o_orderkey", d.date_in(text).alias("day"))


@query("f02_day_difference", "select id, deadline - published as days from notices")
def _(t):
    return t.notices.select("id", F.datediff("deadline", "published").alias("days"))


@query("f03_site_day", "select event_id, (ts + interval 8 hour)::date as day, strftime(ts + interval 8 hour, '%Y-%m') as month from events", dates="day")
def _(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", d.site_day(ts).alias("day"), d.site_month(ts).alias("month"))


@query(
    "f04_countdown",
    f"""select id, l as days, case when l is null then 'none' when l < 0 then 'past' when l = 0 then 'today' when l <= 3 then 'urgent' when l <= 7 then 'soon' else 'later' end as urgency,
 case when l is null then 'no deadline' when l < 0 then 'closed' when l = 0 then 'closes today' else l || ' days left' end as says from (select id, deadline - date '{TODAY}' as l from notices)""",
)
def _(t):
    dl = F.col("deadline")
    return t.notices.select("id", d.days_left(dl, TODAY).alias("days"), d.urgency(dl, TODAY).alias("urgency"), d.countdown(dl, TODAY).alias("says"))


@query("f05_last_months", "select o_orderkey, list_transform([3, 2, 1, 0], lambda i: strftime(date_trunc('month', o_orderdate) - to_months(i::int), '%Y-%m')) as months from orders")
def _(t):
    return t.orders.select("o_orderkey", d.last_months(F.to_date("o_orderdate"), 4).alias("months"))


@query("f06_millis_day", "select event_id, strftime(epoch_ms(1704067200000 + event_id * 60000), '%Y-%m-%d') as day from events")
def _(t):
    return t.events.select("event_id", d.day_of_millis(F.lit(1704067200000) + F.col("event_id") * 60000).alias("day"))


@query("f07_deadline_in", "select o_orderkey, o_orderdate::date as day from orders", dates="day")
def _(t):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("deadline: 2021-13-45, comments by "), F.date_format("o_orderdate", "yyyy-MM-dd"))).otherwise(F.date_format("o_orderdate", "'deadline: 'yyyy.M.d"))
    return t.orders.select("o_orderkey", d.deadline_in(text, [r"deadline: \S+", r"comments by \S+"]).alias("day"))


@query("f10_agencies", "select id, case when agencies[2] = 'BUILDING' then [agency, 'Ministry of Building'] else [agency, agencies[2]] end as parts from notices")
def _(t):
    from ..functions.classify import agencies_of

    raw = F.concat_ws("、", "agency", F.element_at("agencies", 2), "agency")
    return t.notices.select("id", agencies_of(raw, {"BUILDING": "Ministry of Building"}).alias("parts"))


@query("f11_block_text")
def _(t):
    return t.pages.select("page_id", html.block_text(F.col("html")).alias("text"))


@query("f12_attachments")
def _(t):
    return t.pages.select("page_id", html.attachments(F.regexp_replace("html", 'href="/([^"]*)"', 'href="/$1.pdf"'), F.col("url")).alias("files"))


@query("f13_resolved", "select page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || '/a/b.html' as link from pages")
def _(t):
    return t.pages.select("page_id", u.resolved(F.col("url"), F.lit("/a/b.html")).alias("link"))


_WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query("f14_collapsed", f"select doc_id, trim(regexp_replace(text, '{_WS}+', ' ', 'g')) as text from documents")
def _(t):
    return t.documents.select("doc_id", x.collapsed(F.col("text")).alias("text"))


@query("f21_cjk", r"select doc_id, len(regexp_extract_all(text || '条例草案', '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]')) as n from documents")
def _(t):
    return t.documents.select("doc_id", x.cjk_count(F.concat("text", F.lit("条例草案"))).alias("n"))


@query("f26_fingerprint", f"""select doc_id, regexp_replace(regexp_replace(translate('“' || text || '”', '“”', '""'), '{_WS}+', '', 'g'), '^"+|"+$', '', 'g') as fp from documents""")
def _(t):
    return t.documents.select("doc_id", x.fingerprint(F.concat(F.lit("“"), "text", F.lit("”"))).alias("fp"))


@query(
    "f27_segments_in_order",
    f"""with f as (select doc_id, regexp_replace(text, '{_WS}+', '', 'g') as flat from documents),
 p as (select doc_id, flat, case when doc_id % 2 = 0 then substr(flat, 5, 20) else substr(flat, 40, 20) end as a, case when doc_id % 2 = 0 then substr(flat, 40, 20) else substr(flat, 5, 20) end as b from f where length(flat) >= 60)
 select doc_id, strpos(flat, a) > 0 and strpos(substr(flat, strpos(flat, a) + 20), b) > 0 as held from p where not regexp_matches(a || b, '["“”„‟«»「」『』〝〞＂…]|[.][.][.]')""",
)
def _(t):
    # two pieces of a text, in their order or the other way round
    docs = t.documents.select("doc_id", x.stripped(F.col("text")).alias("flat")).where(F.length("flat") >= 60)
    parts = F.substring("flat", 5, 20), F.substring("flat", 40, 20)
    even = F.col("doc_id") % 2 == 0
    docs = docs.select("doc_id", "flat", F.when(even, parts[0]).otherwise(parts[1]).alias("a"), F.when(even, parts[1]).otherwise(parts[0]).alias("b"))
    docs = docs.where(~F.concat("a", "b").rlike('["“”„‟«»「」『』〝〞＂…]|[.][.][.]'))
    return docs.select("doc_id", x.contains_in_order(F.col("flat"), x.segments(F.concat("a", F.lit("……"), "b"))).alias("held"))


@query("f29_sentences", "select doc_id, len(list_filter(string_split(regexp_replace(replace(replace(text, '. ', '。'), ', ', '；'), '([。；])', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s) <> '')) as n from documents")
def _(t):
    marked = F.replace(F.replace("text", F.lit(". "), F.lit("。")), F.lit(", "), F.lit("；"))
    return t.documents.select("doc_id", F.size(x.sentences(marked)).alias("n"))


@query("f31_channels")
def _(t):
    return ch.channels(t.documents.select(F.col("doc_id").alias("id"), "text"))


@query(
    "f40_neighborhood",
    r"""with d as (select doc_id, text, trim(regexp_replace(substr(text, 500, 40), '\s+', ' ', 'g')) as piece from documents where length(text) > 800),
 q as (select doc_id, text, piece, strpos(text, piece) as place from d where not contains(text, '"') and not regexp_matches(piece, '[.]{3}|…') and length(replace(piece, ' ', '')) >= 8 and strpos(regexp_replace(text, '\s+', '', 'g'), replace(piece, ' ', '')) = length(regexp_replace(substr(text, 1, strpos(text, piece) - 1), '\s+', '', 'g')) + 1 and strpos(text, piece) > 0)
 select doc_id, substr(text, greatest(place - 50, 1), place - greatest(place - 50, 1) + length(piece) + 50) as around from q""",
)
def _(t):
    """Quotations with other white space and marks than their text has."""
    from ..functions.positions import neighborhood

    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    piece = F.trim(F.regexp_replace(F.substring("text", 500, 40), r"\s+", " "))
    d = t.documents.where("length(text) > 800").withColumn("piece", piece).withColumn("at", F.call_function("locate", "piece", "text"))
    d = d.where(~F.contains("text", F.lit('"')) & ~F.col("piece").rlike(r"[.]{3}|…") & (F.length(bare("piece")) >= 8) & (F.col("at") > 0))
    d = d.where(F.call_function("locate", bare("piece"), bare("text")) == F.length(bare(F.substr("text", F.lit(1), F.col("at") - 1))) + 1)
    quote = F.concat(F.lit("“"), F.replace("piece", F.lit(" "), F.lit(" \u3000\n")), F.lit("」"))
    return d.select("doc_id", neighborhood(F.col("text"), quote, 50).alias("around"))


@query("f25_excerpt", "select doc_id, length(text) > 600 as cut, case when length(text) <= 600 then text end as whole from documents")
def _(t):
    from ..functions.excerpts import excerpt

    made = t.documents.select("doc_id", F.length("text").alias("n"), excerpt(F.col("text"), ("licens", "version", "the ", " de "), 600, 60).alias("e"))
    return made.select("doc_id", ((F.col("n") > 600) & (F.length("e") <= 600)).alias("cut"), F.when(F.col("n") <= 600, F.col("e")).alias("whole"))


@query(
    "f41_alternate_hosts",
    r"""with h as (select distinct host from (select regexp_extract(url, '^https?://([^/:?#]+)', 1) as host from pages union all select 'files.' || regexp_extract(url, '^https?://([^/:?#]+)', 1) from pages where page_id % 2 = 0)),
 k as (select host, string_split(host, '.') as p from h where len(string_split(host, '.')) >= 3), s as (select host, array_to_string(list_slice(p, len(p) - 2, len(p)), '.') as site from k),
 n as (select site, count(*) as n, min(host) as first from s group by 1)
 select host, first, n from s join n using (site) where n > 1""",
)
def _(t):
    """Hosts with alternates, by the first host of their site and the site's number of hosts: no pairs."""
    name = F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    hosts = t.pages.select(name.alias("host")).unionByName(t.pages.where("page_id % 2 = 0").select(F.concat(F.lit("files."), name).alias("host"))).distinct()
    return u.host_sites(hosts)


@query(
    "f41_candidates",
    """with u as (select page_id, url as page, case page_id % 3 when 0 then 'https://files.' || regexp_extract(url, '^https?://([^/:]+)', 1) || '/f/' || page_id || '.pdf?v=1' when 1 then regexp_extract(url, '^(https?://[^/]+)', 1) || '/f/' || page_id || '.pdf' else 'https://files.else.example/f.pdf' end as file from pages),
 h as (select *, regexp_extract(url, '^https?://([^/:]+)', 1) as host from (select page_id, page as url, file from u))
 select page_id, case when page_id % 3 = 0 and len(string_split(host, '.')) >= 3 then [file, regexp_extract(url, '^(https?://[^/]+)', 1) || '/f/' || page_id || '.pdf?v=1'] else [file] end as candidates from h""",
)
def _(t):
    origin, host, key = F.regexp_extract("url", "^(https?://[^/]+)", 1), u.host(F.col("url")), F.col("page_id").cast("string")
    file = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://files."), host, F.lit("/f/"), key, F.lit(".pdf?v=1"))).when(F.col("page_id") % 3 == 1, F.concat(origin, F.lit("/f/"), key, F.lit(".pdf"))).otherwise("https://files.else.example/f.pdf")
    return t.pages.select("page_id", u.candidates(file, F.col("url")).alias("candidates"))


@query("f42_sanitized", r"select doc_id, substr(regexp_replace(text, '[\x00-\x08\x0B-\x1F\x7F-\x{9F}]', '', 'g'), 1, 200000) as text from documents")
def _(t):
    return t.documents.select("doc_id", x.sanitized(F.col("text")).alias("text"))


@query("f44_error_kind", "select event_id, list_extract(['quota', 'quota', 'timeout', 'timeout', 'other', 'quota', 'other'], (event_id % 7)::int + 1) as kind from events")
def _(t):
    from ..functions.summaries import error_kind

    messages = F.array(*map(F.lit, ("HTTP 429: Rate limit", "insufficient BALANCE", "connect ETIMEDOUT", "The request timed out", "HTTP 500", "quota exceeded, time out", "rating 42")))
    return t.events.select("event_id", error_kind(F.get(messages, (F.col("event_id") % 7).cast("int"))).alias("kind"))


@query("f63_clean_quote", "select conv_id, turn, case when length(trim(text)) between 1 and 300 then trim(text) end as quote from conversations where not contains(text, '\"')")
def _(t):
    return t.conversations.where(~F.contains("text", F.lit('"'))).select("conv_id", "turn", x.clean_quote(F.col("text")).alias("quote"))


@query("f65_short_key", "select page_id, coalesce(nullif(regexp_extract(url, '#(.*)$', 1), ''), nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+?)(\\.[A-Za-z0-9]+)?/?$', 1), '')) as key from pages where regexp_matches(url, '^https?://[^/]+/')")
def _(t):
    return t.pages.where(F.col("url").rlike("^https?://[^/]+/")).select("page_id", u.short_key(F.col("url")).alias("key"))


@query("f66_notice_id", "select page_id, substr(sha256(url), 1, 16) as id from pages")
def _(t):
    return t.pages.select("page_id", u.notice_id(F.col("url")).alias("id"))


@query("s14_may_fetch", "select page_id, regexp_matches(url, '^https?://') as ok from pages")
def _(t):
    return t.pages.select("page_id", u.may_fetch(F.col("url")).alias("ok"))


@query("f67_description", "select id, concat_ws(' · ', status, deadline::varchar, agency, substr(body, 1, 120)) as line from notices")
def _(t):
    return t.notices.select("id", F.concat_ws(" · ", "status", F.col("deadline").cast("string"), "agency", F.substring("body", 1, 120)).alias("line"))


@query("f68_escaped", """select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as safe from pages""")
def _(t):
    return t.pages.select("page_id", x.escaped_html(F.col("html")).alias("safe"))


_TERMS = "unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))"


@query(
    "k02_search",
    f"""with terms as (select doc_id as id, {_TERMS} as term from documents), sizes as (select id, count(*) as doc_len from terms group by 1),
 st as (select count(*) as n, avg(doc_len) as mean from sizes), per as (select id, w, count(*) as tf from terms join (values ('licensed'), ('version')) q(w) on starts_with(term, w) group by 1, 2),
 df as (select w, count(*) as df from per group by 1)
 select id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * doc_len / mean))), 6) as score
 from per join df using (w) join sizes using (id), st group by id having count(*) = 2 order by score desc, id limit 20""",
)
def _(t):
    index = se.SearchIndex(t.spark, shared_folder(t.spark, "search-index"))
    index.rebuild(t.documents.select(F.col("doc_id").alias("id"), "text"))
    return index.search("licensed version")[1]


@query("k02_match_set", "select doc_id as id from documents where regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])licensed') and regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])version')")
def _(t):
    return se.matched(se.postings(t.documents.select(F.col("doc_id").alias("id"), "text")), "licensed version")


@query(
    "m22_index_writes",
    f"""with now as (select doc_id as id, case when doc_id % 10 = 0 then 'revised edition ' || coalesce(text, '') else text end as text from documents where doc_id % 7 <> 0),
 terms as (select id, {_TERMS} as term from now)
 select id, count(*) as doc_len, count(distinct term) as n_terms from terms group by 1""",
)
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    revised = F.concat(F.lit("revised edition "), F.coalesce("text", F.lit("")))
    index = se.SearchIndex(t.spark, shared_folder(t.spark, "search-index"))
    index.index(docs)
    edits = docs.where("id % 10 = 0").select("id", F.explode(F.array(F.struct(F.lit(2).alias("at"), revised.alias("text")), F.struct(F.lit(1).alias("at"), F.lit("an edit before the last").alias("text")))).alias("e")).select("id", "e.*")
    index.index(edits, order="at")
    index.remove(docs.where("id % 7 = 0"))
    index.merge()
    return index.postings().groupBy("id").agg(F.first("doc_len").cast("long").alias("doc_len"), F.count("*").alias("n_terms"))


@query(
    "k07_self_retrieval",
    r"""with titled as (select id, lower(title || ' ' || body) as text, lower(title) as probe from notices),
 terms as (select id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) as term from titled), sizes as (select id, count(*) as doc_len from terms group by 1), st as (select count(*) as n, avg(doc_len) as mean from sizes),
 pieces as (select distinct id as q, piece from (select id, unnest(regexp_extract_all(probe, '[\p{L}\p{N}]+')) as piece from titled where id % 6 = 0)), asked as (select q, count(*) as n_pieces from pieces group by 1),
 served as (select piece, term from (select distinct piece from pieces) join (select distinct term from terms) on starts_with(term, piece)),
 per as (select piece, id, count(*) as tf from terms join served using (term) group by all), df as (select piece, count(*) as df from per group by 1),
 scored as (select q, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * doc_len / mean))), 6) as score from pieces join per using (piece) join df using (piece) join sizes using (id) join asked using (q), st group by q, id, n_pieces having count(*) = n_pieces),
 ranked as (select q, id, row_number() over (partition by q order by score desc, id) as r from scored)
 select q as id, coalesce(bool_or(r.id = q and r <= 20), false) as found from (select q from asked) left join ranked r using (q) group by q""",
)
def _(t):
    n = t.notices.select("id", "title", F.concat_ws(" ", "title", "body").alias("text"))
    index = se.SearchIndex(t.spark, shared_folder(t.spark, "search-index"))
    index.rebuild(n.select("id", "text"))
    return se.self_retrieval(index.postings(), n.where("id % 6 = 0").select("id", F.col("title").alias("probe")), *index.statistics())


@query(
    "k02_phrase",
    """with titled as (select o_orderkey as id, list_extract(['公开征求意见的通知', '意见征求公开', '关于food安全标准的通告', 'food safety 意见', '征求 意见'], (o_orderkey % 5)::int + 1) || ' ' || o_orderkey as text from orders)
 select id from titled where contains(text, '意见') and contains(text, '征求')""",
)
def _(t):
    titles = F.array(*map(F.lit, ("公开征求意见的通知", "意见征求公开", "关于food安全标准的通告", "food safety 意见", "征求 意见")))
    docs = t.orders.select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", F.get(titles, F.col("o_orderkey") % 5), F.col("o_orderkey").cast("string")).alias("text"))
    return se.matched(se.postings(docs), "意见 征求")


@query("k03_all_terms", "select doc_id from documents where contains(lower(text), 'license') and contains(lower(text), 'version')")
def _(t):
    return se.all_terms(t.documents, "License VERSION", ("text",)).select("doc_id")


@query("k05_summary_text", "select id, concat_ws(chr(10), summary, title) as text from notices")
def _(t):
    return t.notices.select("id", F.concat_ws("\n", "summary", "title").alias("text"))


@query(
    "a24_traceability",
    f"""with l as (select conv_id, turn, role, regexp_replace(text, '{_WS}+', '', 'g') as flat, case when turn % 2 = 0 then substr(text, 11, 40) else reverse(substr(text, 11, 40)) end as quote from conversations where length(text) >= 60),
 q as (select *, regexp_replace(quote, '{_WS}+', '', 'g') as bare from l where not regexp_matches(quote, '["“”„‟«»「」『』〝〞＂…]|[.][.][.]'))
 select role, count(*) filter (where length(bare) >= 8 and contains(flat, bare)) as traced, count(*) as total from q group by 1""",
)
def _(t):
    long = t.conversations.where("length(text) >= 60")
    piece = F.substring("text", 11, 40)
    quotes = long.select("conv_id", "turn", "role", F.when(F.col("turn") % 2 == 0, piece).otherwise(F.reverse(piece)).alias("quote"))  # every other one is not in its text
    quotes = quotes.where(~F.col("quote").rlike('["“”„‟«»「」『』〝〞＂…]|[.][.][.]'))
    traced = matching.traced_quotes(quotes, long.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    return traced.groupBy("role").agg(F.count_if("traced").alias("traced"), F.count("*").alias("total"))


@query("t01_clauses", "select conv_id, turn, count(*) as n from (select conv_id, turn, unnest(string_split(text, chr(10))) as line from conversations) where trim(line) <> '' and not regexp_matches(line, '^\\s*\\d+[.、)]') group by 1, 2 having count(*) > 0")
def _(t):
    texts = t.conversations.select(F.struct("conv_id", "turn").alias("id"), "text")
    c = diff.clauses(texts).where("kind = 'paragraph'")
    return c.groupBy(F.col("id.conv_id").alias("conv_id"), F.col("id.turn").alias("turn")).agg(F.count("*").alias("n"))


def _turn_pairs(t):
    new = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("new"))
    return t.conversations.withColumnRenamed("text", "old").join(new, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "old", "new")


@query("t03_clause_diff")
def _(t):
    return diff.clause_diff(_turn_pairs(t))


_PAIRS = "select a.conv_id * 1000 + a.turn as pair_id, a.text as old, b.text as new from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1"


@query(
    "t05_similarity",
    f"""with flat as (select pair_id, regexp_replace(old, '{_WS}+', '', 'g') as old, regexp_replace(new, '{_WS}+', '', 'g') as new from ({_PAIRS})),
 o as (select pair_id, substr(old, k, 2) as gram, count(*) as n from (select pair_id, old, unnest(range(1, length(old))) as k from flat) group by 1, 2),
 n as (select pair_id, substr(new, k, 2) as gram, count(*) as n from (select pair_id, new, unnest(range(1, length(new))) as k from flat) group by 1, 2),
 s as (select pair_id, sum(least(o.n, n.n)) as shared from o join n using (pair_id, gram) group by 1)
 select pair_id, round(case when old = new then 1.0::double when greatest(length(old) - 1, 0) + greatest(length(new) - 1, 0) = 0 then 0.0::double else 2 * coalesce(shared, 0)::double / (greatest(length(old) - 1, 0) + greatest(length(new) - 1, 0)) end, 9) as dice from flat left join s using (pair_id)""",
)
def _(t):
    return diff.dice(_turn_pairs(t)).withColumn("dice", F.round("dice", 9))


@query("t09_sql_function", "select o_orderkey, regexp_replace(o_orderpriority, '[^A-Z]', '', 'g') as letters from orders")
def _(t):
    t.spark.sql("create or replace temporary function letters_of(s string) returns string return regexp_replace(s, '[^A-Z]', '')")
    t.orders.createOrReplaceTempView("orders_view")
    return t.spark.sql("select o_orderkey, letters_of(o_orderpriority) as letters from orders_view")
