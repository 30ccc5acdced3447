"""Operators whose cases the generated tables lack: Chinese texts, files, diffs, orders of evidence."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.functions import classify, dates, files as kinds, rulebook, summaries, text, urls
from vellum.operators import diff, filters, merge, search
from vellum.sources import files, html
from vellum.streaming import jobs


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "raw, day",
    [
        ("2024-3-5", datetime.date(2024, 3, 5)),
        ("截至2024年3月5日", datetime.date(2024, 3, 5)),
        ("2024年3月5日 / 2024.4.6", datetime.date(2024, 4, 6)),
        ("2023-02-30", None),
        ("0050-01-01", None),
        ("none", None),
    ],
)
def test_dates(spark, raw, day):
    assert one(spark, dates.date_in(F.lit(raw)))[0] == day


def test_deadline_falls_through_to_the_next_pattern(spark):
    raw = "截止时间：2024-02-31。请于2024年3月1日前反馈"
    assert one(spark, dates.deadline_in(F.lit(raw), ["截止时间：[^。]+", "请于[^前]+前"]))[0] == datetime.date(2024, 3, 1)


def test_text(spark):
    r = one(
        spark,
        text.cjk_count(F.lit("a条例b草案")),
        text.collapsed(F.lit(" a　 b ")),
        text.fingerprint(F.lit("“甲 乙”")),
        text.contains_in_order(F.lit("第一部分内容在这里后面是第二部分内容"), text.segments(F.lit("第一部分内容在这……面是第二部分内容"))),
        text.contains_in_order(F.lit("第一部分内容在这里后面是第二部分内容"), text.segments(F.lit("面是第二部分内容……第一部分内容在这"))),
        text.sentences(F.lit("一。二！\n三")),
        text.spaced_cjk(F.lit("公开ab意见")),
        text.anchor_count(F.lit("第一条 x\n  第二条 y\n见第三条")),
    )
    assert tuple(r) == (4, "a b", "甲乙", True, False, ["一。", "二！", "三"], "公 开 ab意 见", 2)


def test_classification(spark):
    r = one(
        spark,
        classify.title_key(F.lit("关于《某某管理办法（修订）征求意见稿》公开征求意见的通知")),
        classify.attachment_role(F.lit("起草说明.docx")),
        classify.agencies_of(F.lit("甲部、乙局、甲部"), {"乙局": "乙总局"}),
    )
    assert tuple(r) == ("某某管理办法修订", "explanation", ["甲部", "乙总局"])


@pytest.mark.parametrize(
    "url, ok",
    [("http://example.org/a", True), ("ftp://example.org/", False), ("http://127.0.0.1/", False), ("https://10.1.2.3/x", False), ("http://172.32.0.1/", True), ("http://localhost/", False), ("http://[::1]/", False), ("javascript:x", False)],
)
def test_may_fetch(spark, url, ok):
    assert one(spark, urls.may_fetch(F.lit(url)))[0] is ok


def word_file(*paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs))
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(word_file("A &amp; B", "C"))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "c.html").write_bytes(b"<!DOCTYPE html><p>x</p>")
    (tmp_path / "d.bin").write_bytes(b"\0" * 2000)
    got = {r.path.rsplit("/", 1)[-1]: (r.kind, r.status, r.text) for r in files.extracted(files.binaries(spark, str(tmp_path), 1000)).collect()}
    assert got == {"a.docx": ("zip", "ok", "A & B\nC"), "b.pdf": ("pdf", "unsupported_container", None), "c.html": ("html", "ok", "<!DOCTYPE html><p>x</p>")}
    assert one(spark, kinds.kind_of(F.unhex(F.lit("D0CF11E0A1B11AE1"))))[0] == "ole"


def test_html(spark):
    page = "<title>T</title><ul><li><a href='/x/a.pdf?k=1'>File</a></li><li><a href='b.doc'></a></li><li><a href='/x/a.pdf?k=1'>again</a></li></ul><p>one<p>two<script>no</script>"
    df = spark.createDataFrame([(1, "http://h.org/d/", page)], "page_id long, url string, html string")
    assert [tuple(x) for x in df.select(html.attachments(F.col("html"), F.col("url"))).first()[0]] == [("File", "http://h.org/x/a.pdf?k=1"), ("b.doc", "http://h.org/d/b.doc")]
    r = html.details(df).first()
    assert (r.title, r.body.split("\n")) == ("T", ["File", "again", "one", "two"])


def test_clauses_and_alignment(spark):
    old = [("第一条", "第一条 为了规范管理，制定本办法。"), ("第二条", "第二条 本办法适用于全国。"), ("", "附注")]
    new = [("第一条", "第一条 为了规范管理，制定本办法。"), ("第二条", "第二条 本办法适用于全省范围。"), ("第三条", "第三条 新增内容。")]
    assert diff.align(old, new) == [("same", 0, 0), ("removed", 2, None), ("modified", 1, 1), ("added", None, 2)]
    assert diff.char_segments("abcdef", "abXdef") == [("same", "ab"), ("removed", "c"), ("added", "X"), ("same", "def")]
    df = spark.createDataFrame([(1, "第一章 总则\n第一条 甲\n续行\n第二条 乙")], "id long, text string")
    assert [(r.kind, r.text) for r in diff.clauses(df).orderBy("pos").collect()] == [("chapter", "第一章 总则"), ("article", "第一条 甲\n续行"), ("article", "第二条 乙")]
    pairs = spark.createDataFrame([(1, "第一条 甲\n第二条 乙", "第一条 甲\n第三条 丙")], "pair_id long, old string, new string")
    assert sorted(r.change for r in diff.clause_diff(pairs).collect()) == ["added", "removed", "same"]
    assert diff.dice(spark.createDataFrame([(1, "abcd", "abce"), (2, "a", "b"), (3, "a a", "aa")], "pair_id long, old string, new string")).orderBy("pair_id").select("dice").toPandas()["dice"].round(6).tolist() == [0.666667, 0.0, 1.0]


def table_pairs(old, new):
    """The reference's rule over the whole table."""
    n, m = len(old), len(new)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if old[i] == new[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < n and j < m:
        if old[i] == new[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


@pytest.mark.parametrize("most_cells", [1, 20, 200, diff.MOST_CELLS])
def test_common_pairs_of_any_size_follow_one_rule(most_cells):
    import random

    dice = random.Random(5)
    for k in range(120):
        old, new = ([dice.choice("abcdef"[: 2 + k % 5]) for _ in range(dice.randrange(0, 60))] for _ in range(2))
        assert diff.common_pairs(old, new, most_cells) == table_pairs(old, new)


def test_a_clause_put_before_a_long_text():
    old = [(f"第{k}条", f"第{k}条 甲{k}。") for k in range(2100)]
    new = [("第0条", "第0条 新。"), *old[:1000], *old[1001:]]
    got = diff.align(old, new)
    assert [r for r in got if r[0] != "same"] == [("added", None, 0), ("removed", 1000, None)]
    assert [r[1:] for r in got if r[0] == "same"] == [(k, k + (k < 1000)) for k in range(2100) if k != 1000]


def limited(rows, seconds, most):
    out, state = {}, {}
    for key, at, seq in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2])):
        start, n = state.get(key, (at, 0))
        if None not in (start, at) and (at - start).total_seconds() >= seconds:
            start, n = at, 0
        state[key] = start, n + 1
        out[seq] = n < most
    return out


def test_folds_hold_no_client_whole(spark):
    from vellum.operators import feeds, windows

    t0 = datetime.datetime(2024, 1, 1)
    rows = [(None if k % 5 == 0 else "big" if k % 3 else f"c{k % 7}", t0 + datetime.timedelta(seconds=k * k % 9001) if k % 100 else None, k) for k in range(3000)]
    hits = spark.createDataFrame(rows, "source_id string, at timestamp, seq long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    sizes = spark.sparkContext.accumulator(0)
    whole = windows.folded(hits, "source_id", [], lambda s, at: (None, None), lambda batch, out: sizes.add(batch.num_rows > 64) or batch, hits.schema)
    try:
        assert whole.count() == 3000 and sizes.value == 0
        got = windows.rate_limited(hits, "source_id", 60.0, 3)
        assert got.columns == ["source_id", "at", "seq", "passed"] and "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
        assert {r.seq: r.passed for r in got.collect()} == limited(rows, 60.0, 3)
        asked = hits.select(F.col("source_id").alias("host"), "seq", "at", (F.col("seq") % 4 != 0).alias("refused"))
        policy = feeds.host_policy(asked, 2.0, 3)
        assert "FlatMapGroupsInPandas" not in policy._jdf.queryExecution().toString()
        want, state = {}, {}
        for host, at, seq in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2])):
            last, refusals = state.get(host, (None, 0))
            if refusals >= 3:
                want[seq] = (False, "tripped")
            elif None not in (last, at) and (at - last).total_seconds() < 2.0:
                want[seq] = (False, "too early")
            else:
                want[seq], state[host] = (True, None), (at, refusals + 1 if seq % 4 else 0)
        assert {r.seq: (r.allowed, r.reason) for r in policy.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_short_and_otherwise_parted_needles_are_found(spark):
    from vellum.operators import matching

    texts = ["a foobar of many words that are written in a row, and then some more of them", "foo", "x", "", None, "  the quick brown fox jumps over the lazy dog and runs  "]
    needles = ["foo bar", "o", "of many words thatare written in a row, and then", "the  quick brown", "quick brownfox jumps over the lazy dog and runs", "", None, "foo", "fooo"]
    flat = lambda t: "".join(t.split())
    want = {(i, j) for i, n in enumerate(needles) for j, t in enumerate(texts) if n is not None and t is not None and flat(n) in flat(t)}
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    got = matching.contained_pairs(frame(needles), frame(texts)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def rule(scope="some", categories=(), agencies=(), keywords=(), audiences=()):
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return F.lit(scope), arr(categories), arr(agencies), arr(keywords), arr(audiences)


@pytest.mark.parametrize(
    "args, strict, passes",
    [
        ({}, False, False),
        ({"scope": "all"}, False, True),
        ({"categories": ["t"]}, False, True),
        ({"categories": ["u"]}, False, False),
        ({"keywords": ["WORD"]}, False, True),
        ({"audiences": ["public"]}, False, True),
        ({"audiences": ["sector"], "scope": "all"}, False, False),
        ({"audiences": ["public"], "categories": ["u"]}, False, True),
        ({"audiences": ["public"], "categories": ["u"]}, True, False),
        ({"audiences": ["public"], "keywords": ["none"]}, False, False),
    ],
)
def test_rules(spark, args, strict, passes):
    notice = F.array(F.lit("t")), F.array(F.lit("a")), F.lit("some word here"), F.lit("public")
    assert one(spark, filters.rule_matches(*rule(**args), *notice, strict))[0] is passes


def test_query_parsing():
    q = filters.NoticeQuery.parse({"from": "2024-05", "to": "2024-01", "since": "9", "sort": "x", "page": "0", "audience": "all"}, "2024-06-01", "2024-06-01 00:00:00")
    assert (q.first_month, q.last_month, q.since_days, q.sort, q.page, q.audience) == (None, None, None, "deadline", 1, None)


def test_evidence_ties_go_to_the_new(spark):
    assert tuple(one(spark, merge.wins(F.lit("title"), F.lit("title")), merge.wins(F.lit("text"), F.lit("title")), merge.wins(F.lit("manual"), F.lit(None).cast("string")))) == (True, False, True)


def test_search(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, "red pie")], "id long, text string")
    index = search.postings(docs)
    assert [r.id for r in search.search(index, 3, 2.3, "app re").collect()] == [1]
    assert search.search(index, 3, 2.3, "!!!").count() == 0 == search.all_terms(docs, "%", ("text",)).count()
    probes = docs.select("id", F.col("text").alias("probe"))
    assert all(r.found for r in search.self_retrieval(index, probes, 3, 7 / 3).collect())


def test_summaries(spark):
    r = one(
        spark,
        summaries.has_key(F.lit('{"a":null}'), "a"),
        summaries.has_key(F.lit("{}"), "a"),
        summaries.without_status(F.lit("【已结束】某办法 ")),
        summaries.agency_in_title(F.lit("国家税务总局关于某事的公告")),
        summaries.error_kind(F.lit("HTTP 429")),
        summaries.decoded(F.lit("%%%"), "a string"),
    )
    assert r[:5] == (True, False, "某办法", "国家税务总局", "quota") and (r[5] is None or r[5].a is None)


def test_streams_match_batches(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    stream = jobs.events_stream(spark, f"{small}/events.parquet*")
    runs = jobs.drained(jobs.failure_runs(stream), f"file://{tmp_path}/runs")
    assert runs.count() == events.count()
    got = {r.event_id: r.failures for r in runs.collect()}
    run: dict[int, int] = {}
    for r in events.orderBy("ts", "event_id").collect():
        run[r.user_id] = run.get(r.user_id, 0) + 1 if r.event_type == "error" else 0
        assert got[r.event_id] == run[r.user_id]


def test_sends_are_marked_after_sending(spark, tmp_path):
    sent, path = [], f"{tmp_path}/sent"
    write = jobs.send_then_mark(lambda df: sent.append(df.count()), path)
    batch = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "a long, b long")
    write(batch, 0)
    write(batch, 1)
    assert sent == [2, 0]


def test_normalizers_and_notes(spark):
    from vellum.functions import rules

    r = one(
        spark,
        rules.email(F.lit(" A@B.org ")),
        rules.email(F.lit("a@b")),
        rules.keywords(F.lit("甲, 乙，甲、\n丙"), 2),
        rules.document_names(F.lit("《某条例》和《某标准》、《某条例》")),
        rules.heading_lines(F.lit("一、背景\n正文\n（二）内容")),
        rules.looks_like_draft(F.lit("第一条 短")),
        rules.intake_sentence(F.lit(3), F.lit(2), F.lit(10), F.lit(True)),
        rules.change_note(F.lit(0), F.lit(2)),
        rules.summary_after(F.lit("failed_review"), F.lit("old"), F.lit("new"))[0],
    )
    assert tuple(r) == ("a@b.org", None, ["甲", "乙"], ["某条例", "某标准"], ["一、背景", "（二）内容"], False, "2 of 3 files, 10 characters, cut to the budget", "2 statements of change", "old")


def test_search_index_is_kept_up_to_date(spark, tmp_path):
    docs = spark.createDataFrame([(1, "公开征求意见的通知"), (2, "意外征见"), (3, "red apple pie"), (4, "apples are red")], "id long, text string")
    index = search.SearchIndex(spark, str(tmp_path / "index"))
    assert index.search("apple")[1].count() == 0
    index.index(docs)
    ids = lambda q: sorted(r.id for r in search.matched(index.postings(), q).collect())
    assert (ids("意见"), ids("征求 意见"), ids("app apple"), ids("RED app"), ids("意见 apple"), ids("!?")) == ([1], [1], [3, 4], [3, 4], [], [])
    index.index(spark.createDataFrame([(3, "green pear"), (5, "apple")], "id long, text string"))
    assert ids("apple") == [4, 5] and ids("pear") == [3]
    index.remove(spark.createDataFrame([(1,), (4,), (99,)], "id long"))
    assert ids("意见") == [] and ids("apple") == [5]
    total, hits = index.search("apple", page=1, per_page=1)
    assert total.first().total == 1 and [r.id for r in hits.collect()] == [5]
    spark.createDataFrame([(5, "no more", False), (2, None, True), (6, "late apple", False)], "id long, text string, gone boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string, gone boolean").parquet(str(tmp_path / "in"))
    run = index.sync(stream, str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert ids("apple") == [6] and ids("意外") == [] and ids("more") == [5]
    index.rebuild(docs)
    assert ids("apple") == [3, 4] and ids("more") == []


def test_repeated_incoming_keys_give_one_row(spark):
    stored = spark.createDataFrame([(1, "a")], "id long, v string")
    incoming = spark.createDataFrame([(1, "b"), (1, "c"), (2, "d"), (2, "d")], "id long, v string")
    got = sorted((r.id, r.v, r.outcome) for r in merge.upserted(stored, incoming, "id", (), latest=(F.desc("v"),)).collect())
    assert got == [(1, "c", "updated"), (2, "d", "inserted")]


def test_full_rule_tables(spark):
    body = F.lit("数据安全\n联系人：卫生 司\n正文")
    r = one(
        spark,
        rulebook.domain_tags(F.lit("电商"), body, dropped_lines="联系人：.*"),
        rulebook.domain_tags(F.lit("环境卫生"), F.lit(None).cast("string"), not_counted={"卫生": "环境卫生"}),
        rulebook.audience_decision(F.lit("t"), F.lit("s"), overrides={"95": "public"}, key=F.lit("954d")),
        rulebook.genre_decision(F.lit("公路条例"), F.array(F.lit("修订对照表")), F.lit(None).cast("string")),
        rulebook.genre_decision(F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit("第二条修改为")),
    )
    assert list(r[0]) == ["数据与网络安全"] and list(r[1]) == []
    assert tuple(r[2]) == ("public", "override") and tuple(r[3]) == ("amendment", "attachment_names", "修订对照表") and tuple(r[4]) == ("amendment", "attachment_text", "修改为")
