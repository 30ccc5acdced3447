"""Contacts, chosen files, chain findings and the fold of subscription events on hand-made rows."""

import datetime
import random

from pyspark.sql import functions as F

from vellum.functions import contacts as c
from vellum.operators import audits, ordering, subscriptions as s


def kinds(text, **how):
    return [(x["kind"], x["value"]) for x in c.contacts_of(text, **how)]


def test_a_stretch_is_claimed_once():
    assert kinds("见 http://www.moj.gov.cn/a 与 a.b@www.moj.gov.cn") == [("online", "http://www.moj.gov.cn/a"), ("email", "a.b@www.moj.gov.cn")]
    assert kinds("传真电话：010-12345678；电话：13912345678 和 010-12345678转12") == [("phone", "13912345678"), ("phone", "010-12345678转12"), ("fax", "010-12345678")]
    assert kinds("传真：010-12345678。") == [("fax", "010-12345678")] and kinds("联系电话及传真：010-12345678") == [("fax", "010-12345678")]
    assert kinds("http://x.cn/a.pdf https://beian.miit.gov.cn http://x.cn", page="http://x.cn") == []
    assert kinds("邮寄至：北京市某区某路一号某某大厦，并注明某某；邮编：100020") == [("address", "北京市某区某路一号某某大厦")]
    assert kinds("地址：desk@x.org 是邮箱不是地址") == [("email", "desk@x.org")]
    assert kinds("地址：网址见 www.moj.gov.cn 页面与北京市") == [("online", "http://www.moj.gov.cn"), ("address", "网址见 www.moj.gov.cn 页面与北京市")]
    assert kinds(None) == kinds("") == [] and len(kinds(" ".join(f"a{k}@b.org" for k in range(20)))) == 8


def test_contacts_as_rows(spark):
    docs = spark.createDataFrame([(1, "A@b.org，a@B.org。c@d.org", "g"), (2, None, "g"), (3, "没有", "h")], "id long, text string, grp string")
    found = c.contacts(docs)
    assert sorted(tuple(r)[:4] for r in found.collect()) == [(1, 1, "email", "A@b.org"), (1, 2, "email", "c@d.org")]
    assert sorted((r.grp, r.n, r.n_none, r.n_email, r.n_fax) for r in c.contact_audit(docs, found, "grp").collect()) == [("g", 2, 1, 1, 0), ("h", 1, 1, 0, 0)]


def chosen(spark, names, most=3):
    rows = spark.createDataFrame([(1, n, k) for k, n in enumerate(names)], "notice_id int, name string, pos int")
    return [r.name for r in sorted(ordering.chosen_files(rows, most).collect(), key=lambda r: r["rank"])]


def test_a_file_that_explains_is_kept(spark):
    assert chosen(spark, ["甲办法.pdf", "乙规定.docx", "丙草案.doc", "编制说明.wps", "附图.pdf"]) == ["甲办法.pdf", "乙规定.docx", "编制说明.wps"]
    assert chosen(spark, ["甲办法.zip", "资料一.pdf", "资料二.pdf", "资料三.pdf", "修订说明"]) == ["资料一.pdf", "资料二.pdf", "资料三.pdf"]  # no draft would be left
    assert chosen(spark, ["起草说明.doc", "办法.pdf"], 1) == ["办法.pdf"] and chosen(spark, ["a.JPG", None]) == [None]


def test_chain_findings(spark):
    rows = [(1, "关于《甲乙丙丁法》的通知", "A", None), (2, "关于《甲乙丙丁法（草案）》的通知", "A", 1), (3, "关于《甲乙丙丁法》的函", "B", 1), (4, "关于《甲乙（试点）丙丁法》的通知", "A", 9), (5, None, "A", 1), (6, "草案", "A", 1)]
    got = sorted((r.finding, r.id, r.version_of, r.members, r.n_keys) for r in audits.chain_audit(spark.createDataFrame(rows, "id long, title string, agency string, version_of long")).collect())
    assert [g for g in got if g[0] == "dirty"] == [("dirty", 3, 1, None, None), ("dirty", 4, 9, None, None)]
    assert [g[1:] for g in got if g[0] == "split"] == [(1, None, 3, 2), (2, 1, 3, 2), (4, 9, 3, 2)]


EVENTS = "seq long, at timestamp, kind string, email string, rules string, token string"


def made(spark, kind, email, seq):
    return spark.range(1).select(s.token(kind, F.lit(email), F.lit(seq))).first()[0]


def run(spark, state, events):
    state, outcomes = s.applied(state, spark.createDataFrame(events, EVENTS))
    return {r.email: r.asDict() for r in state.collect()}, {r.seq: r.outcome for r in outcomes.collect()}


def test_a_subscription_from_first_to_last(spark):
    at = lambda n: datetime.datetime(2024, 1, n)
    c1, c3, c6, u1 = (made(spark, k, "a@b", n) for k, n in (("confirm", 1), ("confirm", 3), ("confirm", 6), ("unsubscribe", 1)))
    events = [(1, at(1), "submit", "a@b", "R1", None), (2, at(2), "confirm", None, None, c1), (3, at(3), "submit", "a@b", "R3", None), (4, at(4), "confirm", None, None, c1), (5, at(5), "confirm", None, None, c3), (6, at(6), "submit", "a@b", "R6", None), (7, at(7), "unsubscribe", None, None, u1), (8, at(8), "confirm", None, None, c6), (9, at(9), "submit", "a@b", "R9", None), (10, at(10), "unsubscribe", None, None, "nonsense"), (11, at(11), "confirm", None, None, None)]
    none = spark.createDataFrame([], s.STATE)
    state, outcomes = run(spark, none, events)
    assert outcomes == {1: "created", 2: "confirmed", 3: "confirmed-pending", 4: "invalid", 5: "confirmed", 6: "confirmed-pending", 7: "done", 8: "unsubscribed", 9: "resubscribed", 10: "invalid", 11: "invalid"}
    a = state["a@b"]
    assert (a["rules"], a["pending"], a["confirmed"], a["confirmed_at"], a["unsubscribed_at"], a["unsubscribe_token"], a["last_seq"]) == ("R9", None, False, None, None, u1, 9)
    half, _ = run(spark, none, events[:5])
    assert (half["a@b"]["rules"], half["a@b"]["confirmed_at"], half["a@b"]["confirm_token"]) == ("R3", at(2), c3)


def test_batches_and_replays(spark):
    """Any cut into batches gives the same state, and a batch that comes again changes nothing."""
    r = random.Random(2)
    emails = ["a@b", "c@d", "e@f"]
    events, submits = [], {e: [] for e in emails}
    for n in range(60):
        e = r.choice(emails)
        kind = r.choice(["submit", "submit", "confirm", "confirm", "unsubscribe"])
        if kind == "submit":
            submits[e].append(n)
        own = submits[e]
        token = None if kind == "submit" or not own else made(spark, kind, e, own[0] if kind == "unsubscribe" or r.random() < 0.3 else own[-1])
        events.append((n, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n), kind, e if kind == "submit" else None, f"R{n}", token))
    whole, outcomes = run(spark, spark.createDataFrame([], s.STATE), events)
    state = spark.createDataFrame([], s.STATE)
    for cut in (slice(0, 20), slice(0, 20), slice(15, 45), slice(45, 60), slice(0, 60)):
        rows, told = run(spark, state, events[cut])
        assert all(outcomes[k] == o for k, o in told.items())
        state = spark.createDataFrame([tuple(v[f] for f in s._FIELDS) for v in rows.values()], s.STATE)
    assert rows == whole and len(set(outcomes.values())) >= 5
