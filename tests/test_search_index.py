"""The kept index: ordered writes, deletions, replays, merges, pruning; and many queries at once."""

import math
import re
from collections import Counter

import pytest

from vellum.operators import search

DOCS = [(1, "公开征求意见的通知"), (2, "意外征见"), (3, "red apple pie"), (4, "apples are red"), (5, "Apple, apple; APPLE 2024"), (6, None), (7, "the cat of 关于food安全标准 and red")]


def frame(spark, rows, schema="id long, text string"):
    return spark.createDataFrame(rows, schema)


def terms(index, **ids):
    out = {}
    for r in index.postings().collect():
        out.setdefault(r.id, Counter())[r.term] += r.tf
    return out


def tokens(text):
    return re.findall(rf"[{search.HAN}]|[^\W_{search.HAN}]+", (text or "").lower())


def holds(index, docs):
    """The index holds exactly these documents, and its stored statistics are theirs."""
    want = {i: Counter(tokens(t)) for i, t in docs.items() if tokens(t)}
    lengths = [sum(c.values()) for c in want.values()]
    assert terms(index) == want
    assert index.statistics() == (len(want), sum(lengths) / len(want) if want else 1.0)


@pytest.fixture
def index(spark, tmp_path):
    return search.SearchIndex(spark, str(tmp_path / "index"))


def test_a_repeated_id_is_one_document(spark, index):
    rows = [(1, "first text", 1), (1, "second", 3), (1, "third text here", 2), (2, "other", 1), (None, "no id", 9)]
    index.index(frame(spark, rows, "id long, text string, at int"), order="at")
    holds(index, {1: "second", 2: "other"})
    index.index(frame(spark, [(2, "a"), (2, "b"), (2, "b")]))
    holds(index, {1: "second", 2: "b"})


def test_writes_deletions_and_merges(spark, index):
    now = dict(DOCS)
    index.index(frame(spark, DOCS))
    holds(index, now)
    for k in range(3):
        index.index(frame(spark, [(3, f"pear {k}"), (10 + k, "new apple")]))
        now |= {3: f"pear {k}", 10 + k: "new apple"}
        index.remove(frame(spark, [(4 + k,), (99,)], "id long"))
        now.pop(4 + k, None)
        holds(index, now)
    before = [tuple(r) for r in index.search("apple")[1].collect()]
    index.merge()
    holds(index, now)
    index.vacuum()
    holds(index, now)
    assert [tuple(r) for r in index.search("apple")[1].collect()] == before
    index.index(frame(spark, [(10, "after the merge")]))
    holds(index, now | {10: "after the merge"})
    index.rebuild(frame(spark, DOCS))
    holds(index, dict(DOCS))


def streamed(spark, index, tmp_path, rows, name="s"):
    schema = "id long, text string, gone boolean, at int"
    frame(spark, rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in-{name}"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"in-{name}"))
    run = index.sync(stream, str(tmp_path / f"checkpoint-{name}"), order="at").trigger(availableNow=True).start()
    assert run.awaitTermination(120)


def test_edits_and_deletions_in_one_micro_batch(spark, index, tmp_path):
    index.index(frame(spark, [(5, "old five"), (6, "old six"), (7, "old seven")]))
    rows = [(5, "edited", False, 1), (5, None, True, 2), (6, "first edit", False, 1), (6, "second edit", False, 2), (7, None, True, 1), (7, "back again", False, 2)]
    streamed(spark, index, tmp_path, rows)
    holds(index, {6: "second edit", 7: "back again"})
    streamed(spark, index, tmp_path, [(6, None, True, 3), (8, "eight", False, 3)])
    holds(index, {7: "back again", 8: "eight"})


def test_a_replayed_batch_changes_nothing(spark, index):
    change = frame(spark, [(1, "one", False), (2, None, True)], "id long, text string, gone boolean")
    index.index(frame(spark, [(2, "two")]))
    index._write(change, None, "stream", 0)
    index.index(frame(spark, [(1, "later"), (2, "later too")]))
    for _ in range(2):
        index._write(change, None, "stream", 0)
    holds(index, {1: "later", 2: "later too"})
    assert len(index._commits()) == 3
    index.merge()
    index.vacuum()
    index._write(change, None, "stream", 0)
    holds(index, {1: "later", 2: "later too"})


def test_a_failed_write_leaves_no_trace(spark, index, monkeypatch):
    index.index(frame(spark, DOCS))
    monkeypatch.setattr(index, "_commit", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.index(frame(spark, [(1, "half written"), (50, "half")]))
    holds(index, dict(DOCS))
    monkeypatch.undo()
    index.index(frame(spark, [(1, "whole"), (51, "whole too")]))
    holds(index, dict(DOCS) | {1: "whole", 51: "whole too"})


def test_a_search_reads_the_parts_of_its_terms(spark, index):
    index.index(frame(spark, [(n, f"{c}word {c}{n} 意见{c}") for n, c in enumerate("abcdefghij")]))
    hits = index.search("awo b")[1]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"part#\d+ IN \(1,2\)", plan) and "StartsWith(term" in plan
    assert hits.count() == 0 and [r.id for r in index.search("bwo b")[1].collect()] == [1]


def test_twelve_pieces_all_count(spark, index):
    words = [f"w{chr(97 + k)}" for k in range(12)]
    index.index(frame(spark, [(1, " ".join(words)), (2, " ".join(words[:11]))]))
    assert [r.id for r in index.search(" ".join(words))[1].collect()] == [1]


def brute_force(docs, queries, within=20):
    lists = {i: tokens(t) for i, t in docs if tokens(t)}
    n, mean = len(lists), sum(map(len, lists.values())) / len(lists)

    def tf(piece, own):
        if re.match(f"[{search.HAN}]", piece):
            return sum(own[k : k + len(piece)] == list(piece) for k in range(len(own)))
        return sum(t.startswith(piece) for t in own)

    out = []
    for q, text in queries:
        pieces = search.query_terms(text or "")
        held = {p: {i: f for i, own in lists.items() if (f := tf(p, own))} for p in pieces}
        ids = set.intersection(*map(set, held.values())) if held else set()
        score = lambda i: sum(math.log1p((n - len(h) + 0.5) / (len(h) + 0.5)) * h[i] * 2.2 / (h[i] + 1.2 * (0.25 + 0.75 * len(lists[i]) / mean)) for h in held.values())  # noqa: B023, E731
        ranked = sorted((-round(score(i), 6), i) for i in ids)
        out += [(q, i, round(-s, 5), k + 1) for k, (s, i) in enumerate(ranked[:within])]
    return sorted(out)


def test_many_queries_are_answered_as_one_by_one(spark, index):
    docs = [*DOCS, *((100 + k, f"red apple {k} 征求意见 {'pie ' * (k % 4)}ban{k % 3}ana") for k in range(40))]
    queries = [(1, "red app"), (2, "意见"), (3, "征求意见 red"), (4, "nothing here"), (5, "!?"), (6, None), (7, "p pie PIE"), (8, "red"), (9, "意"), (10, "apple apple 3")]
    index.index(frame(spark, docs))
    got = index.search_many(frame(spark, queries, "query_id long, query string"), within=7)
    rows = sorted((r.query_id, r.id, round(r.score, 5), r.rank) for r in got.collect())
    assert rows == brute_force(docs, queries, 7)
    for q, text in queries[:4]:
        one = [(r.id, round(r.score, 5)) for r in index.search(text, per_page=7)[1].collect()]
        assert one == [(i, s) for k, i, s, _ in sorted(rows, key=lambda r: r[3]) if k == q]
    assert not re.search("CartesianProduct|NestedLoopJoin|contains", got._jdf.queryExecution().executedPlan().toString(), re.I)
