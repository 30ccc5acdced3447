import zlib
from collections import defaultdict

from vellum.llm.sharding import shard_by_bytes

from .conftest import document_rows


def test_contiguous_shards_of_near_equal_bytes(spark):
    rows = [(k, "x" * (k * 37 % 100)) for k in range(2000)]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 7).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == [(k, len(t) + 8, zlib.crc32(t.encode())) for k, t in rows]
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
    assert sorted(by_shard) == list(range(7))
    total, last = sum(r.size for r in got), -1
    for s in range(7):
        own = sorted(by_shard[s], key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert own[0].doc_id > last
        last = own[-1].doc_id
        assert abs(sum(r.size for r in own) - total / 7) <= 108


def test_nulls_ties_and_repeated_rows(docs):
    got = shard_by_bytes(docs, 3).collect()
    want = sorted((r[0] is not None, r[0] or 0, len((r[1] or "").encode()) + 8) for r in document_rows())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size) for r in got) == want
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id or -1 for r in order] == sorted(r.doc_id or -1 for r in got) or [(-1 if r.doc_id is None else r.doc_id) for r in order] == sorted(-1 if r.doc_id is None else r.doc_id for r in got)
    assert all(r.law == "bytes" and r.grown_shard is None for r in got)


def test_one_id_for_all(spark):
    got = shard_by_bytes(spark.createDataFrame([(1, "same")] * 240, "doc_id long, text string"), 24).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(24) for k in range(10)]


def test_empty(no_docs):
    assert shard_by_bytes(no_docs).count() == 0
