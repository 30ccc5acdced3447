import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from vellum.llm import packing, token_stream
from vellum.llm.common import WordEncoder, vocabulary, work_dir

from .conftest import document_rows


def plain_ids(texts):
    t = Tokenizer.from_file(vocabulary())
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_encoder_gives_the_librarys_ids():
    odd = ["Grüße, Straße. İstanbul, ΣΑΣ.", "it's don't. 'tis 12,5 3.", "<|endoftext|> a<|startoftext|>b x́. é, \x1cq \xa0z\x85y", "", None, "ﬁne ½ ²,", "... ,,. a.. b,. É. ß. ſ. ŉ. ǅ, µ. ª."]
    encoder = WordEncoder(vocabulary(), max_words=5)  # starts its cache afresh again and again
    for _ in range(3):
        ids, counts = encoder.encode(odd)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == plain_ids(odd)


def test_token_stream_against_the_library(docs):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in token_stream.token_stream(docs, seq_len=64).collect())
    rows = document_rows()
    want = Counter((r[0] if r[0] is not None else -1, len(i), crc(i)) for r, i in zip(rows, plain_ids([r[1] for r in rows])))
    assert Counter((a, n, c) for a, _, n, c in got) == want
    at = 0
    for _, start, n, _ in sorted(got, key=lambda g: g[1]):
        assert start == at
        at += n
    assert [g[0] for g in sorted(got, key=lambda g: g[1])] == sorted(g[0] for g in got)


def test_files_hold_equal_sequences_and_masks(spark, docs):
    files = token_stream.write_token_files(docs, work_dir(spark, "test-tokens"), seq_len=64)
    for f in files:
        sequences = token_stream.SequenceFile.open(f["uri"] + ".arrows")
        real = 0
        for k in range(len(sequences)):
            ids, mask = sequences.sequence(k)
            assert len(ids) == len(mask) == 64
            assert mask.all() or k == len(sequences) - 1
            real += int(mask.sum())
        assert real == f["n_ids"]


def test_ids_and_masks_are_views_of_the_mapped_file(tmp_path):
    path = str(tmp_path / "ids.arrows")
    with open(path, "wb") as sink:
        writer = token_stream.SequenceWriter(sink, np.uint16, seq_len=64, seqs_per_batch=4)
        for k in range(40):
            writer.append(np.arange(k * 31, dtype=np.uint16))
        writer.close()
    mapped = pa.memory_map(path)
    whole = mapped.read_buffer(mapped.size())
    held = pa.total_allocated_bytes()
    sequences = token_stream.SequenceFile.open("file://" + path)
    want = np.concatenate([np.arange(k * 31, dtype=np.uint16) for k in range(40)])
    got = []
    for k in range(len(sequences)):
        ids, mask = sequences.views(k)
        assert len(ids) == len(mask) == 64 and pa.total_allocated_bytes() == held  # nothing was copied to Arrow's memory
        got.append(ids.to_numpy()[mask.to_numpy(zero_copy_only=False)])
    assert np.array_equal(np.concatenate(got), want) and len(sequences) == -(-len(want) // 64) and whole.size == mapped.size()


def test_word_cache_keeps_words_met_often():
    encoder = WordEncoder(vocabulary(), max_words=40)
    for k in range(8):
        texts = [" ".join(f"often{j} Often{j}, rare{k}x{j}" for j in range(12))]
        ids, _ = encoder.encode(texts)
        assert ids.tolist() == plain_ids(texts)[0]
    assert "often3" in encoder.number and "rare0x3" not in encoder.number


def test_marks_around_words_and_added_tokens():
    texts = ["(foo) [bar]! baz?'s qux's \"x\" a_b _c_ d*** e%%%. f'' 'g", "<|endoftext|> a<b >c< |d| e|f <g> h<|startoftext|>", "\x1ca b\x1f \u2003c\u2003d é! (Ñ) ªº"]
    ids, counts = WordEncoder(vocabulary()).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == plain_ids(texts)


def test_empty_table(no_docs):
    assert token_stream.token_stream(no_docs).count() == 0
    assert packing.pack_documents(no_docs).count() == 0


def test_pieces_tile_documents_and_fill_sequences(docs):
    pieces = packing.pack_documents(docs, pool_tokens=20_000).collect()
    rows = document_rows()
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
        total = sum(p.length for p in own)
        assert total <= 4096 and total & (total - 1) == 0 and all(p.tier == total for p in own)
    all_ids = [(r[0], ids) for r, ids in zip(rows, plain_ids([r[1] for r in rows]))]
    want = Counter((d, len(ids), len(ids)) for d, ids in all_ids)
    covered = Counter()
    for p in pieces:
        covered[p.doc_id, p.doc_tokens] += p.length
    assert covered == Counter({k[:2]: k[1] * n for k, n in want.items()})
    by_key = {(d, len(i)): i for d, i in all_ids}
    assert all(crc(by_key[p.doc_id, p.doc_tokens][p.start : p.start + p.length]) == p.ids_crc32 for p in pieces)


@pytest.mark.parametrize("lengths", [[], [1], [4096], [4097, 1], [5000] * 7, list(range(1, 700)), [513] * 100])
def test_pack_uses_each_token_once(lengths):
    windows = packing.pack(lengths)
    seen = defaultdict(list)
    for w in windows:
        assert sum(n for _, _, n in w) in {2**k for k in range(13)}
        for doc, start, n in w:
            seen[doc].append((start, n))
    for doc, length in enumerate(lengths):
        at = 0
        for start, n in sorted(seen[doc]):
            assert start == at and n > 0
            at += n
        assert at == length


def test_step_groups_are_balanced():
    sizes = [4096] * 50 + [2048] * 30 + [512] * 100
    groups = packing.deal(sizes, 20 * 4096)
    loads = np.bincount(groups, sizes)
    assert loads.max() - loads.min() <= 4096
