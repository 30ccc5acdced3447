"""Hierarchical packing of documents into training windows of several lengths.

A document is routed to the shortest context tier that holds it (longer ones give off full windows
of the longest tier first). Each tier is packed: a document opens a window of its tier, and the gap
is filled with the longest documents of shorter tiers that fit, the last of them cut at the
window's end. Since what is cut off goes on as a document of its own, every window is full; the
last tokens of a pool, too few for a window, become windows of halved lengths. So every sequence's
length is a power of two, and none needs padding. Sequences are then dealt to step groups, longest
first to the lightest group.

A pool is a bounded run of a partition's documents, packed on its own: no shuffle, no state across
tasks. Defined results: a null text is an empty one (only the end id); repeated rows are packed
again; null ids are kept; an empty table gives no rows; other input columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import END_ID, batches, small_batches, vocabulary, word_encoder

TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 64 * 4096
POOL_TOKENS = 2_000_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack(lengths, tiers=TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows for documents of the given lengths; a window is a list of (document, start, length)."""
    longest, windows = tiers[-1], []
    waiting: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # per tier, sorted: (length, document, start)

    def route(length: int, doc: int, start: int, put) -> None:
        tier = next(k for k, size in enumerate(tiers) if length <= size)
        put(waiting[tier], (length, doc, start))

    for doc, length in enumerate(map(int, lengths)):
        start = 0
        while length - start > longest:
            windows.append([(doc, start, longest)])
            start += longest
        if length > start:
            route(length - start, doc, start, list.append)
    for tier in waiting:
        tier.sort()

    for k in range(len(tiers) - 1, -1, -1):
        size = tiers[k]
        while waiting[k]:
            length, doc, start = waiting[k].pop()
            window, gap = [(doc, start, length)], size - length
            while gap:
                for j in range(k, -1, -1):  # whole pieces first: the longest that fits
                    if fit := bisect_right(waiting[j], (gap, len(lengths), 0)):
                        length, doc, start = waiting[j].pop(fit - 1)
                        break
                else:  # none fits whole: cut the longest of the shortest tier that has any
                    j = next((j for j in range(k + 1) if waiting[j]), None)
                    if j is None:
                        break
                    length, doc, start = waiting[j].pop()
                    route(length - gap, doc, start + gap, insort)
                    length = gap
                window.append((doc, start, length))
                gap -= length
            if not gap:
                windows.append(window)
            else:
                windows += _halved(window, size)
    return windows


def _halved(window: list[tuple[int, int, int]], size: int) -> list[list[tuple[int, int, int]]]:
    """A window that nothing is left to fill, cut into full windows of halved lengths."""
    pieces, out = window[::-1], []
    left = sum(p[2] for p in pieces)
    while left:
        while size > left:
            size //= 2
        own, gap = [], size
        while gap:
            doc, start, length = pieces.pop()
            take = min(gap, length)
            own.append((doc, start, take))
            if length > take:
                pieces.append((doc, start + take, length - take))
            gap -= take
        out.append(own)
        left -= size
    return out


def deal(sizes: list[int], step_tokens: int) -> np.ndarray:
    """A step group for each sequence: longest first, each to the group with the fewest tokens."""
    groups = max(1, round(sum(sizes) / step_tokens))
    heap, group = [(0, g) for g in range(groups)], np.empty(len(sizes), np.int64)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        load, g = heapq.heappop(heap)
        group[k] = g
        heapq.heappush(heap, (load + sizes[k], g))
    return group


def pack_documents(docs: DataFrame, vocab: str | None = None, tiers=TIERS, step_tokens: int = STEP_TOKENS, pool_tokens: int = POOL_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece; ``sequence_id`` and ``step_group`` are unique over all partitions."""
    vocab = vocab or vocabulary()
    small_batches(docs.sparkSession)

    def pool_rows(part: int, pool: int, doc_ids: list, ids: list, counts: list) -> pa.RecordBatch:
        ids, counts = np.concatenate(ids).astype("<u4"), np.concatenate(counts)
        first = np.cumsum(counts) - counts
        data = memoryview(ids).cast("B")
        windows = pack(counts, tiers)
        sizes = [sum(p[2] for p in w) for w in windows]
        group = deal(sizes, step_tokens)
        base = (part << 36) + (pool << 24)
        rows = []
        for n, k in enumerate(np.argsort(group, kind="stable")):
            offset = 0
            for doc, start, length in windows[k]:
                a = 4 * (int(first[doc]) + start)
                rows.append((doc_ids[doc], start, length, zlib.crc32(data[a : a + 4 * length]), int(counts[doc]), base + n, offset, sizes[k], base + int(group[k])))
                offset += length
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
        types = [pa.int32() if n == "tier" else pa.int64() for n in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(it):
        part, pool, encoder = TaskContext.get().partitionId(), 0, None
        doc_ids, ids, counts, held = [], [], [], 0
        for batch in batches(it):
            encoder = encoder or word_encoder(vocab, end_id)
            x, n = encoder.encode(batch.column("text"))
            doc_ids += batch.column("doc_id").to_pylist()
            ids.append(x)
            counts.append(n)
            held += len(x)
            if held >= pool_tokens:
                yield pool_rows(part, pool, doc_ids, ids, counts)
                pool, doc_ids, ids, counts, held = pool + 1, [], [], [], 0
        if doc_ids:
            yield pool_rows(part, pool, doc_ids, ids, counts)
        if encoder:
            encoder.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
