"""Exact top-k inner products by a bit-sliced index.

Vectors are quantised to integers, floor(scale * x), and cut into blocks. A block's index holds, for
each attribute, one bitmap over the block's rows per bit of the attribute's offset value. A query's
scores for all rows of a block are added up in bitmap arithmetic: for each bit of the query's
weights, the slices of the attributes with that bit are summed by carry-save adders and added at
that bit's place, the sign bit negatively. The k best rows are then selected from the most
significant slice downward; rows that tie at the boundary are resolved by their ids, and the k rows
of all blocks by exact scores.

A block streams through a task once, followed by the queries in small blocks; a task holds one index
block and one query block. Defined results: vectors that are null or hold null or non-finite
components take no part, nor do rows with a null id; shorter vectors count as padded with zeros; a
query's own row is every row with its id; a candidate id that is repeated counts once per row, a
query id once (its least vector); no queries or no vectors give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

BLOCK_ROWS = 32_768
QUERY_ROWS = 64

SCHEMA = "query_id long, vec_id long, score long"


class BitSlicedBlock:
    """The index of one block: ``slices[d, i]`` is the bitmap of bit i of attribute d, less its offset."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")  # the first rows of a tie are those of the least ids
        self.ids, self.values = ids[order], values[order]
        n, dims = values.shape
        self.rows, self.words = n, -(-n // 64)
        self.offset = self.values.min(axis=0)
        shifted = self.values - self.offset
        self.bits = max(1, int(shifted.max()).bit_length())
        padded = np.zeros((self.words * 64, dims), np.int64)
        padded[:n] = shifted
        self.slices = np.empty((dims, self.bits, self.words), np.uint64)
        for i in range(self.bits):
            plane = np.ascontiguousarray(((padded >> i) & 1).astype(np.uint8).T)
            self.slices[:, i] = np.ascontiguousarray(np.packbits(plane, axis=1, bitorder="little")).view("<u8")
        self.live = np.packbits(np.arange(self.words * 64) < n, bitorder="little").view("<u8")

    def _attribute_sum(self, dims: np.ndarray, width: int) -> np.ndarray:
        """Slices of the sum of the given attributes, by carry-save adders."""
        w = min(width, self.bits + int(len(dims)).bit_length())
        todo = []
        for d in dims:
            x = np.zeros((w, self.words), np.uint64)
            x[: min(w, self.bits)] = self.slices[d][:w]
            todo.append(x)
        while len(todo) > 2:
            out = []
            for k in range(0, len(todo) - 2, 3):
                a, b, c = todo[k : k + 3]
                ab = a ^ b
                carry = np.zeros_like(a)
                carry[1:] = ((a & b) | (ab & c))[:-1]
                out += [ab ^ c, carry]
            todo = out + todo[len(todo) - len(todo) % 3 :]
        if not todo:
            return np.zeros((w, self.words), np.uint64)
        return todo[0] if len(todo) == 1 else _added(todo[0], todo[1])

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Slices, least significant first, of each row's score in order-preserving form."""
        weight_bits = max(1, int(max(abs(int(query.min())), abs(int(query.max())))).bit_length())
        width = self.bits + weight_bits + int(len(query)).bit_length() + 2
        total = np.zeros((width, self.words), np.uint64)
        for j in range(weight_bits + 1):  # two's complement: the last bit counts negatively
            dims = np.flatnonzero((query >> j) & 1)
            if not len(dims):
                continue
            part = np.zeros((width - j, self.words), np.uint64)
            s = self._attribute_sum(dims, width - j)
            part[: len(s)] = s
            total[j:] = _added(total[j:], part) if j < weight_bits else _added(total[j:], ~part, carry=True)
        total[-1] ^= np.uint64(0xFFFFFFFFFFFFFFFF)  # signed order becomes unsigned order
        return total

    def top(self, query: np.ndarray, k: int, allowed: np.ndarray) -> np.ndarray:
        """Positions of the k allowed rows with the highest scores, ties to the first rows."""
        slices = self.scores(query)
        sure, maybe = np.zeros(self.words, np.uint64), allowed
        n_sure = 0
        for s in slices[::-1]:
            high = maybe & s
            n = n_sure + int(np.bitwise_count(high).sum())
            if n > k:
                maybe = high
            else:
                sure, n_sure, maybe = sure | high, n, maybe & ~s
                if n == k:
                    break
        found = _positions(sure)
        return found if n_sure == k else np.concatenate([found, _positions(maybe)[: k - n_sure]])


def _added(a: np.ndarray, b: np.ndarray, carry: bool = False) -> np.ndarray:
    out = np.empty_like(a)
    c = np.full(a.shape[1], 0xFFFFFFFFFFFFFFFF if carry else 0, np.uint64)
    for i in range(len(a)):
        ab = a[i] ^ b[i]
        out[i] = ab ^ c
        c = (a[i] & b[i]) | (ab & c)
    return out


def _positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as a matrix of ``dims`` columns, padded with zeros."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = column.flatten().to_numpy()
    return out


def _block(dims: int):
    """Packs a partition's vectors into one block: its number, its ids and its matrix, as bytes."""

    def run(it):
        ids, mats = [], []
        for batch in it:
            ids.append(batch.column("vec_id").to_numpy())
            mats.append(_matrix(batch.column("v"), dims).astype("<i4"))
        if ids:
            yield pa.RecordBatch.from_pydict({"block": [TaskContext.get().partitionId()], "ids": [np.concatenate(ids).tobytes()], "vectors": [np.concatenate(mats).tobytes()]})

    return run


def _search(k: int, dims: int):
    def unpack(row):
        return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<i4").reshape(-1, dims).astype(np.int64)

    def run(it):
        block = None
        for batch in it:
            for row in batch.to_pylist():
                ids, vectors = unpack(row)
                if not row["is_query"]:
                    block = BitSlicedBlock(ids, vectors)
                    continue
                out = []
                for q, x in zip(ids.tolist(), vectors):
                    allowed = block.live
                    a, b = np.searchsorted(block.ids, q), np.searchsorted(block.ids, q, "right")
                    if b > a:
                        own = np.zeros(block.words * 64, np.uint8)
                        own[a:b] = 1
                        allowed = allowed & ~np.packbits(own, bitorder="little").view("<u8")
                    at = block.top(x, k, allowed)
                    out.append((np.full(len(at), q), block.ids[at], block.values[at] @ x))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    Both frames have (vec_id, embedding). The query blocks are copied to every index block, sorted
    behind it, and stream past it.
    """
    valid = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"

    def quantised(df: DataFrame) -> DataFrame:
        whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
        return df.where(valid).select(F.col("vec_id").cast("long"), whole.alias("v"))

    rows = quantised(vectors)
    asked = quantised(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    if not dims:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    packed = "block long, ids binary, vectors binary"
    blocks, query_blocks = -(-rows.count() // block_rows), max(1, -(-asked.count() // query_rows))
    # dealt in turn, so that blocks are of one size whatever the ids; a block is a partition
    index = stored(rows.repartition(blocks).mapInArrow(_block(dims), packed), "bit-sliced-index")
    asked = asked.repartition(query_blocks).mapInArrow(_block(dims), packed)
    copies = asked.drop("block").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    streams = index.select("block", "ids", "vectors", F.lit(False).alias("is_query")).unionByName(copies.select("block", "ids", "vectors", F.lit(True).alias("is_query")))
    streams = streams.repartitionByRange(blocks, "block").sortWithinPartitions("block", "is_query")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = streams.mapInArrow(_search(k, dims), SCHEMA).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")

