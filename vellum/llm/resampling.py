"""Importance resampling towards a target corpus, from a sparse document-by-bucket count matrix.

Word runs are hashed into buckets. Documents in a row become a block of the count matrix in
compressed sparse rows, of a bounded number of entries, written once; all else reads them. Column sums,
a vector per task, give the corpus's and the target's bucket distributions; the log ratio of the two
is a bucket's gain, and the blocks' sparse product with the gains gives the documents' weights. With a
Gumbel noise that the id decides, the highest sums are a sample without replacement. Scores are put in
order by a range-partitioned sort, so ranks are partition counts and places; ties and repeated rows
spread over partitions by their place.

Sent around or to the driver: a number per bucket (``buckets``, a parameter) and per partition.

Defined results: a null or empty text has no features and weight 0; a null id has a null score, is
never drawn and doesn't count among the documents drawn from; repeated rows are drawn one by one, tied
ones by features, weight and place; an empty target leaves the smoothed distribution alone; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import small_batches, stored

BUCKETS = 10_000
RUN = 1
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
#: Entries of a block at most (a document's row, and 64 for each row, beyond).
BLOCK = 32_768

#: On lower-cased UTF-8: digits, letters, and all bytes of characters beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BLOCK = "first_row long, doc_id array<long>, n_words array<long>, indptr array<long>, indices array<int>, counts array<long>"


def _row(text: bytes | None, run: int, buckets: int) -> tuple[int, np.ndarray, np.ndarray]:
    """A text's words, and its matrix row: buckets in ascending order and their counts."""
    words = _WORD.findall((text or b"").lower())
    times = Counter(words)
    for n in range(2, run + 1):
        times.update(map(b" ".join, zip(*(words[k:] for k in range(n)))))
    hashed = np.fromiter(map(zlib.crc32, times), np.int64, len(times)) % buckets
    found, at = np.unique(hashed, return_inverse=True)
    counts = np.zeros(len(found), np.int64)
    np.add.at(counts, at, np.fromiter(times.values(), np.int64, len(times)))
    return len(words), found, counts


def count_matrix(docs: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """The documents' counts as blocks of compressed sparse rows, stored: ids, words and rows of a batch each."""
    small_batches(docs.sparkSession)

    names = ["first_row", "doc_id", "n_words", "indptr", "indices", "counts"]
    types = [pa.int64(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.int32()), pa.list_(pa.int64())]

    def block(first_row: int, ids: list, words: list, indices: list, counts: list):
        columns = [[first_row], [ids], [words], [np.cumsum([0, *map(len, indices)])], [np.concatenate(indices)], [np.concatenate(counts)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def blocks(it):
        at, size = TaskContext.get().partitionId() << 40, 0  # rows of a partition are numbered on from here
        held: list[list] = [[], [], [], []]
        for batch in it:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for column, value in zip(held, (doc_id, *_row(text.as_py(), run, buckets))):
                    column.append(value)
                size += len(held[2][-1]) + 64
                if size >= BLOCK:
                    yield block(at, *held)
                    at, size, held = at + len(held[0]), 0, [[], [], [], []]
        if held[0]:
            yield block(at, *held)

    if "doc_id" not in docs.columns:  # a target corpus needs no ids
        docs = docs.withColumn("doc_id", F.lit(None).cast("long"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    # few blocks a file and a check of sizes at each: readers and writers hold batches of rows, and a block is one
    return stored(rows.mapInArrow(blocks, _BLOCK), "count-matrix", **{"maxRecordsPerFile": 128, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1})


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's count over all rows: a vector per task, then a row per bucket."""

    def add(it):
        total = np.zeros(buckets, np.int64)
        for batch in it:
            for k in range(batch.num_rows):
                np.add.at(total, batch.column("indices")[k].values.to_numpy(), batch.column("counts")[k].values.to_numpy())
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in matrix.select("indices", "counts").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # at most a row per bucket
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of the smoothed target to the smoothed corpus, in thousandths rounded down."""
    buckets = len(corpus)
    s_all, t_all = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: int, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(matrix: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, place) of each row: the matrix times the gains, and noise."""

    def product(it):
        for batch in it:
            for k in range(batch.num_rows):
                doc_id, words, indptr, indices, counts = (batch.column(c)[k].values for c in ("doc_id", "n_words", "indptr", "indices", "counts"))
                indptr, indices, counts = indptr.to_numpy(), indices.to_numpy(), counts.to_numpy()
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[indptr])  # noqa: B023, E731
                weight, ids = sums(gain[indices] * counts), doc_id.to_pylist()
                score = [None if i is None else w + noise(i, seed) for i, w in zip(ids, weight.tolist())]
                place = batch.column("first_row")[k].as_py() + np.arange(len(ids))
                yield pa.RecordBatch.from_arrays([doc_id, words, pa.array(sums(counts)), pa.array(weight), pa.array(score, pa.int64()), pa.array(place)], names=["doc_id", "n_words", "n_features", "weight", "score", "place"])

    return matrix.mapInArrow(product, "doc_id long, n_words long, n_features long, weight long, score long, place long")


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with their rank (from 1) in a total order: sorted ranges, counted, then numbered."""

    def number(it):
        n = 0
        for batch in it:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(n + 1, n + 1 + batch.num_rows))], names=[*batch.schema.names, "own"])
            n += batch.num_rows

    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("own", T.LongType())])
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranges = stored(ranges.mapInArrow(number, schema), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranges.groupBy("part").agg(F.max("own").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return ranges.join(F.broadcast(parts), "part").withColumn("rank", F.col("own") + F.col("before")).drop("part", "own", "before")  # parts: a row per partition


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; ranks are those of the rows drawn."""
    if not 0 <= percent <= 100 or run < 1 or buckets < 1:
        raise ValueError("a percentage, a run length and a number of buckets are asked for")
    matrix = count_matrix(docs, run, buckets)
    gain = gains(column_sums(matrix, buckets), column_sums(count_matrix(target, run, buckets), buckets))
    rows = weighted(matrix, gain, seed)
    may = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    drawn = ranked(rows.where(may), [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("place")])
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= matrix_count(matrix, least_words) * percent // 100, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(*columns).unionByName(rows.where(~may).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def matrix_count(matrix: DataFrame, least_words: int) -> int:
    """Rows with an id and enough words."""
    held = F.expr(f"aggregate(zip_with(doc_id, n_words, (d, n) -> if(d is not null and n >= {int(least_words)}, 1L, 0L)), 0L, (a, b) -> a + b)")
    return matrix.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0]
