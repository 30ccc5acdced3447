"""Contiguous shards of nearly equal bytes, by global prefix sums.

Rows are put in order of ``doc_id``, each partition's totals are summed, and the prefix sums of the
totals tell every partition how many bytes stand before it. A row whose bytes' middle lies in the
k-th of equal parts of all bytes goes to shard k. Only each row's id, size and checksum move;
only one row of totals per partition meets in one place.

Defined results: a null text has no bytes (checksum 0) and counts its 8; null ids sort first; equal
ids are ordered by checksum and place, so one repeated id can span shards; an empty table gives no
rows; other input columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import shared_dir

ROW_BYTES = 8

SCHEMA = "doc_id long, size long, text_crc32 long, shard int, row long"


def shard_by_bytes(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``."""
    shared_dir(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = ("doc_id", "text_crc32", "tie")
    rows = (
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("tie"),
        )
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .checkpoint()  # the order is fixed from here on
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (  # a row per partition
        rows.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
        )
    )

    def place(it):
        part, at, n = None, 0, 0
        for batch in it:
            if not batch.num_rows:
                continue
            size = batch.column("size").to_numpy()
            if batch.column("part")[0].as_py() != part:  # one part per partition: the first batch
                part, at, n = (batch.column(c)[0].as_py() for c in ("part", "bytes_before", "rows_before"))
            total = batch.column("all_bytes")[0].as_py()
            stop = at + np.cumsum(size)
            shard = np.minimum(shards * (2 * stop - size) // (2 * total), shards - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), pa.array(shard.astype(np.int32)), pa.array(n + np.arange(len(size)))],
                names=["doc_id", "size", "text_crc32", "shard", "row"],
            )
            at, n = int(stop[-1]), n + len(size)

    placed = rows.join(F.broadcast(parts), "part").mapInArrow(place, SCHEMA)  # parts: a row per partition
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # a row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
