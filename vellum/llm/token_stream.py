"""Token ids in Arrow stream files with equal-length sequences and masks.

A file holds the ids of one range of documents, in ascending order of ``doc_id``, as one stream cut
into sequences of ``seq_len`` ids. Each record batch of the file (Arrow's stream format) has two
fixed-size-list columns, ``ids`` and ``mask``; only a file's last sequence is padded, and the mask
says where. Mapped into memory, any sequence is a view of the file. A second small stream file
beside it gives each document's first id and count.

Defined results: a null text is an empty one (only the end id); null ids sort first; rows that
repeat a ``doc_id`` stay, ordered by text hash; an empty table gives no rows; other columns of the
input are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import END_ID, batches, small_batches, vocabulary, word_encoder, work_dir

SEQ_LEN = 2048
SEQS_PER_BATCH = 256


def _schema(dtype, seq_len: int) -> pa.Schema:
    return pa.schema(
        [
            pa.field("ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)),
            pa.field("mask", pa.list_(pa.bool_(), seq_len)),
        ]
    )


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Appends ids to a stream file; a whole batch is written as soon as it is full."""

    def __init__(self, sink, dtype, seq_len: int = SEQ_LEN, seqs_per_batch: int = SEQS_PER_BATCH):
        self.schema, self.seq_len = _schema(dtype, seq_len), seq_len
        self.full = seq_len * seqs_per_batch
        self.parts, self.n = [np.empty(0, dtype)], 0
        self.writer = pa.ipc.new_stream(sink, self.schema)

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.writer.write_batch(
            pa.record_batch(
                [
                    pa.FixedSizeListArray.from_arrays(pa.array(ids), self.seq_len),
                    pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len),
                ],
                schema=self.schema,
            )
        )

    def append(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.n += len(ids)
        if self.n < self.full:
            return
        ids = np.concatenate(self.parts)
        whole = self.n - self.n % self.full
        for k in range(0, whole, self.full):
            self._batch(ids[k : k + self.full], self.full)
        self.parts, self.n = [ids[whole:].copy()], self.n - whole

    def close(self) -> None:
        if self.n:
            self._batch(np.pad(np.concatenate(self.parts), (0, -self.n % self.seq_len)), self.n)
        self.writer.close()


@dataclass
class SequenceFile:
    """Random access to a stream file's sequences; no id is copied on a local file system."""

    table: pa.Table

    @classmethod
    def open(cls, uri: str) -> SequenceFile:
        return cls(pa.ipc.open_stream(_source(uri)).read_all())

    def __len__(self) -> int:
        return self.table.num_rows

    def views(self, k: int) -> tuple[pa.Array, pa.BooleanArray]:
        """The k-th sequence's ids and mask as Arrow arrays, both views of the file (a mask takes one bit an id there)."""
        row = self.table.slice(k, 1)
        return tuple(row.column(c).chunk(0).flatten() for c in ("ids", "mask"))

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k-th sequence's ids, as a view of the file, and its mask, spread to a byte an id."""
        ids, mask = self.views(k)
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def _source(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)


def write_token_files(docs: DataFrame, folder: str, vocab: str | None = None, end_id: int = END_ID, seq_len: int = SEQ_LEN) -> list[dict]:
    """Writes ``docs`` (doc_id, text) as token files into ``folder``, a shared one.

    Documents are dealt to files by ranges of ``doc_id``; the text's hash and the row's place break
    ties, so that even one repeated id spreads over files. Returns one entry per file, in order:
    its uri and its counts of ids and documents. A task that runs again writes the same file anew
    and moves it into place only when whole.
    """
    vocab = vocab or vocabulary()
    small_batches(docs.sparkSession)

    def write(it):
        part = TaskContext.get().partitionId()
        encoder = None
        for batch in batches(it):
            if encoder is None:
                encoder = word_encoder(vocab, end_id)
                store, base = fs.FileSystem.from_uri(folder)
                store.create_dir(base, recursive=True)
                name, own = f"{base}/part-{part:06d}", f"{base}/_attempt-{TaskContext.get().taskAttemptId()}"
                ids_sink, docs_sink = store.open_output_stream(f"{own}.arrows"), store.open_output_stream(f"{own}.docs.arrows")
                sequences, index = SequenceWriter(ids_sink, encoder.dtype, seq_len), pa.ipc.new_stream(docs_sink, _DOCS)
                at = n_docs = 0
            ids, counts = encoder.encode(batch.column("text"))
            sequences.append(ids)
            starts = at + np.cumsum(counts) - counts
            index.write_batch(pa.record_batch([batch.column("doc_id"), pa.array(starts), pa.array(counts)], schema=_DOCS))
            at, n_docs = at + len(ids), n_docs + batch.num_rows
        if encoder is None:
            return
        sequences.close()
        index.close()
        ids_sink.close()
        docs_sink.close()
        for end in (".docs.arrows", ".arrows"):
            store.move(own + end, name + end)
        yield pa.RecordBatch.from_pydict({"part": [part], "n_ids": [at], "n_docs": [n_docs]})

    ordered = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .withColumns({"h": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
        .repartitionByRange("doc_id", "h", "tie")
        .sortWithinPartitions("doc_id", "h", "tie")
        .select("doc_id", "text")
    )
    parts = ordered.mapInArrow(write, "part long, n_ids long, n_docs long").collect()  # a row per file
    return [{"uri": f"{folder}/part-{r.part:06d}", "n_ids": r.n_ids, "n_docs": r.n_docs} for r in sorted(parts)]


def read_token_files(spark, files: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""

    def read(it):
        for batch in it:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist()):
                index = pa.ipc.open_stream(_source(f"{uri}.docs.arrows")).read_all()
                sums = np.zeros(index.num_rows, np.int64)
                first, count = (index.column(c).to_numpy() for c in ("start", "n_tokens"))
                last, k, at = first + count, 0, 0
                for seqs in pa.ipc.open_stream(_source(f"{uri}.arrows")):
                    ids = seqs.column("ids").flatten().to_numpy()
                    real = len(ids) if seqs.column("mask").flatten().true_count == len(ids) else int(seqs.column("mask").flatten().true_count)
                    data = memoryview(ids[:real].astype("<u4")).cast("B")
                    while k < len(sums) and first[k] < at + real:
                        a, b = max(first[k] - at, 0), min(last[k] - at, real)
                        sums[k] = zlib.crc32(data[4 * a : 4 * b], int(sums[k]))
                        if last[k] > at + real:  # it goes on in the next batch
                            break
                        k += 1
                    at += real
                yield pa.RecordBatch.from_arrays(
                    [index.column("doc_id").combine_chunks(), pa.array(first + start), pa.array(count), pa.array(sums)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    starts = np.cumsum([0] + [f["n_ids"] for f in files])
    rows = [(f["uri"], int(s)) for f, s in zip(files, starts)]
    listed = spark.createDataFrame(rows, "uri string, start long").repartitionByRange(len(rows), "start")
    return listed.mapInArrow(read, schema)


def token_stream(docs: DataFrame, vocab: str | None = None, seq_len: int = SEQ_LEN) -> DataFrame:
    """Encodes ``docs`` into token files in the shared folder and reads them back."""
    spark = docs.sparkSession
    files = write_token_files(docs, work_dir(spark, "token-files"), vocab, seq_len=seq_len)
    return read_token_files(spark, files)
