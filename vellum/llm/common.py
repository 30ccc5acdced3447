"""Small helpers that the training-data operators share."""

from __future__ import annotations

import itertools
import json
import os
import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

VOCAB_NAME = "word_bpe_49k.json"
END_ID = 2


def vocabulary(name: str = VOCAB_NAME) -> str:
    """Path of a public vocabulary file that is installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the session names none, a fresh folder of this machine is set in local mode (tests); a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder's name inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Bounds the Arrow batches of this session, so that Python workers hold few texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def stored(df: DataFrame, what: str, **options) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = work_dir(spark, what)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Rows:
    """Growing rows of ids: row k is ``flat[first[k] : first[k] + size[k]]``."""

    def __init__(self, dtype):
        self.flat, self.first, self.size = np.empty(0, dtype), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        first = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])
        self.first, self.size = np.concatenate([self.first, first]), np.concatenate([self.size, size])

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows ``at`` in a row, and their sizes."""
        size = self.size[at]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        return self.flat[np.repeat(self.first[at] - (stop - size), size) + np.arange(total)], size


class _Numbers(dict):
    """Numbers of words; a word asked for the first time takes the next number and is noted as new."""

    def __init__(self, first=()):
        super().__init__(zip(first, itertools.count()))
        self.new: list = []

    def __missing__(self, word) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n

    def of(self, words: list) -> tuple[np.ndarray, list]:
        """The words' numbers, by one look-up each, and the new ones among the words."""
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        new, self.new = self.new, []
        return at, new


#: Letters below U+0100 between marks that the vocabulary's splitter keeps apart from letters; or any other word.
_MARKS = r"[!-&(-/:;=-@\[-`{-~]*"
_PARTS = re.compile(rf"(?:({_MARKS})([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)({_MARKS})|([^ ]+))(?: |$)")


class WordEncoder:
    """Token ids of texts, by way of a cache of words.

    The vocabulary's splitter never joins characters across white space, nor a letter and the ASCII
    marks around it (apostrophes aside, and the sign that added tokens begin with), and its normaliser works within a word and lowers case. So
    a text's ids are its words' ids in a row, and a Latin word's ids are those of the marks before
    it, of its lower-case letters, and of the marks after it. Each distinct piece is encoded once by
    the tokenizers library (Latin ones many at a time: a word's last id is marked as such in the
    vocabulary); a text is then a gather over the cache. ``max_words`` bounds the cache: beyond it
    words met once are forgotten, and learned anew with the same ids if met again.
    """

    def __init__(self, path: str, end_id: int = END_ID, max_words: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # for lower-case Latin letters, which the vocabulary's own steps would leave as they are; each is met once, so the library caches none
        self.plain = Tokenizer(models.BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=model["end_of_word_suffix"]))
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if not all("<" in token.content for token in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens must hold the mark that no part of a word has")
        vocabulary = self.tokenizer.get_vocab()
        self.is_last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.end_id, self.max_words = end_id, max_words
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._reset()

    def _reset(self) -> None:
        self.number = _Numbers(["\n", ""])  # a document's end, which no word is, and what stands before its first white space
        self.words, self.piece, self.pieces = _Rows(self.dtype), _Numbers([""]), _Rows(self.dtype)
        self.words.add(np.array([self.end_id]), np.array([1, 0]))
        self.pieces.add(np.empty(0, self.dtype), np.array([0]))
        self.uses = np.zeros(2, np.int64)

    def _shrink(self) -> None:
        """Keeps the words that were met more than once, half of the bound at most, and forgets the rest."""
        least = 2
        if (self.uses >= least).sum() > self.max_words // 2:
            least = max(least, int(np.partition(self.uses, -(self.max_words // 2))[-(self.max_words // 2)]) + 1)
        kept = self.uses >= least
        kept[:2] = True
        flat, size = self.words.take(np.flatnonzero(kept))
        uses, number = self.uses[kept] // 2, self.number
        self._reset()
        self.number = _Numbers(w for w, k in zip(number, kept.tolist()) if k)
        self.words = _Rows(self.dtype)
        self.words.add(flat, size)
        self.uses = uses

    def _learn(self, words: list[str]) -> None:
        before, stems, after, others = zip(*_PARTS.findall(" ".join(words)))
        stems, plain = self.piece.of(" ".join(stems).lower().split(" "))
        n = len(words)
        rest, other = self.piece.of([*before, *after, *others])
        if plain:
            lines = [" ".join(plain[k : k + 4096]) for k in range(0, len(plain), 4096)]
            found = self.plain.encode_batch_fast(lines, add_special_tokens=False)
            flat = np.fromiter(itertools.chain.from_iterable(x.ids for x in found), self.dtype)
            size = np.diff(np.flatnonzero(self.is_last[flat]), prepend=-1)
            if len(size) != len(plain):
                raise ValueError("a piece's last id must be marked as such in the vocabulary")
            self.pieces.add(flat, size)
        if other:
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
            self.pieces.add(np.fromiter(itertools.chain.from_iterable(ids), self.dtype), np.fromiter(map(len, ids), np.int64, len(ids)))
        parts = np.stack([rest[:n], stems, rest[n : 2 * n], rest[2 * n :]], axis=1).ravel()  # a missing part has no ids
        flat, _ = self.pieces.take(parts)
        self.words.add(flat, self.pieces.size[parts].reshape(n, 4).sum(axis=1))

    def forget(self) -> None:
        """Gives the cache's memory back, as a worker may do other work next."""
        self._reset()

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, the end id after each text, and the ids' count per text."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not len(texts):
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        if len(self.number) > self.max_words:
            self._shrink()
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        own, new = self.number.of(coded.dictionary.to_pylist())
        if new:
            self._learn(new)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy()) + np.arange(len(texts))
        at = np.zeros(len(coded) + len(texts), np.int64)  # the end's number
        is_word = np.ones(len(at), bool)
        is_word[ends] = False
        at[is_word] = own[coded.indices.to_numpy()]
        uses = np.bincount(at, minlength=len(self.number))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        ids, size = self.words.take(at)
        return ids, np.diff(np.cumsum(size)[ends], prepend=0)


@lru_cache(maxsize=1)
def word_encoder(path: str, end_id: int = END_ID) -> WordEncoder:
    """The encoder of this Python worker; tasks that reuse the worker find its words known."""
    return WordEncoder(path, end_id)


def beside(df: DataFrame, column, name: str) -> tuple[DataFrame, str]:
    """``df`` with ``column`` added under a name like ``name`` that no column of it has, and that name."""
    while name in df.columns:
        name = "_" + name
    return df.withColumn(name, column), name


def batches(it, rows: int = 512):
    """Arrow batches cut to at most ``rows`` rows, so that a task holds few texts at once."""
    for batch in it:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
