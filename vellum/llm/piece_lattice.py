"""SentencePiece encoding and decoding through a suffix array.

A batch's distinct words (runs of the space mark with what follows, up to a full stop or comma if no
piece joins one to a letter) are concatenated into one array
of code points and its suffixes are sorted as deep as the longest piece. Every piece of the
vocabulary is then searched in the suffix array, character by character, which gives the range of
its occurrences; the occurrences of all pieces are the edges of a lattice. Edges are sorted by
position and relaxed from left to right, in all words at once: a prefix's encoding has exactly one
last piece, the one whose piece before it is the last piece of the shorter prefix and stands beside
it stably, which means that no merge across the border would have come before the merges that made
the two. The ids are those of the library's own encoder for the same model. Characters outside the
vocabulary become byte pieces.

Words are remembered per Python worker, up to a bound. Defined results: null and empty texts have
no pieces; repeated rows give repeated results; null ids are kept; an empty table gives no rows;
texts of any length are read whole; other input columns are not read.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import _Rows, batches, small_batches, vocabulary

MODEL_NAME = "piece_bpe_32k.model"
SPACE = "▁"
BATCH_ROWS = 4096
MAX_WORDS = 800_000
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: For vocabularies without a piece that joins a letter and a stop after it: words end there too.
_WORD_OR_STOP = re.compile(rf"{SPACE}*[^{SPACE}.,]*[^\W\d_](?=[.,])|{SPACE}*[^{SPACE}]+|{SPACE}+")
_END = 0x110000  # stands between words; no character
_START, _OPEN, _BYTES = -3, -1, -2


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


class PieceTable:
    """The vocabulary: pieces by rank of merging, their splits, and all pairs that merge."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        self.texts = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(size):
            if model.is_byte(i):
                self.byte_ids[int(self.texts[i][1:-1], 16)] = i
        plain = [i for i in range(size) if not special[i]]
        if any(SPACE in self.texts[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece crosses words; they can't be encoded one by one")
        stops = any(a.isalpha() and b in ".," for i in plain for a, b in zip(self.texts[i], self.texts[i][1:]))
        self.word = _WORD if stops else _WORD_OR_STOP
        self.as_bytes = [bytes([int(t[1:-1], 16)]) if model.is_byte(i) else b"" if special[i] else t.encode() for i, t in enumerate(self.texts)]
        by_score = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.rank = np.zeros(size, np.int64)
        self.rank[by_score] = np.arange(1, len(by_score) + 1)
        at = {self.texts[i]: i for i in plain}
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        pairs = []
        made = np.zeros(size, bool)
        for i in plain:
            text = self.texts[i]
            if len(text) == 1:
                made[i] = True
                continue
            pairs += [(a, b, i) for k in range(1, len(text)) if (a := at.get(text[:k])) is not None and (b := at.get(text[k:])) is not None]
            split = self._last_merge(text, at)
            if split:
                made[i] = True
                self.left[i], self.right[i] = split
        self.size = size
        pairs = np.array(pairs, np.int64)
        keys = pairs[:, 0] * size + pairs[:, 1]
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], self.rank[pairs[order, 2]]
        self.searched = np.flatnonzero(made)
        self.chars = np.full((len(self.searched), int(self.length[self.searched].max())), -1, np.int64)
        for row, i in enumerate(self.searched):
            self.chars[row, : self.length[i]] = _codes(self.texts[i])

    def _last_merge(self, text: str, at: dict[str, int]) -> tuple[int, int] | None:
        """The two pieces of whose merge ``text`` is made, or None if merging doesn't lead to it."""
        parts, last = list(text), None
        while len(parts) > 1:
            best = min((self.rank[i], k) for k in range(len(parts) - 1) if (i := at.get(parts[k] + parts[k + 1])) is not None) if any(parts[k] + parts[k + 1] in at for k in range(len(parts) - 1)) else None
            if best is None:
                return None
            k = best[1]
            last = at.get(parts[k], -1), at.get(parts[k + 1], -1)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return last

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b stay apart: their merges are undone, the latest first, and before each
        the two pieces at the border must have no merge that would have come earlier."""
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            keys = a * self.size + b
            where = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            merges = (self.pair_keys[where] == keys) & (self.pair_rank[where] < limit)
            good[live[merges]] = False
            # single characters are never undone
            ra, rb = np.where(self.left[a] < 0, 0, self.rank[a]), np.where(self.left[b] < 0, 0, self.rank[b])
            keep = ~merges & ((ra > 0) | (rb > 0))
            live, a, b, ra, rb = live[keep], a[keep], b[keep], ra[keep], rb[keep]
            undo_left = ra > rb  # of equal merges the left one came first
            limit = np.where(undo_left, ra, rb + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return good


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the ``depth`` code points from each on: as many as fit into one integer
    are sorted at once, and doubling goes on from there."""
    kinds, rank = np.unique(codes, return_inverse=True)
    bits = int(len(kinds)).bit_length()  # 0 stands for what is beyond the end
    reach = min(63 // bits, depth)
    key = np.zeros(len(codes), np.int64)
    for k in range(reach):
        key <<= bits
        key[: max(len(codes) - k, 0)] |= rank[k:] + 1
    order = np.argsort(key, kind="stable")
    while reach < depth:
        key = key[order]
        rank = np.empty(len(codes), np.int64)
        rank[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        after = np.zeros(len(codes), np.int64)
        after[:-reach] = rank[reach:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        reach *= 2
    return order


def occurrences(codes: np.ndarray, order: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row of ``chars`` the range of ``order`` whose suffixes begin with it."""
    n = len(order)
    padded = np.concatenate([codes, np.full(chars.shape[1] + 1, -2)])
    low, high = np.zeros(len(chars), np.int64), np.full(len(chars), n, np.int64)
    for c in range(chars.shape[1]):
        live = np.flatnonzero((chars[:, c] >= 0) & (low < high))
        if not len(live):
            break
        want = chars[live, c]
        for side, out in ((0, low), (1, high)):
            a, b = low[live].copy(), high[live].copy()
            if side:
                a = low[live].copy()
            while True:
                open_ = a < b
                if not open_.any():
                    break
                mid = (a + b) // 2
                found = padded[order[np.minimum(mid, n - 1)] + c]
                right = (found < want) if side == 0 else (found <= want)
                a = np.where(open_ & right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            if side == 0:
                new_low = a
            else:
                new_high = a
        low[live], high[live] = new_low, new_high
    return low, high


class PieceEncoder:
    def __init__(self, path: str):
        self.table = PieceTable(path)
        self.number: dict[str, int] = {}
        self.words = _Rows(np.int32)

    def _learn(self, words: list[str]) -> None:
        t = self.table
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths + 1) - lengths - 1
        codes = _codes("\0".join(words) + "\0")
        ends = starts + lengths
        codes[ends] = _END
        order = suffix_array(codes, t.chars.shape[1]).astype(np.int32)
        low, high = occurrences(codes, order, t.chars)
        count = high - low
        piece = np.repeat(t.searched.astype(np.int32), count)
        start = order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        known = np.zeros(len(codes), bool)
        known[start[t.length[piece] == 1]] = True
        strange = np.flatnonzero(~known & (codes != _END))  # becomes bytes
        start = np.concatenate([start, strange.astype(np.int32)])
        piece = np.concatenate([piece, np.full(len(strange), _BYTES, np.int32)])
        steps = np.arange(len(codes)) - np.repeat(starts, lengths + 1)  # place in the word
        steps = steps.astype(np.int16 if lengths.max() < 1 << 15 else np.int64)
        step = steps[start]
        by_place = np.argsort(step, kind="stable")
        start, piece, step = start[by_place], piece[by_place], step[by_place]
        stop = start + np.where(piece == _BYTES, 1, t.length[piece])

        last = np.full(len(codes) + 1, _OPEN)
        last[starts] = _START
        cuts = np.flatnonzero(np.r_[True, step[1:] != step[:-1], True]) if len(step) else np.array([0])
        for a, b in zip(cuts[:-1], cuts[1:]):
            s, p, e = start[a:b], piece[a:b], stop[a:b]
            before = last[s]
            ok = before != _OPEN
            s, p, e, before = s[ok], p[ok], e[ok], before[ok]
            free = (before < 0) | (p < 0)
            ok = free.copy()
            ok[~free] = t.stable(before[~free], p[~free])
            last[e[ok]] = p[ok]

        # back from the ends, in all words at once
        at, live, found = ends.copy(), np.arange(len(words)), []
        while True:
            more = at[live] > starts[live]
            live = live[more]
            if not len(live):
                break
            p = last[at[live]]
            if (p == _OPEN).any():
                raise ValueError("a word has no encoding")
            at[live] -= np.where(p == _BYTES, 1, t.length[p])
            found.append((live, at[live].copy(), p))
        w, pos, p = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((pos, w))
        w, pos, p = w[order], pos[order], p[order]
        if (p == _BYTES).any():
            as_ids = [t.byte_ids[np.frombuffer(chr(codes[k]).encode("utf-8", "surrogatepass"), np.uint8)] if q == _BYTES else [q] for k, q in zip(pos, p)]
            size = np.fromiter(map(len, as_ids), np.int64, len(as_ids))
            flat = np.concatenate(as_ids)
            sizes = np.bincount(w, size, len(words)).astype(np.int64)
        else:
            flat, sizes = p, np.bincount(w, minlength=len(words))
        n = len(self.number)
        self.number.update(zip(words, range(n, n + len(words))))
        self.words.add(flat, sizes)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.number) > MAX_WORDS:
            self.number, self.words = {}, _Rows(np.int32)
        normal, find = self.table.model.normalize, self.table.word.findall
        words: list[str] = []
        ends = []
        for text in texts:
            if text:
                words += find(normal(text))
            ends.append(len(words))
        if new := [w for w in dict.fromkeys(words) if w not in self.number]:
            self._learn(new)
        ids, size = self.words.take(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
        total = np.concatenate([[0], np.cumsum(size)])[ends]
        return np.split(ids, total[:-1]) if len(texts) else []

    def decode(self, ids) -> str:
        """The text of ids: bytes are joined, space marks become spaces, the first one goes."""
        pieces = self.table.as_bytes
        text = b"".join([pieces[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=1)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encode_pieces(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): every text's piece ids, and the text decoded from them."""
    path = model or vocabulary(MODEL_NAME)
    small_batches(docs.sparkSession, "16m")

    def run(it):
        encoder = piece_encoder(path)
        for batch in batches(it, BATCH_ROWS):
            ids = encoder.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([encoder.decode(x.tolist()) for x in ids], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_chars, decoded_crc32, round_trip) of every text."""
    path = model or vocabulary(MODEL_NAME)
    small_batches(docs.sparkSession, "16m")

    def run(it):
        encoder = piece_encoder(path)
        for batch in batches(it, BATCH_ROWS):
            texts = batch.column("text").to_pylist()
            ids = encoder.encode(texts)
            decoded = [encoder.decode(x.tolist()) for x in ids]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_pieces": pa.array(list(map(len, ids)), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    "decoded_chars": pa.array(list(map(len, decoded)), pa.int64()),
                    "decoded_crc32": pa.array([zlib.crc32(x.encode()) for x in decoded], pa.int64()),
                    "round_trip": pa.array([a == (b or "") for a, b in zip(decoded, texts)], pa.bool_()),
                }
            )

    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_chars long, decoded_crc32 long, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
