"""Toxicity scores by weak supervision.

Lexicon voters are the words and word beginnings, found once or several times, that labelled
training rows tie significantly to label 1 and that are right more often than not there; pattern
voters look at how many of them a text has, how densely, at shouting, and at their absence. A
generative label model turns the votes into posterior labels, and a linear classifier is trained on
these. Every text is then scored by the classifier alone, whole.

Fitting uses at most ``MAX_LABELLED`` labelled rows (those with the least hash of ``doc_id``) that
are not held out, one text per id, equal texts once; scoring covers every row. The model's size is
bounded too: ``MAX_TOKENS`` features, those with the most evidence, ``MAX_VOTERS`` of them voters.
Neither bound depends on the table's size. Defined results: null and empty texts get the score of
a text without any known word; null ids are not held out; rows that repeat an id are scored each by
its own text, and the text with the least hash trains; labels that are null or neither 0 nor 1 are
left out, a document or text labelled both ways counts as toxic; without training rows of both
kinds every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batches, beside, small_batches, stored
from .label_model import posteriors

MAX_LABELLED = 20_000
FOLDS = 5
#: Known words and beginnings, those of them that vote, and the least evidence (G squared) for either.
MAX_TOKENS, MAX_VOTERS, LEAST_EVIDENCE = 4096, 96, 12.0
PREFIXES = (4, 5, 6, 7, 8)
#: A token is a word or beginning found at least so often in a text; it is written "text|times".
TIMES = (1, 2, 3)
#: Words and tokens that a Python worker remembers at once.
MAX_CACHED = 150_000
PENALTY, DESCENTS = 0.2, 400

_WORD = re.compile(r"[^\W\d_]+")


def stems_of(word: str) -> list[str]:
    """A word as itself (marked by its end) and its beginnings."""
    return [word + "$"] + [word[:n] for n in PREFIXES if len(word) >= n]


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of the labelled rows to fit on, one text per id, each distinct text once.

    Copies are no evidence of their own: a token's counts are of distinct texts.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(known), "id")  # known: at most max_labelled rows
    found = found.groupBy("id").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    return found.groupBy("text").agg(F.max("toxic").alias("toxic"))


def _token_counts(it):
    """Documents of each kind that have a token, summed within the partition as far as memory allows."""
    counts: tuple[Counter, Counter] = Counter(), Counter()

    def flush():
        names = list(dict.fromkeys([*counts[0], *counts[1]]))
        return pa.RecordBatch.from_pydict({"token": pa.array(names, pa.string()), "n0": pa.array([counts[0][t] for t in names], pa.int64()), "n1": pa.array([counts[1][t] for t in names], pa.int64())})

    for batch in batches(it):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            stems: Counter = Counter()
            for word, times in Counter(_WORD.findall((text or "").lower())).items():
                for stem in stems_of(word):
                    stems[stem] += times
            counts[toxic].update([f"{stem}|{n}" for stem, times in stems.items() for n in TIMES if times >= n])
        if len(counts[0]) + len(counts[1]) > MAX_CACHED:
            yield flush()
            counts = Counter(), Counter()
    yield flush()


def _evidence(n0: np.ndarray, n1: np.ndarray, all0: int, all1: int) -> np.ndarray:
    """G squared of token against label, negative where the token speaks for label 0."""
    table = np.array([[n1, all1 - n1], [n0, all0 - n0]], float)
    expected = table.sum(axis=1, keepdims=True) * table.sum(axis=0, keepdims=True) / (all0 + all1)
    g = 2 * (table * np.log(np.maximum(table, 1e-12) / np.maximum(expected, 1e-12))).sum(axis=(0, 1))
    return np.where(n1 * all0 > n0 * all1, g, -g)


def _distinct(tokens: list[str]) -> list[str]:
    """Drops a token where a better one (they come best first) is a beginning of it or begins with it."""
    kept: list[str] = []
    stems: set[str] = set()
    begun: set[str] = set()
    for token in tokens:
        stem = token.rsplit("|", 1)[0]
        starts = {stem[:n] for n in range(1, len(stem) + 1)}
        if not starts & stems and stem not in begun:
            kept.append(token)
            stems.add(stem)
            begun |= starts
    return kept


class Voters:
    """Looks a text's known tokens up, and votes."""

    def __init__(self, tokens: list[str], n_lexicon: int):
        self.at: dict[str, list[tuple[int, int]]] = {}
        for k, token in enumerate(tokens):
            stem, times = token.rsplit("|", 1)
            self.at.setdefault(stem, []).append((int(times), k))
        self.n_lexicon = n_lexicon
        self.words: dict[str, tuple[str, ...]] = {}

    def hits(self, text: str | None) -> tuple[list[int], int, bool]:
        """The text's known tokens, its count of words, and whether it shouts."""
        text = text or ""
        words = self.words
        if len(words) > MAX_CACHED:
            words.clear()
        every = Counter(_WORD.findall(text.lower()))
        stems: Counter = Counter()
        for w, times in every.items():
            own = words.get(w)
            if own is None:
                own = words[w] = tuple(t for t in stems_of(w) if t in self.at)
            for stem in own:
                stems[stem] += times
        found = [k for stem, times in stems.items() for least, k in self.at[stem] if times >= least]
        shouts = text.count("!") >= 3 and sum(w.isupper() and len(w) > 3 for w in _WORD.findall(text)) >= 3
        return sorted(found), every.total(), shouts

    def votes(self, hits: list[int], n_words: int, shouts: bool) -> list[int]:
        own = [k for k in hits if k < self.n_lexicon]
        lexicon = [0] * self.n_lexicon
        for k in own:
            lexicon[k] = 1
        return lexicon + [
            1 if len(own) >= 3 else 0,
            1 if own and 100 * len(own) >= n_words else 0,
            1 if shouts else 0,
            0 if own else -1,
            0 if hits else -1,
        ]


def _descend(rows: np.ndarray, cols: np.ndarray, n: int, m: int, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels with an L2 penalty, by adaptive gradient descent."""
    w, g1, g2 = np.zeros(m + 1), np.zeros(m + 1), np.zeros(m + 1)
    w[-1] = np.log(target.mean() / (1 - target.mean()))
    for t in range(1, DESCENTS + 1):
        z = np.bincount(rows, w[cols], n) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - target
        grad = np.append(np.bincount(cols, error[rows], m) + PENALTY * w[:-1], error.sum())
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.999 * g2 + 0.001 * grad**2
        w -= 0.1 * (g1 / (1 - 0.9**t)) / (np.sqrt(g2 / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


class ToxicityModel:
    """A linear classifier over a bounded list of tokens; small enough to go with each task."""

    def __init__(self, tokens: list[str], weights: list[float], bias: float | None):
        self.tokens, self.weights, self.bias = tokens, weights, bias

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicityModel:
        small_batches(docs.sparkSession)
        rows = stored(training_rows(docs, labels, max_labelled), "toxicity-training")
        kinds = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
        all0, all1 = kinds.get(0, 0), kinds.get(1, 0)
        if not all0 or not all1:
            return cls([], [], None)
        counts = rows.mapInArrow(_token_counts, "token string, n0 long, n1 long").groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        counts = stored(counts, "toxicity-tokens")
        tested = counts.where("n0 + n1 > 1").count()
        least = max(LEAST_EVIDENCE, 2 * math.log(max(tested, 1)))  # what the best of so many would have by chance
        n = all0 + all1
        expected = {k: (F.col("n0") + F.col("n1")) * (a / n) for k, a in ((0, all0), (1, all1))}
        cell = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
        g = 2 * (cell(F.col("n0"), expected[0]) + cell(F.col("n1"), expected[1]) + cell(all0 - F.col("n0"), all0 - expected[0]) + cell(all1 - F.col("n1"), all1 - expected[1]))
        best = counts.withColumn("g", g).where(F.col("g") >= least).orderBy(F.desc("g"), F.desc(F.length("token")), "token").limit(MAX_TOKENS).collect()
        speaks = _evidence(np.array([r.n0 for r in best]), np.array([r.n1 for r in best]), all0, all1) if best else np.empty(0)
        precise = [s > 0 and r.n1 >= r.n0 for r, s in zip(best, speaks)]
        lexicon = _distinct([r.token for r, own in zip(best, precise) if own])
        tokens = lexicon + _distinct([r.token for r, own in zip(best, precise) if not own])

        voters = Voters(tokens, min(len(lexicon), MAX_VOTERS))

        def look_up(it):
            for batch in batches(it):
                found = [voters.hits(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"hits": pa.array([f[0] for f in found], pa.list_(pa.int64())), "n": pa.array([f[1] for f in found], pa.int64()), "shouts": pa.array([f[2] for f in found], pa.bool_()), "toxic": batch.column("toxic")})

        seen = rows.mapInArrow(look_up, "hits array<long>, n long, shouts boolean, toxic int").toPandas()  # at most max_labelled rows of known tokens
        votes = np.array([voters.votes(list(h), int(n), bool(s)) for h, n, s, _ in seen.itertuples(index=False)], np.int8)
        target, _, _ = posteriors(votes, all1 / n, seen["toxic"].to_numpy())
        row = np.repeat(np.arange(len(seen)), seen["hits"].str.len())
        col = np.concatenate([np.asarray(h, np.int64) for h in seen["hits"]]) if len(row) else np.empty(0, np.int64)
        weights, bias = _descend(row, col, len(seen), len(tokens), np.clip(target, 1e-4, 1 - 1e-4))
        return cls(tokens, weights.tolist(), bias)

    def scores(self, texts: pa.Array) -> pa.Array:
        if self.bias is None:
            return pa.array(np.zeros(len(texts)))
        voters = _voters(tuple(self.tokens))
        w = np.array([*self.weights, 0.0])
        parts = (texts[k : k + 256].to_pylist() for k in range(0, len(texts), 256))  # few texts as objects at once
        z = np.array([w[voters.hits(t)[0]].sum() for part in parts for t in part]) + self.bias
        return pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))


@lru_cache(maxsize=1)
def _voters(tokens: tuple[str, ...]) -> Voters:
    return Voters(list(tokens), 0)


def scored(docs: DataFrame, model: ToxicityModel) -> tuple[DataFrame, str]:
    """``docs`` with their scores, in a column of a new name."""

    def score(texts: pa.Array) -> pa.Array:
        return model.scores(texts)

    return beside(docs, F.arrow_udf(score, "double").asNondeterministic()(F.col("text").cast("string")), "score")


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    rows, score = scored(docs.select("doc_id", "text"), ToxicityModel.fit(docs, labels, max_labelled))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score, (F.col(score) >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not taken for toxic, with all their columns."""
    rows, score = scored(docs, ToxicityModel.fit(docs, labels))
    return rows.where(F.col(score) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
