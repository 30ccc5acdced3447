"""Quality rules: base rules, then robust multivariate outliers within a language and source.

Each document has a vector of four transformed statistics (mean word length, symbols per word, share
of duplicate lines, share of words in repeated windows). Per language and source, and per language,
the minimum covariance determinant estimate of centre and scatter is approached by concentration
steps from two robust starts: take the half of the vectors that lie nearest under the present
estimate, estimate from them, repeat; the start with the smaller determinant goes on. Every step is
an aggregation over all documents (a quantile sketch, then sums), so no group is gathered anywhere,
and a group's estimate stays a row of a table. A document is rejected beyond the cut-off of its
squared Mahalanobis distance.

The scatter has a floor per statistic, so that a group of nearly equal documents rejects nothing
for a tiny difference, and a source's centre leans on its language's as ``LEAN`` documents would.

Defined results: a null or blank text has no words and fails the base rules; null languages and
sources are groups of their own; repeated rows count as often as they stand; an empty table gives
no rows; the operator reads only its four columns, whatever others there are.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import beside, small_batches, stored

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Least standard deviation of each transformed statistic.
FLOORS = (0.12, 0.25, 0.15, 0.15)
LEAN = 20
#: Upper tail of the chi-square law with four degrees of freedom beyond which a vector is rejected.
TAIL = 1e-4
FIRST_STEPS, MORE_STEPS = 2, 4
#: Estimates up to this many rows (of about 300 bytes) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
X = ("x0", "x1", "x2", "x3")
STATS = ", ".join([f"{c} long" for c in COUNTS] + [f"{x} double" for x in X])


def count(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The five counts of ``COUNTS`` and the number of lines that have a word."""
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    n, repeated = len(words), 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        hit = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= hit
        repeated = int(covered.sum())
    blanks = len(data) - len(data.translate(None, BLANKS))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return n, len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def _statistics(texts: pa.Array) -> pa.Array:
    parts = (texts[k : k + 256].to_pylist() for k in range(0, len(texts), 256))  # few texts as objects at once
    n = np.array([count(t) for part in parts for t in part], np.int64).reshape(-1, 6)
    words, lines = np.maximum(n[:, 0], 1), np.maximum(n[:, 5], 1)
    vectors = np.log(np.maximum(n[:, 1], 1) / words), np.log1p(10 * n[:, 2] / words), n[:, 3] / lines, n[:, 4] / words
    return pa.StructArray.from_arrays([pa.array(c) for c in (*n[:, :5].T, *vectors)], [*COUNTS, *X])


def _base_failed(s: str) -> F.Column:
    return (F.col(f"{s}.n_words") < MIN_WORDS) | (100 * F.col(f"{s}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{s}.n_words"))


def _key(*names: str) -> F.Column:
    return F.to_json(F.struct(*[F.col(n).cast("string").alias(n) for n in names]))


def _with_statistics(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with their statistics, in a column of a new name."""
    small_batches(docs.sparkSession)
    statistics = F.arrow_udf(_statistics, STATS).asNondeterministic()  # once, in this projection
    return beside(docs, statistics(F.col("text").cast("string")), "statistics")


def chi_square_4(x: float) -> float:
    return 1 - math.exp(-x / 2) * (1 + x / 2)


def chi_square_4_quantile(p: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_4(mid) < p else (low, mid)
    return low


CUT_OFF = chi_square_4_quantile(1 - TAIL)
_HALF = chi_square_4_quantile(0.5)
#: Makes the scatter of the nearest half that of the whole, under a normal law.
_CONSISTENT = 0.5 / (1 - math.exp(-_HALF / 2) * (1 + _HALF / 2 + _HALF**2 / 8))

_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
_ESTIMATE = "key string, start int, n double, " + ", ".join([f"c{i} double" for i in range(4)] + [f"p{i}{j} double" for i, j in _PAIRS]) + ", log_det double"


def _precision(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scatter = scatter + np.diag(np.square(FLOORS))
    return np.linalg.inv(scatter), np.linalg.slogdet(scatter)[1]


def _estimates(scale: float):
    """Sums over the chosen vectors of each group, to centre, inverse scatter and log determinant."""

    def run(frames):
        for f in frames:
            n = f["n"].to_numpy()
            centre = np.stack([f[f"s{i}"] / n for i in range(4)], axis=1)
            scatter = np.empty((len(f), 4, 4))
            for i, j in _PAIRS:
                scatter[:, i, j] = scatter[:, j, i] = scale * (f[f"s{i}{j}"] / n - centre[:, i] * centre[:, j])
            inverse, log_det = _precision(scatter)
            yield pd.DataFrame({"key": f["key"], "start": f["start"], "n": n.astype(float)} | {f"c{i}": centre[:, i] for i in range(4)} | {f"p{i}{j}": inverse[:, i, j] for i, j in _PAIRS} | {"log_det": log_det})

    return run


def _sums(rows: DataFrame) -> DataFrame:
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(X)] + [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s{i}{j}") for i, j in _PAIRS]
    return rows.groupBy("key", "start").agg(F.count("*").alias("n"), *sums)


def _distance(prefix: str = "", estimate: str = "") -> F.Column:
    d = [F.col(f"{prefix}{X[i]}") - F.col(f"{estimate}c{i}") for i in range(4)]
    return sum((d[i] * d[j] * F.col(f"{estimate}p{i}{j}") * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0))


def _beside(rows: DataFrame, estimates: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Estimates beside rows; they are broadcast only if they are known to be few."""
    few = estimates.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(estimates) if few else estimates, on, how)


def fit(docs: DataFrame) -> DataFrame:
    """The estimates (key, n, centre, inverse scatter) of every source and language in ``docs``."""
    rows, s = _with_statistics(docs.select("lang", "source", "text"))
    keys = F.explode(F.array(_key("lang", "source"), F.concat(F.lit("lang "), _key("lang")))).alias("key")
    rows = rows.where(~_base_failed(s)).select(keys, *[f"{s}.{x}" for x in X])
    rows = stored(rows, "statistic-vectors")

    # starts: medians with the scatter of median deviations; the classical estimate of all vectors
    medians = rows.groupBy("key").agg(*[F.percentile_approx(x, 0.5).alias(f"m{i}") for i, x in enumerate(X)])
    medians = stored(medians, "medians")
    spread = _beside(rows, medians, "key").groupBy("key").agg(F.count("*").cast("double").alias("n"), *[F.first(f"m{i}").alias(f"c{i}") for i in range(4)], *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5).alias(f"d{i}") for i, x in enumerate(X)])
    variance = [F.pow(1.4826 * F.col(f"d{i}"), 2) + FLOORS[i] ** 2 for i in range(4)]
    robust = spread.select("key", F.lit(0).alias("start"), "n", *[f"c{i}" for i in range(4)], *[(1 / variance[i] if i == j else F.lit(0.0)).alias(f"p{i}{j}") for i, j in _PAIRS], sum(F.log(v) for v in variance).alias("log_det"))
    classical = _sums(rows.withColumn("start", F.lit(1))).mapInPandas(_estimates(1.0), _ESTIMATE)
    estimates = stored(robust.unionByName(classical), "estimates")

    for step in range(FIRST_STEPS + MORE_STEPS):
        near = _beside(rows, estimates, "key").select("key", "start", *X, _distance().alias("d"))
        bounds = near.groupBy("key", "start").agg(F.percentile_approx("d", 0.5, 10_000).alias("bound"))
        bounded = estimates.join(bounds, ["key", "start"]).drop("log_det", "n")
        chosen = _beside(rows, stored(bounded, "bounds"), "key").where(_distance() <= F.col("bound"))
        estimates = _sums(chosen).mapInPandas(_estimates(_CONSISTENT), _ESTIMATE)
        if step == FIRST_STEPS - 1:
            estimates = estimates.groupBy("key").agg(F.min_by(F.struct("*"), F.struct("log_det", "start")).alias("e")).select("e.*")
        estimates = stored(estimates, "estimates")
    return estimates.drop("start", "log_det")


def _leaning(estimates: DataFrame) -> DataFrame:
    """A source's centre drawn to its language's; keyed by source. A row per source with vectors."""
    ours = estimates.where("not startswith(key, 'lang ')").withColumn("lang_key", F.concat(F.lit("lang "), F.to_json(F.from_json("key", "lang string"))))
    lang = estimates.select(F.col("key").alias("lang_key"), *[F.col(f"c{i}").alias(f"l{i}") for i in range(4)])
    joined = _beside(ours, lang, "lang_key")
    lean = [((F.col("n") * F.col(f"c{i}") + LEAN * F.col(f"l{i}")) / (F.col("n") + LEAN)).alias(f"c{i}") for i in range(4)]
    return joined.select(F.col("key").alias("source_key"), *lean, *[f"p{i}{j}" for i, j in _PAIRS])


def judge(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with statistics and a verdict (base_failed, distance, kept), and these columns' names."""
    estimates = _leaning(fit(docs))
    rows, s = _with_statistics(docs)
    rows, key = beside(rows, _key("lang", "source"), "source_key")
    estimate = F.struct(*[c for c in estimates.columns if c != "source_key"])
    own = key + "_estimate"
    while own in rows.columns:
        own = "_" + own
    estimates = stored(estimates.select(F.col("source_key").alias(key), estimate.alias(own)), "quality-estimates")
    judged = _beside(rows, estimates, key, "left")
    distance, failed = _distance(f"{s}.", f"{own}."), _base_failed(s)
    verdict = F.struct(failed.alias("base_failed"), distance.alias("distance"), (~failed & F.coalesce(distance <= CUT_OFF, F.lit(True))).alias("kept"))
    judged, v = beside(judged, verdict, "verdict")
    return judged, s, v


def quality_verdicts(docs: DataFrame) -> DataFrame:
    judged, s, v = judge(docs.select("doc_id", "text", "lang", "source"))
    return judged.select(F.col("doc_id").cast("long").alias("doc_id"), *[f"{s}.{c}" for c in COUNTS], f"{v}.base_failed", f"{v}.kept", f"{v}.distance")


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    judged, _, v = judge(docs)
    return judged.where(F.col(f"{v}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
