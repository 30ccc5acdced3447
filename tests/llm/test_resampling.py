import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vellum.llm import resampling as R

from .conftest import document_rows

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def features(text, run):
    words = WORD.findall(lower(text))
    return words, [" ".join(words[k : k + n]) for n in range(1, run + 1) for k in range(len(words) - n + 1)]


def brute_force(docs, target, percent=10, least=20, run=1, buckets=10_000, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    corpus = Counter(bucket(f) for _, t in docs for f in features(t, run)[1])
    wanted = Counter(bucket(f) for _, t in target for f in features(t, run)[1])
    s_all, t_all = sum(corpus.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((corpus[b] + 1) * (t_all + buckets))))
    out = []
    for d, t in docs:
        words, own = features(t, run)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        score = None if d is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(own), weight, score, None, len(words)])
    may = sorted((r for r in out if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def found(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(n=400):
    r = random.Random(3)
    return [(k, " ".join(f"w{int(r.paretovariate(0.7)) % 300}" for _ in range(r.randrange(5, 60)))) for k in range(n)]


@pytest.mark.parametrize("how", [{}, {"run": 2, "buckets": 97, "percent": 35}, {"least": 0, "percent": 100, "seed": 7}])
def test_draws_as_by_brute_force(spark, how):
    docs, target = corpus(), [(0, "w1 w2 w3 W250 w251"), (1, None), (2, "w250 w250")]
    options = {k.replace("least", "least_words") if k == "least" else k: v for k, v in how.items()}
    got = R.resample(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame(target, SCHEMA).select("text"), **options)
    assert found(got) == brute_force(docs, target, **how)


def test_nulls_ties_repeats_and_clashing_columns(spark, docs):
    rows, target = [(r[0], r[1]) for r in document_rows()], [(1, "the quick fox"), (None, None)]
    got = R.resample(docs.withColumn("rank", docs.n_chars), spark.createDataFrame(target, SCHEMA), percent=100, least_words=2)
    assert found(got) == brute_force(rows, target, percent=100, least=2)


def test_one_id_for_all_and_an_empty_target(spark):
    rows = [(1, "same words here")] * 50
    got = found(R.resample(spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame([], SCHEMA), percent=50, least_words=1))
    assert got == brute_force(rows, [], percent=50, least=1)


def test_empty(spark, no_docs):
    assert R.resample(no_docs, spark.createDataFrame([(1, "a b")], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        R.resample(no_docs, no_docs, percent=101)


def test_blocks_are_the_sparse_matrix(spark):
    """The stored blocks hold every row once, in compressed sparse rows with ascending buckets."""
    docs = corpus(1200)
    blocks = R.count_matrix(spark.createDataFrame(docs, SCHEMA).repartition(2)).collect()
    assert len(blocks) >= 2 and len({b.first_row for b in blocks}) == len(blocks)
    rows = {}
    for b in blocks:
        assert b.indptr[0] == 0 and b.indptr[-1] == len(b.indices) == len(b.counts)
        for k, d in enumerate(b.doc_id):
            at = slice(b.indptr[k], b.indptr[k + 1])
            assert (np.diff(b.indices[at]) > 0).all()
            rows[d] = Counter(dict(zip(b.indices[at], b.counts[at])))
    assert rows == {d: Counter(zlib.crc32(w.encode()) % 10_000 for w in features(t, 1)[0]) for d, t in docs}
