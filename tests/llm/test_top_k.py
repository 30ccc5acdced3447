import math

import numpy as np
import pytest

from vellum.llm.bit_sliced import BitSlicedBlock, top_k


def brute(rows, queries, k):
    def whole(v):
        return [math.floor(256 * float(np.float64(x))) for x in v]

    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, whole(v)) for i, v in rows if i is not None and good(v)]
    out = []
    for q in sorted({i for i, _ in queries}):
        own = min(v for i, v in rows if i == q) if any(i == q for i, _ in rows) else None
        if own is None:
            continue
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in rows if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize("block_rows", [10, 1000])
def test_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(0)
    rows = [(int(k), [float(x) for x in np.float32(rng.normal(0, 0.3, 6).round(1))]) for k in range(150)]
    rows += [(500, None), (550, [0.1, None, 0.2]), (600, [float("nan")] * 6), (650, [float("inf")] + [0.0] * 5), (700, [0.5, -0.5]), (750, []), (None, [0.1] * 6), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = top_k(df, df.where("vec_id % 50 = 0"), 5, block_rows=block_rows, query_rows=2).collect()
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in got) == brute(rows, [(i, v) for i, v in rows if i is not None and i % 50 == 0], 5)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 128 * 256 + 128 * 512)]
    assert top_k(df.limit(0), df.limit(0)).count() == 0
    assert top_k(df, df.limit(0)).count() == 0


def test_block_scores_are_exact():
    rng = np.random.default_rng(1)
    block = BitSlicedBlock(np.arange(130), rng.integers(-300, 300, (130, 9)))
    q = rng.integers(-300, 300, 9)
    slices = block.scores(q)
    bits = np.unpackbits(slices.view(np.uint8).reshape(len(slices), -1), axis=1, bitorder="little")[:, :130].astype(object)
    value = sum(bits[i] * (1 << i) for i in range(len(bits))) - (1 << (len(bits) - 1))
    want = (block.values - block.offset) @ q
    assert (value.astype(np.int64) == want).all()
