import random
import re

import numpy as np
import pyarrow as pa
import pytest

from vellum.llm import hyperminhash as H

from .conftest import document_rows

SCHEMA = "doc_id long, text string"


def true_sets(rows, shingle=4):
    out = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        out.append({tuple(words[k : k + shingle]) for k in range(len(words) - shingle + 1)} if len(words) >= shingle else ({tuple(words)} if words else set()))
    return out


def brute_force(rows, percent=80):
    """Rows of the result by comparing all pairs of sets; a set's copies share its component."""
    sets = true_sets(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    use = [k for k in range(len(rows)) if sets[k] and rows[k][0] is not None]
    for i, a in enumerate(use):
        for b in use[:i]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                parent[find(a)] = find(b)
    least = {}
    for k in use:
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return sorted(
        ((d, len(s), None if d is None else least.get(find(k), d) if s else d, None if d is None else d == (least.get(find(k), d) if s else d)) for k, ((d, _), s) in enumerate(zip(rows, sets))),
        key=repr,
    )


def found(spark, rows, **how):
    got = H.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), **how)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def corpus(seed, groups, per, words=60, edits=(1, 2, 3, 4, 5, 6)):
    """Groups of near copies around both sides of the threshold, chains of edits among them."""
    r, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{r.randrange(5000)}" for _ in range(words)]
        for _ in range(per):
            text = list(base)
            for _ in range(r.choice(edits)):
                text[r.randrange(len(text))] = f"x{r.randrange(9999)}"
            if r.random() < 0.3:
                base = text
            rows.append((len(rows) * 3 + g, " ".join(text)))
    r.shuffle(rows)
    return rows


def test_links_are_those_of_all_pairs(spark):
    rows = corpus(1, 25, 12) + corpus(2, 30, 6, words=9, edits=(0, 1)) + corpus(3, 10, 5, words=900, edits=(20, 40, 60))
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    assert found(spark, rows) == brute_force(rows)


def test_keys_are_looked_at_in_chunks(spark):
    """Documents that share a long passage meet under many keys without being alike."""
    r = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(70))
    rows = [(k, passage + " " + " ".join(f"own{g}_{j}" for j in range(24)) + f" end{r.randrange(2)} " + " ".join(f"t{r.randrange(3)}" for _ in range(3))) for k in range(240) for g in [k % 40]]
    want = brute_force(rows)
    assert found(spark, rows, chunk=10_000) == want == found(spark, rows)


def test_single_pass_of_first_members_is_not_enough(spark):
    """A member far from its key's first one may be near to another."""
    rows = corpus(11, 4, 60, words=40, edits=(2, 3, 4))
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    assert found(spark, rows) == brute_force(rows)


def test_nulls_repeats_and_clashing_columns(spark, docs, no_docs):
    rows = [(r[0], r[1]) for r in document_rows()]
    got = H.near_duplicates(docs)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_force(rows)
    assert H.near_duplicates(no_docs).count() == 0
    assert H.near_duplicates(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    with pytest.raises(ValueError):
        H.near_duplicates(docs, percent=0)


def test_boundary_is_exact(spark):
    """Sets of 4 and 5 in 5 (0.8) link; 7 in 9 (0.78) don't."""
    w = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(w[:7])), (2, " ".join(w[:8])), (3, " ".join(w[20:30])), (4, " ".join(w[20:32]))]
    assert [(r[0], r[2]) for r in sorted(found(spark, rows))] == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_shingles_and_registers():
    texts = pa.array(["A b  c\td E", "a b c d e", "x", None, "", " \n", "a b c", "É é b c", "é é b c"])
    sets = H.shingle_sets(texts)
    assert [len(s) for s in sets] == [2, 2, 1, 0, 0, 0, 1, 1, 1]
    assert (sets[0] == sets[1]).all() and sets[7][0] != sets[8][0]  # only A-Z are lowered
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 500, np.uint64) * np.uint64(2))
    got = H.registers(h)
    for b in range(H.BUCKETS):
        own = [int(x) for x in h if int(x) >> 57 == b]
        if not own:
            assert got[b] == 0
            continue
        bits = format(((min(own) << 7) & ((1 << 64) - 1)) | 127, "064b")
        zeros = bits.index("1")
        assert got[b] == (zeros << 10 | int((bits[zeros + 1 :] + "0" * 64)[:10], 2)) + 1


def test_estimates_are_corrected_for_chance():
    rng = np.random.default_rng(7)
    for true in (0.0, 0.5, 0.8):
        found = []
        for _ in range(60):
            n = 4000
            shared = int(n * 2 * true / (1 + true))
            h = rng.integers(0, 1 << 64, 2 * n - shared, np.uint64)
            a, b = H.registers(np.sort(h[:n])), H.registers(np.sort(h[n - shared :]))
            found.append(H.estimate(a[None], b[None], np.array([n]), np.array([n]))[0][0])
        assert abs(np.mean(found) - true) < 0.02
    assert 0 < H._CHANCE.min() and H._CHANCE.max() < 0.002
