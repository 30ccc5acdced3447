import re

import numpy as np
import xxhash

from vellum.llm import simhash
from vellum.llm.components import connected_components

from .conftest import document_rows


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_fingerprints_and_components(docs):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    rows = document_rows()
    fps = [fingerprint(r[1]) for r in rows]
    assert {(r[0], f"{f:016x}") for r, f in zip(rows, fps)} == set(got)
    ids = [k for k, r in enumerate(rows) if r[0] is not None]
    up = roots(len(rows), [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    for k in ids:
        assert got[rows[k][0], f"{fps[k]:016x}"] == min(rows[j][0] for j in ids if up[j] == up[k])
    assert all(v is None for (d, _), v in got.items() if d is None)


def planted(n=300):
    rng = np.random.default_rng(3)
    out = []
    for centre in rng.integers(0, 2**63, 12, dtype=np.uint64):
        for _ in range(n // 12):
            x = int(centre)
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(b)
            out.append(x)
    return sorted(set(out))


def linked(spark, fps, split_over):
    rows = [(int(np.uint64(f).astype(np.int64)), k) for k, f in enumerate(fps)]
    links = simhash.near_links(spark.createDataFrame(rows, "fp long, rep long"), split_over=split_over)
    got = {r.node: r.root for r in connected_components(links).collect()}
    return [got.get(k, k) for k in range(len(fps))]


def test_links_against_all_pairs_and_split_keys(spark):
    fps = planted()
    want = roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert linked(spark, fps, 4096) == want
    assert linked(spark, fps, 1) == want  # every key with two owners is split


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u long, v long").repartition(7), max_nodes=20).collect()}
    assert all(got[k] == 0 for k in range(1, 201)) and all(got[1000 + k] == 1000 for k in range(1, 300)) and 5000 not in got


def test_one_of_each_group_stays(docs, no_docs):
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    of = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(i for i in ids if i is not None) == sorted({c for c in of.values() if c is not None})
    assert ids.count(None) == 2
    assert simhash.keep_one_each(no_docs).count() == 0 and simhash.near_duplicates(no_docs).count() == 0


def test_repeated_ids_lose_no_text(spark):
    a, b, c = "one text of some words here", "quite another text with its own words there", "a third one that nobody else has"
    rows = [(1, a, "x"), (1, b, "y"), (2, b, "z"), (3, c, "p"), (3, c, "p"), (4, c, "q"), (None, a, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
    found = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    fp = {t: f"{simhash.fingerprint(t):016x}" for t in (a, b, c)}
    assert found == {(1, fp[a]): 1, (1, fp[b]): 1, (2, fp[b]): 1, (3, fp[c]): 3, (4, fp[c]): 3, (None, fp[a]): None}
    kept = sorted((r.doc_id or 0, r.text, r.kept) for r in simhash.keep_one_each(docs, id_is_document=False).collect())
    assert kept == sorted([(1, a, "x"), (1, b, "y"), (3, c, "p"), (0, a, "n")])


def test_fingerprints_of_very_many_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 3)
    rows = [(k, "the same text of these words" if k % 2 else f"text number {k} with words of its own {k * 7}") for k in range(40)] + [(None, "the same text of these words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert all(got[k] == (1 if k % 2 else k) for k in range(40)) and len(got) == 41 and got[None] is None
    assert sorted(r.doc_id for r in simhash.keep_one_each(docs).where("doc_id is not null").collect()) == sorted({got[k] for k in range(40)})


def test_components_are_named_by_their_least_id_wherever_it_is(spark):
    """Chains of near fingerprints; the least id is that of any member, the root fingerprint's too."""
    rng = np.random.default_rng(7)
    texts = []
    for chain in range(12):
        words = [f"Chain{chain}x{k}" for k in rng.integers(0, 400, 900)]
        for _ in range(5):
            texts.append(" ".join(words))
            words[rng.integers(0, 900)] = "changed"
    ids = rng.permutation(len(texts) + 40)[: len(texts)].tolist()
    fps = [fingerprint(t) for t in texts]
    up = roots(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    want = {i: min(j for j, v in zip(ids, up) if v == u) for i, u in zip(ids, up)}
    signed = dict(zip(ids, np.array(fps, np.uint64).view(np.int64).tolist()))
    firsts = {u: min((signed[i], i) for i, v in zip(ids, up) if v == u)[1] for u in set(up)}
    first_is_least = {want[i] == i for u, i in firsts.items() if len({f for f, v in zip(fps, up) if v == u}) > 1}
    assert first_is_least == {True, False}  # groups of several fingerprints, of both kinds
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in zip(ids, fps)}
    assert sorted(r.doc_id for r in simhash.keep_one_each(docs).collect()) == sorted(set(want.values()))
