import zlib

import numpy as np
import pyarrow as pa

from vellum.llm import toxicity
from vellum.llm.label_model import posteriors


def corpus(n=600):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 9))) for _ in range(900)]
    bad = ["vilest", "zornwort", "zornig", "zornen"]
    docs, labels = [], []
    for k in range(n):
        text = rng.choice(words, rng.integers(40, 120)).tolist()
        toxic = k % 6 == 0
        if toxic:
            for w in rng.choice(bad, 4):
                text.insert(int(rng.integers(0, len(text))), str(w))
        docs.append((k, " ".join(text), "en", "s"))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_scores_separate_held_out_rows(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = toxicity.toxicity_scores(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 600
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)


def test_held_out_labels_are_never_used(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    flipped = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, q, t in labels]
    a, b = (toxicity.ToxicityModel.fit(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert a.tokens == b.tokens and a.weights == b.weights and a.bias == b.bias


def tongues(n=900):
    """Texts of three languages, each with its own toxic words or beginnings; common words lean on the label a little."""
    rng = np.random.default_rng(11)
    docs, labels = [], []
    bad = {"a": ["vilest", "zorn", "mucky", "grubbo", "slimer"], "b": ["quorx" + e for e in "abcdefgh"], "c": ["brimble" + e for e in ("ta", "so", "ne", "li")]}
    common = {x: [x + "".join(rng.choice(list("lmnoprst"), rng.integers(2, 7))) for _ in range(300)] for x in bad}
    for k in range(n):
        lang = "abc"[min(k % 7, 2) if k % 7 < 3 else 0]
        toxic = k % 5 == 0
        text = rng.choice(common[lang], rng.integers(30, 90)).tolist() + [common[lang][0]] * (2 + toxic)
        for w in rng.choice(bad[lang], 3 if toxic else 0):
            text.insert(int(rng.integers(0, len(text))), str(w))
        docs.append((k, " ".join(text), lang, "s"))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def held(k):
    return zlib.crc32(str(k).encode()) % 5 == 0


def held_out_rates(spark, docs, labels):
    model = toxicity.ToxicityModel.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    toxic = {k: t for k, _, t in labels}
    ids, texts = zip(*[(d[0], d[1]) for d in docs if held(d[0]) and d[0] < 900])
    marked = np.array(model.scores(pa.array(texts))) >= 0.5
    truth = np.array([toxic[k] == 1 for k in ids])
    return model, marked[truth].mean(), marked[~truth].mean()


def test_copies_of_training_rows_change_nothing(spark):
    docs, labels = tongues()
    model, recall, wrong = held_out_rates(spark, docs, labels)
    assert recall >= 0.95 and wrong <= 0.05
    train = [k for k in range(900) if not held(k)]
    for times in (5, 20):
        fresh = (k for k in range(1000, 10**6) if not held(k))
        copies = [(next(fresh), docs[k], labels[k]) for _ in range(times - 1) for k in train]
        more, again, wrong_again = held_out_rates(spark, docs + [(i, *d[1:]) for i, d, _ in copies], labels + [(i, *l[1:]) for i, _, l in copies])
        assert more.tokens == model.tokens and abs(again - recall) <= 0.03 and abs(wrong_again - wrong) <= 0.01


def test_voters_are_right_more_often_than_not(spark):
    """A word of many texts of both kinds, however surely tied to the label, is no voter."""
    docs, labels = tongues()
    common = [(k, t + (" everyone" if labels[k][2] or k % 2 else ""), *rest) for k, t, *rest in docs]
    model, recall, wrong = held_out_rates(spark, common, labels)
    assert recall >= 0.95 and wrong <= 0.05 and not model.tokens[0].startswith("ever")


def plain_posteriors(votes, positive, known, rounds=3, steps=25):
    """The label model row by row and voter by voter."""
    n, m = votes.shape
    values = (-1, 0, 1)
    p = [min(max(float(t), 0.01), 0.99) for t in known]

    def companies(left, least):
        c = [[sum(a * b for a, b in zip(left[j], left[k])) for k in range(m)] for j in range(m)]
        scale = [(c[j][j] / n) ** 0.5 + 1e-9 for j in range(m)]
        r = [[c[j][k] / n / (scale[j] * scale[k]) for k in range(m)] for j in range(m)]
        return [[abs(r[j][k]) if j != k and abs(r[j][k]) >= least else 0.0 for k in range(m)] for j in range(m)]

    strong = companies([[votes[i][j] - sum(votes[:, j]) / n for i in range(n)] for j in range(m)], 0.6)
    for _ in range(rounds):
        for _ in range(steps):
            law = [[[sum((q if y else 1 - q) for q, v in zip(p, votes[:, j]) if v == x) + sum(1 for t, v in zip(known, votes[:, j]) if v == x and t == y) + 0.5 for x in values] for j in range(m)] for y in (0, 1)]
            law = [[[x / sum(one) for x in one] for one in row] for row in law]
            new = []
            for i in range(n):
                z = np.log(positive / (1 - positive))
                for j in range(m):
                    if votes[i][j]:
                        company = sum(strong[j][k] for k in range(m) if votes[i][k])
                        z += (np.log(law[1][j][votes[i][j] + 1]) - np.log(law[0][j][votes[i][j] + 1])) / (1 + company)
                new.append(1 / (1 + np.exp(-z)))
            p = new
        mean = [[law[y][j][2] - law[y][j][0] for j in range(m)] for y in (0, 1)]
        strong = companies([[votes[i][j] - (1 - p[i]) * mean[0][j] - p[i] * mean[1][j] for i in range(n)] for j in range(m)], 0.2)
    return np.array(p)


def test_label_model_against_brute_force_on_mined_voters(spark):
    docs, labels = tongues(240)
    model = toxicity.ToxicityModel.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    voters = toxicity.Voters(model.tokens, len(model.tokens))
    votes = np.array([voters.votes(*voters.hits(d[1])) for d in docs[:120]], np.int8)
    known = np.array([x[2] for x in labels[:120]])
    got, _, _ = posteriors(votes, 0.2, known)
    assert np.allclose(got, plain_posteriors(votes, 0.2, known), atol=1e-9)


def test_edge_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(12)] + [(None, None, None), (3, 1, None), (4, 0, 7)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(r.score is not None and r.held_out is not None for r in got)
    assert toxicity.toxicity_scores(no_docs, labels).count() == 0
    none = labels.limit(0)
    assert {(r.score, r.predicted) for r in toxicity.toxicity_scores(docs, none).collect()} == {(0.0, 0)}
    kept = toxicity.drop_toxic(docs, none)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < acc, np.where(y, 1, -1), np.where(y, -1, 1)) for acc in (0.9, 0.8, 0.7, 0.75)], axis=1)
    votes = np.concatenate([votes, votes[:, 2:3]], axis=1)  # one voter twice
    votes[rng.random(votes.shape) < 0.2] = 0
    p, law, correlation = posteriors(votes.astype(np.int8), 0.3)
    assert ((p > 0.5) == y).mean() > 0.9
    assert law[1, 0, 2] > law[1, 2, 2] and correlation[2, 4] > 0.3 > abs(correlation[0, 1])
