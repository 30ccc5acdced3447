import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vellum.llm import divergence as D

from .conftest import document_rows

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_force(rows, least=10, ranks=10):
    """Every pair of groups over every kept term, zero counts included."""
    times, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        own = TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        times[lang, source].update(own)
        in_docs[lang].update(set(own))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in in_docs[lang].items() if n >= least)
        sources = sorted(s for la, s in groups if la == lang)
        whole = sum((times[lang, s] for s in sources), Counter())

        def law(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: law(times[lang, s]) for s in sources}, law(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if times[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(terms[:ranks])]
    return sorted(out)


def found(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


def corpus(n=500):
    """A hot source, sources of little, groups without kept terms, terms of one source alone."""
    r = random.Random(9)
    rows = []
    for k in range(n):
        lang, source = r.choice(["en", "en", "de", None]), r.choice(["hot", "hot", "hot", "a", "b", "ü", None])
        words = [r.choice(["The", "ÉTÉ", "naïve", "x1y", "Ärger"]) + str(r.randrange(3)) for _ in range(r.randrange(0, 25))]
        words += [f"{source}{'abcdefgh'[r.randrange(8)]}" for _ in range(r.randrange(6))]
        rows.append((k, " ".join(words) if k % 50 else None, lang, source))
    return [*rows, (n, "only rare words here", "fr", "a"), (n + 1, "", "fr", "b"), (n + 2, None, "xx", "alone")]


@pytest.mark.parametrize("how", [{}, {"least": 1, "ranks": 3}, {"least": 10_000}])
def test_values_are_those_of_all_terms_and_pairs(spark, how):
    rows = corpus()
    options = {"least_docs" if k == "least" else k: v for k, v in how.items()}
    assert found(D.divergence_audit(spark.createDataFrame(rows, SCHEMA).repartition(4), **options)) == brute_force(rows, **how)


def test_batches_and_tasks_that_hand_on_early_add_up(spark, monkeypatch):
    """Small bounds, so that terms and pairs are handed on many times and terms run over batches."""
    rows = corpus(300)
    monkeypatch.setattr(D, "MOST_HELD", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        assert found(D.divergence_audit(spark.createDataFrame(rows, SCHEMA).repartition(2), least_docs=2)) == brute_force(rows, least=2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nulls_repeats_and_clashing_columns(docs, no_docs):
    rows = [(r[0], r[1], r[2], r[3]) for r in document_rows()]
    assert found(D.divergence_audit(docs.withColumn("term", docs.kept).withColumn("value", docs.score), least_docs=2)) == brute_force(rows, least=2)
    assert D.divergence_audit(no_docs).count() == 0


def test_probabilities_are_exact(spark):
    """Long division keeps within 64 bits where the product would not."""
    r = random.Random(4)
    pairs = [(c, t) for t in (1, 7, 10**9 + 7, 9 * 10**15 - 1) for c in (0, 1, t // 3, t - 1, t) if c <= t] + [(r.randrange(10**12), 10**12 + r.randrange(10**12)) for _ in range(50)]
    got = spark.createDataFrame(pairs, "c long, t long").selectExpr("c", "t", D._scaled("c", "t") + " as p").collect()
    assert all(p == 1 + 10**9 * c // t for c, t, p in got) and len(got) == len(pairs)
    assert np.iinfo(np.int64).max > (10**9 + 1) ** 2
