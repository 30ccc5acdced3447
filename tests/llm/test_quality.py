import re
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from vellum.llm import quality

from .conftest import document_rows


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines, seen, dup = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", "x\xa0y", "\n", "\n\n", " ", "\t", "\x1c", "<p>"]), max_size=60).map("".join))
def test_counts(text):
    assert quality.count(text)[:5] == counted(text)


def test_chi_square():
    assert abs(quality.chi_square_4_quantile(0.95) - 9.4877) < 1e-3


def sample(n=400):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(3000)]
    rows = []
    for k in range(n):
        text = "\n".join(" ".join(rng.choice(words, 20)) for _ in range(5))
        if k % 10 == 0:
            text = " ".join(w + "###" for w in text.split(" "))
        rows.append((k, text, "en" if k % 2 else None, f"s{k % 3}"))
    return rows


def test_outliers_go_and_clean_documents_stay(spark):
    docs = spark.createDataFrame(sample(), "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.quality_verdicts(docs).collect()}
    assert all(got[k].kept == (k % 10 != 0) for k in range(400))


def test_estimates_against_numpy(spark):
    docs = spark.createDataFrame(sample(), "doc_id long, text string, lang string, source string")
    fitted = {r.key: r for r in quality.fit(docs).collect()}
    x = []
    for _, text, lang, source in sample():
        if lang == "en" and source == "s1":
            n, chars, symbols, dup, rep, lines = quality.count(text)
            x.append((np.log(chars / n), np.log1p(10 * symbols / n), dup / lines, rep / n))
    x = np.array(x)
    own = fitted['{"lang":"en","source":"s1"}']
    centre = np.array([own[f"c{i}"] for i in range(4)])
    scatter = np.cov(x.T) * 0.5 + np.eye(4)
    for start in (np.median(x, axis=0), x.mean(axis=0)):  # concentration by hand
        c, s = start, np.diag(np.square(quality.FLOORS))
        for _ in range(6):
            d = np.einsum("ni,ij,nj->n", x - c, np.linalg.inv(s), x - c)
            near = x[d <= np.quantile(d, 0.5)]
            c, s = near.mean(axis=0), quality._CONSISTENT * np.cov(near.T, bias=True) + np.diag(np.square(quality.FLOORS))
    assert scatter.shape == (4, 4) and np.abs(centre - c).max() < 0.02


def test_nulls_clashes_and_pipeline_stage(docs):
    got = quality.quality_verdicts(docs).collect()
    want = Counter((r[0], *counted(r[1])) for r in document_rows())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (r.kept is False or not r.base_failed) for r in got)
    kept = quality.keep_quality(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_empty(no_docs):
    assert quality.quality_verdicts(no_docs).count() == 0
