from vellum.llm import licenses


def scan(spark, rows):
    df = spark.createDataFrame(rows, "id long, path string, text string, score int")
    return {r.id: r for r in licenses.license_scan(df).collect()}


def test_own_and_inherited(spark):
    mit = "Copyright 2020\n" + next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 100)
    got = scan(
        spark,
        [
            (1, "a/LICENSE", mit, 0),
            (2, "a/b/c/x.py", "code only", 0),
            (3, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0.", 0),
            (4, "a/y.py", "text\nReleased under the MIT license\nmore", 0),
            (5, "z/q.py", "All rights are good.", 0),
            (6, "ab/x.py", "", 0),
            (7, None, None, None),
            (8, "a/b/c/gpl.py", "This work is licensed under the GNU General Public License, version 3.", 0),
            (9, "a/b/c/x.py", None, 0),
        ],
    )
    assert (got[1].license, got[1].basis) == ("MIT", "own")
    assert (got[2].license, got[2].basis, got[2].inherited_from) == ("Apache-2.0", "inherited", "a/b")
    assert got[4].license == "MIT" and got[4].inherited_from == "a"
    assert got[5].basis == got[6].basis == got[7].basis == "none"
    assert (got[8].license, got[8].inherited_license) == ("GPL-3.0", "Apache-2.0")
    assert got[9].license == "Apache-2.0"


def test_licences_over_lines_and_inside_paragraphs(spark):
    import textwrap

    words = "The parser was written by several people over many years and reads every file it is given. "
    rows, want = [], []
    for name, text in licenses.TEMPLATES:
        if len(text) > 100:
            rows.append("\n".join(textwrap.wrap(text, 72)))
            rows.append("/*\n" + "\n".join(" * " + line for line in textwrap.wrap(text, 60)) + "\n */\nint main;")
        rows.append(words * 3 + text + " " + words * 3)
        want += [name] * (len(rows) - len(want))
    rows.append("The whole of this work is Released under the MIT License.")
    want.append("MIT")
    rows.append(words * 20 + "A licence would be good to have.")
    want.append(None)
    got = scan(spark, [(k, f"f{k}", text, 0) for k, text in enumerate(rows)])
    assert [got[k].own_license for k in range(len(rows))] == want


def test_every_template_finds_itself(spark):
    got = scan(spark, [(k, f"f{k}", text, 0) for k, (_, text) in enumerate(licenses.TEMPLATES)])
    assert all(got[k].own_license == name for k, (name, _) in enumerate(licenses.TEMPLATES))


def test_empty(spark):
    assert scan(spark, []) == {}


def test_against_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    want = con.execute(licenses.oracle_sql()).fetchall()
    got = licenses.license_scan(licenses.document_files(spark.read.parquet(f"{small}/documents.parquet"))).collect()
    key = lambda r: [str(x) for x in r]
    assert sorted(map(key, got)) == sorted(map(key, want)) and any(r.basis == "own" for r in got)


def test_long_texts_and_long_licence_documents(spark):
    words = "Every part of it was read by many people over the years and written down again. "
    apache = next(t for n, t in licenses.TEMPLATES if n == "Apache-2.0" and len(t) > 400)
    docs = spark.createDataFrame([(1, words * 2000 + apache + " " + words * 2000, "en", "s"), (17, "nothing", "en", "s"), (2, words * 2000, "en", "s"), (3, None, "en", "s")], "doc_id long, text string, lang string, source string")
    got = {r.id: r for r in licenses.license_scan(licenses.document_files(docs)).collect()}
    assert got[1].own_license == "Apache-2.0" and (got[17].license, got[17].basis) == ("Apache-2.0", "inherited")
    assert got[2].basis == got[3].basis == "none"


def by_brute_force(text):
    """(score, license) of a text's best line or run of terms, every run tried."""
    import math
    import re
    from collections import Counter

    weight, unknown = licenses.inverse_frequencies()
    vectors = {}
    for k, name, term, w in licenses.template_vectors():
        vectors.setdefault((k, name), {})[term] = w
    cosine = lambda own, v: round(sum(n * weight.get(t, unknown) * v.get(t, 0) for t, n in own.items()) / math.sqrt(sum((n * weight.get(t, unknown)) ** 2 for t, n in own.items())), 6)
    best = (0, None)

    def take(score, name):
        nonlocal best
        if score >= licenses.LEAST and (-score, name) < (-best[0], best[1] or "~"):
            best = score, name

    if not re.search(licenses.CUE, text or ""):
        return best
    for line in text.split("\n"):
        if re.search(licenses.CUE, line) and (own := Counter(licenses.terms(line))):
            for (_, name), v in vectors.items():
                take(cosine(own, v), name)
    found = licenses.terms(text)
    longest = max(len(licenses.terms(t)) for _, t in licenses.TEMPLATES)
    cues = [k for k, t in enumerate(found) if re.search(licenses.CUE_TERM, t)]
    near = {p for k in cues for p in range(max(0, k - longest + 1), min(len(found), k + longest))}
    for (k, name), v in vectors.items():
        size = len(licenses.terms(licenses.TEMPLATES[k][1]))
        for start in near:
            if found[start] in v:
                own = Counter(found[p] for p in range(start, min(start + size, len(found))) if p in near)
                take(cosine(own, v), name)
    return best


def test_runs_against_brute_force(spark):
    import random

    r = random.Random(6)
    filler = "the parser reads every file that it is given and writes permission rights software license to".split()
    texts = []
    for k in range(24):
        name, template = licenses.TEMPLATES[k % len(licenses.TEMPLATES)]
        words = licenses.terms(template)
        cut = words[r.randrange(max(1, len(words) // 6)) :]
        for _ in range(r.randrange(len(cut) // 4 + 1)):
            cut[r.randrange(len(cut))] = r.choice(filler)
        around = lambda: [r.choice(filler) for _ in range(r.randrange(30))]
        parts = around() + cut + around() + (words if r.random() < 0.2 else [])
        texts.append("".join(w + r.choice([" ", " ", " ", "\n// "]) for w in parts))
    got = scan(spark, [(k, f"f{k}", t, 0) for k, t in enumerate(texts)])
    assert [(round(got[k].score or 0, 5), got[k].own_license) for k in range(len(texts))] == [(round(s, 5), n) for s, n in map(by_brute_force, texts)]
    assert 5 < sum(got[k].own_license is not None for k in range(len(texts)))
