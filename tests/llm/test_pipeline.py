import corpus_pipeline
from vellum.llm import quality, simhash, toxicity


def test_stages_keep_what_brute_force_keeps(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in quality.quality_verdicts(docs).collect() if r.kept}
    left = docs.where(docs.doc_id.isin(list(kept)))
    kept -= {r.doc_id for r in toxicity.toxicity_scores(left, labels).collect() if r.predicted}
    ids = sorted(kept)
    fps = [simhash.fingerprint(texts[i]) for i in ids]
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    want = {ids[find(k)] for k in range(len(ids))}
    out = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in out} == want
    covered = {}
    for r in out:
        covered[r.doc_id, r.doc_tokens] = covered.get((r.doc_id, r.doc_tokens), 0) + r.length
    assert all(n == tokens for (_, tokens), n in covered.items())


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
        assert stage(spark, docs.limit(0), small).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), small).count() == 0


def test_stages_with_nulls_repeats_and_clashing_columns(spark, docs, small):
    """Rows of the fixture hold nulls in every column, repeated rows and ids, a very long text and names that stages use themselves."""
    long = "".join(f"{w} " for k in range(40) for w in (f"plain{k}", f"prose{k * 7 % 40}", f"goes{k}", f"on{k * 3 % 40}."))
    more = spark.createDataFrame([(100 + k, long + f"end{k}" * (k > 1), "en", "s1", 0, "clash", k, 0.5) for k in range(4)] + [(100, long, "en", "s1", 0, "clash", 0, 0.5), (101, "Another " + long.replace("prose", "verse"), None, None, None, None, None, None)], docs.schema)
    rows = docs.unionByName(more)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, small)
        assert out.columns == rows.columns and out.count() <= rows.count()
    kept = corpus_pipeline.near_dedup(spark, more, small).collect()
    assert sorted(r.doc_id for r in kept if r.text == long) == [100]  # equal rows and copies: one stays
    assert any(r.doc_id == 101 and r.text.startswith("Another") for r in kept)  # a known id's other text stays
    packed = corpus_pipeline.pack(spark, rows, small)
    assert packed.where("start = 0").count() == rows.count()
