"""The pipeline's stages against plain versions of what each must do with the rows it gets."""

import corpus_pipeline as pipeline
from parchment.llm import near_dedup, pii, quality, queries
from pyspark.sql import functions as F

from tests.llm import brute


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, None, None) for i, t in brute.ODD], docs.schema))
    cells = lambda df: sorted(map(str, df.collect()))
    before, done = docs, {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, before, sf).write.parquet(str(tmp_path / str(k)))
        done[name] = before = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or before.columns == docs.columns
    good, one, hidden, mixed, encoded = done.values()
    texts = {r.doc_id: r.text for r in docs.collect()}
    verdict = quality.judge(quality.measure([(t or "").encode() for t in texts.values()]))[1]
    assert {r.doc_id for r in good.collect()} == {i for i, v in zip(texts, verdict, strict=True) if v}
    want = brute.components([(r.doc_id, r.text) for r in good.collect()], 5)
    assert {r.doc_id for r in one.collect()} == {c for _, c in want.values()}
    assert cells(hidden.drop("n_chars")) == cells(pii.pseudonymise(one, key=queries.pii_key(spark)).drop("n_chars"))
    sizes = {r.doc_id: len(brute.words(r.text)) for r in hidden.collect()}
    sources = {r.doc_id: r.source for r in hidden.collect()}
    total = {s: sum(n for i, n in sizes.items() if sources[i] == s) for s in set(sources.values())}
    goal, took = brute.targets(total, pipeline.WEIGHTS, pipeline.SHARE), dict.fromkeys(total, 0)
    for r in mixed.collect():
        took[r.source] += sizes[r.doc_id]
    half = {s: max(n for i, n in sizes.items() if sources[i] == s) / 2 for s in total}
    assert all(abs(took[s] - goal[s]) <= max(0.03 * goal[s], half[s]) for s in total)
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in encoded.collect())
    assert encoded.filter("n_tokens <= 0").count() == 0


def test_run(spark, sf):
    out = pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter(F.lit(False))
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
    assert near_dedup.near_duplicates(docs).count() == 0
