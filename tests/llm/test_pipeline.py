"""The pipeline's stages, each on its own input, against brute force."""

import corpus_pipeline
from quirework.llm import decontaminate


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs.toPandas()]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        if name != "sharding":
            assert out.columns == docs.columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        out.write.mode("overwrite").parquet(path)
        now = spark.read.parquet(path)
        kept.append(now.toPandas())
    _, language, single, clean, mixed, sharded = kept
    letters = kept[0][kept[0].text.fillna("").str.contains(r"[^\W\d_]")]
    assert len(language) >= 0.99 * len(letters)
    first = language.dropna(subset="text").groupby("text").doc_id.min()
    assert set(single.doc_id) <= set(language.doc_id) and single.text.is_unique
    assert set(first[first.isin(single.doc_id)]) == set(single.doc_id)
    items = [" ".join(decontaminate.words_of(t)) for t in spark.read.parquet(f"{sf}/benchmark.parquet").toPandas().text]
    holds = {r.doc_id for r in single.itertuples() if any(i in " ".join(decontaminate.words_of(r.text)) for i in items)}
    gone = set(single.doc_id) - set(clean.doc_id)
    assert holds <= gone and len(gone) <= len(holds) + 3
    assert mixed.doc_id.value_counts().max() <= 3 and set(mixed.doc_id) <= set(clean.doc_id)
    assert len(sharded) == len(mixed)
    for _, g in sharded.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_run_equals_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"shard", "slot"} <= set(out.columns) and out.count() > 0
