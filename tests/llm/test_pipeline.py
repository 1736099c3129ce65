"""The stages of the pipeline in a row, on a small table with nulls, repeated rows and a column that clashes."""


import corpus_pipeline


def test_pipeline_on_odd_rows(spark, tmp_path):
    base = [" ".join(f"d{k}w{x}" for x in range(60)) for k in range(6)]
    rows = [(k, t) for k, t in enumerate(base)] + [(None, base[0]), (None, None), (7, ""), (7, ""), (8, base[1] + "\n" + base[2]), (9, "bench " + " ".join(f"b{x}" for x in range(13)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, dropped int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"b{x}" for x in range(13)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, before, str(tmp_path))
        assert kept.columns == docs.columns, name
        before = spark.createDataFrame(kept.collect(), docs.schema)
    texts = {r.doc_id: r.text for r in before.collect() if r.text and r.text.strip()}
    assert {k: texts.get(k) for k in range(6)} == dict(enumerate(base)) and 9 not in texts
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} == {r.doc_id for r in before.collect()} and all(r.offset + r.length <= 4096 for r in found)
