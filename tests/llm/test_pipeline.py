import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_clean_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, small)
        assert out.columns == docs.columns, name
        now = out.count()
        assert 0.6 * before <= now <= before
        before = now


def test_run_packs_what_is_kept(spark, small):
    out = corpus_pipeline.run(spark, small).toPandas()
    assert len(out) and (out.groupby("doc_id")["length"].sum() == out.groupby("doc_id")["doc_tokens"].first()).all()


def test_odd_documents_pass_through(spark, small):
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, "the of and to in is", "en", "s", 5, "x"), (3, "the of and to in is", "en", "s", 5, "x"), (None, "the of and to in is", "en", "s", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxicity string")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["toxicity"](spark, docs, small).count() == 5
    kept = stages["language"](spark, docs, small)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 3), (False, 3), (True, 0)]
    assert stages["near_dedup"](spark, docs, small).count() == 4
    assert stages["packing"](spark, docs.limit(0), small).count() == 0
