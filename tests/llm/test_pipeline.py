import corpus_pipeline
from spectralake.llm import decontamination, language_id, mixing, ngram_join, secrets

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_agree_with_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = corpus_pipeline.save(corpus_pipeline.language(spark, docs, SF))
    model = language_id.train(language_id.training_rows(docs.where(~language_id.held_out(docs["doc_id"]))))
    found = {r.doc_id for r in language_id.predict(docs, model).collect() if r.language.lang_pred != "und" and r.language.sure >= 0.5}
    assert {r.doc_id for r in kept.collect()} == found and kept.columns == docs.columns
    few = corpus_pipeline.save(corpus_pipeline.near_duplicates(spark, kept, SF))
    groups = {r.component_id for r in ngram_join.near_components(kept).collect()}
    assert sorted(r.doc_id for r in few.collect()) == sorted(groups) and few.columns == docs.columns
    clean = corpus_pipeline.save(corpus_pipeline.benchmark_overlap(spark, few, SF))
    marks = decontamination.report(few, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in marks.where("not contaminated").collect()}
    hidden = corpus_pipeline.save(corpus_pipeline.secret_scan(spark, clean, SF))
    assert hidden.count() == clean.count() and hidden.columns == docs.columns
    before, after = ({r.doc_id: r.text for r in t.collect()} for t in (clean, hidden))
    for doc_id, text in before.items():
        assert (text == after[doc_id]) or "[secret]" in after[doc_id]
        assert not secrets.base_spans(after[doc_id])
    mix = corpus_pipeline.source_mix(spark, hidden, SF).toPandas()
    taken = mixing.taken(hidden).toPandas()
    assert mix.groupby("doc_id").words.sum().to_dict() == {r.doc_id: r.taken for r in taken.itertuples() if r.taken}


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
