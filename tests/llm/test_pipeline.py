import corpus_pipeline
from jobmeter.llm import decontamination, jaccard, linededup, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]


def test_stages_keep_columns_and_act(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, given = docs.columns, docs.count()
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == columns and after.schema == docs.schema
        kept.append(after.count())
        if name == "toxicity":
            bad = toxicity.score_documents(docs, labels).where("predicted = 1")
            assert after.join(bad, "doc_id").count() == 0 and after.count() + bad.count() == docs.count()
        docs = after
    assert given >= kept[0] >= kept[1] >= kept[2] >= kept[3] > given / 2
    assert linededup.line_report(docs).where("n_dropped > 0").count() == 0
    assert jaccard.similarity_components(docs).where("doc_id != component_id").count() == 0
    assert decontamination.contamination_report(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == kept[3]


def test_run_gives_what_the_stages_give(spark):
    packed = corpus_pipeline.run(spark, SF)
    again = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        again = stage(spark, again, SF)
    pick = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert pick(packed) == pick(again)


def test_empty_documents(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
