import corpus_pipeline
from ballast.functions.store import written


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf), name)
        assert out.columns == docs.columns
        counts.append(out.count())
        docs = out
    assert counts[1] < counts[0] and counts[2] < counts[1]
    packed = written(corpus_pipeline.STAGES[-1][1](spark, docs, sf), "packed")
    assert packed.where("piece = 0").count() == counts[3]
    ids = {r[0] for r in docs.select("doc_id").collect()}
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == ids


def test_whole_run_repeats(spark, sf):
    rows = lambda: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert rows() == rows()


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
    assert docs.count() == 0
