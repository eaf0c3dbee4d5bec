import zlib

import corpus_pipeline
from regolith.llm import queries


def test_stages_keep_columns_and_work_on_what_is_left(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-dedup", "decontamination", "sentencepiece"]
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and ids
        if k < 3:
            assert after.columns == docs.columns
            before = after
    assert after.columns == ["doc_id", "n_pieces", "ids"] and after.count() == before.count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == ids


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_folds():
    assert zlib.crc32(b"0") % 5 in range(5)
