"""Each stage against what it has to do, on its own input."""

import corpus_pipeline
import public_tokenizers as P
from sourcelens.llm import lang_id, near_dup, pii, quality_cnn
from sourcelens.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for (name, stage), number in zip(corpus_pipeline.STAGES, (1, 2, 3, 8, 9)):
        out = written(stage(spark, docs, SF), "test-stage")
        if number == 1:
            found = lang_id.identify(docs, P.path("piece_bpe_32k.model"))
            assert ids(out) == ids(found.where("lang_pred <> 'und' and score >= 0.5"))
        elif number == 2:
            assert ids(out) == ids(quality_cnn.classify(docs, labels).where("predicted = 1"))
            wrong = docs.join(labels.where("quality = 1"), "doc_id").count() - out.join(labels.where("quality = 1"), "doc_id").count()
            assert wrong <= 5
        elif number == 3:
            classes = near_dup.near_duplicates(docs)
            assert ids(out) == sorted({r.class_id for r in classes.collect()})
        elif number == 8:
            assert ids(out) == ids(docs)
            found = pii.entity_table(docs)
            assert found.join(out, "doc_id").where("contains(text, value)").count() == 0
            assert out.where("n_chars <> length(text)").count() == 0
        else:
            assert ids(out) == ids(docs)
        if number != 9:
            assert out.columns == columns and out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out


def test_odd_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:4]:
            new = written(stage(spark, docs, SF), "test-stage")
            assert new.columns == docs.columns
            docs = new
        assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == docs.count()


def test_further_columns_of_any_name_are_carried_along(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80).selectExpr(
        "*", "doc_id AS `a.b`", "source AS __found", "n_chars AS `row`", "lang AS `q``x`", "1.5 AS rep", "doc_id AS class_id", "'k' AS `found`")
    for _, stage in corpus_pipeline.STAGES[:4]:
        new = written(stage(spark, docs, SF), "test-stage")
        assert new.columns == docs.columns and new.where("doc_id <> `a.b` OR source <> __found OR lang <> `q``x`").count() == 0
        docs = new
    assert docs.count() > 20 and corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == docs.count()
