"""Metamorphic properties and retrieval sanity checks."""

from pyspark.sql import functions as F

from sourcelens.operators import extract as E
from sourcelens.operators import retrieval as RT
from sourcelens.operators import stats as S
from tests.conftest import SF_SMALL


def test_total_is_code_plus_blank(spark):
    from sourcelens.plans.catalog import doc_corpus
    m = E.metrics_only(doc_corpus(spark, SF_SMALL))
    assert m.where(F.col("total_lines") != F.col("code_lines") + F.col("blank_lines")).count() == 0


def test_comment_line_keeps_functions(analyze_rows):
    src = "def a():\n    return 1\n\ndef b(x):\n    return x\n"
    r = analyze_rows([("x.py", "python", src), ("y.py", "python", src + "# a comment that names no definition\n")])
    assert [f["name"] for f in r["x.py"]["functions"]] == [f["name"] for f in r["y.py"]["functions"]]


def test_split_corpus_preserves_totals(spark):
    from sourcelens.plans.catalog import corpus
    files = corpus(spark, SF_SMALL)
    one = files.withColumn("repo", F.lit("all"))
    two = files.withColumn("repo", F.when(F.col("path") < "m", "left").otherwise("right"))
    t1 = S.repo_summary(E.analyze(one)).agg(F.sum("total_functions"), F.sum("total_classes")).collect()[0]
    t2 = S.repo_summary(E.analyze(two)).agg(F.sum("total_functions"), F.sum("total_classes")).collect()[0]
    assert tuple(t1) == tuple(t2)


def test_document_finds_itself(spark):
    from sourcelens.plans.catalog import kb_documents
    docs = kb_documents(spark, SF_SMALL)
    idx = RT.build_index(docs)
    probe = docs.where(F.length("text") > 2000).orderBy("doc_id").limit(5).select(
        F.col("doc_id").alias("qid"), "text")
    hits = RT.search(idx, probe).where(F.col("rank") == 1).collect()
    assert len(hits) == 5 and all(h["qid"] == h["doc_id"] for h in hits)


def test_blank_question_gets_fixed_answer(spark):
    from sourcelens.plans.catalog import kb_documents
    idx = RT.build_index(kb_documents(spark, SF_SMALL))
    qs = spark.createDataFrame([(1, "   "), (2, "zzzqqq unknownword")], "qid long, text string")
    got = {r["qid"]: r for r in RT.answers(idx, qs).collect()}
    assert got[1]["n_sources"] == 0 and got[1]["confidence"] == "low"
    assert got[1]["answer"].startswith("I couldn't find relevant information")
    assert got[2]["n_sources"] == 0


def test_single_document_index_is_empty(spark):  # Q16
    docs = spark.createDataFrame([(1, "s", "document", "alpha beta gamma")], "doc_id long, source string, type string, text string")
    idx = RT.build_index(docs)
    assert idx.vocab.count() == 0


def test_grouped_index_equals_separate_indexes(spark):
    """One knowledge base per repository = fitting each repository alone."""
    from sourcelens.plans.catalog import kb_documents
    docs = kb_documents(spark, SF_SMALL).where(F.col("source").isin("src1", "src2"))
    qs = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text")
    grouped = RT.build_index(docs, group="source", max_features=300)
    qg = qs.select("*", F.explode(F.array(F.lit("src1"), F.lit("src2"))).alias("source")) \
        .withColumn("qid", F.col("qid") * 10 + F.when(F.col("source") == "src1", 1).otherwise(2))
    got = RT.search(grouped, qg, min_similarity=0.0).select("qid", "doc_id", "rank", F.round("score", 9).alias("s"))
    want = None
    for i, src in ((1, "src1"), (2, "src2")):
        idx = RT.build_index(docs.where(F.col("source") == src), max_features=300)
        part = RT.search(idx, qs.withColumn("qid", F.col("qid") * 10 + i), min_similarity=0.0) \
            .select("qid", "doc_id", "rank", F.round("score", 9).alias("s"))
        want = part if want is None else want.unionByName(part)
        gv = grouped.vocab.where(F.col("source") == src).select("term", "df", "total", F.round("idf", 9).alias("idf"))
        sv = idx.vocab.select("term", "df", "total", F.round("idf", 9).alias("idf"))
        assert gv.exceptAll(sv).count() == 0 and sv.exceptAll(gv).count() == 0
    assert got.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
