"""The vocabulary from sums by hash is the one from all terms, and texts of terms aren't shuffled for it."""

import random

import pytest
from pyspark.sql import functions as F

from sourcelens.operators import retrieval as RT


def corpus(spark, seed, n=60):
    """Very common words, words of skewed counts and many that stand once; ids repeat and are null, texts are null."""
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(4000)] + [f"once{i}" for i in range(500)]
    rows = [(i if i % 13 else None, " ".join(["all"] + r.choices(words, k=r.randint(0, 80)))) for i in range(n)]
    rows += rows[:4] + [(1000, None), (1001, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).withColumn("type", F.lit("t"))


def plain(docs, max_features, max_df=RT.MAX_DF):
    tf = RT.term_counts(docs)
    vocab = RT.vocabulary(tf, docs.select(F.count(F.lit(1)).cast("double")).scalar(), max_features, max_df)
    return sorted(tuple(r) for r in vocab.collect())


# 7: the candidates decide; 400: ties at the cut; 10,000: all terms
@pytest.mark.parametrize("max_features", [7, 400, 10_000])
def test_vocabulary_of_candidates(spark, max_features):
    docs = corpus(spark, max_features)
    index = RT.build_index(docs, max_features=max_features)
    assert sorted(tuple(r) for r in index.vocab.collect()) == plain(docs, max_features)


def test_terms_of_too_many_documents_leave_no_candidates(spark):
    docs = spark.createDataFrame([(i, "aa bb cc dd ee ff" + (" gg gg" if i == 3 else "")) for i in range(30)], "doc_id long, text string")
    assert [r["term"] for r in RT.build_index(docs, max_features=1).vocab.collect()] == ["gg"] == [r[0] for r in plain(docs, 1)]


def test_terms_of_one_hash(spark, monkeypatch):
    """Where sums by hash are those of several terms, the vocabulary is still the exact one."""
    monkeypatch.setattr(RT.F, "xxhash64", lambda c: F.crc32(F.col(c).cast("binary")) % 97)
    docs = corpus(spark, 5)
    for max_features in (7, 20):
        assert sorted(tuple(r) for r in RT.build_index(docs, max_features=max_features).vocab.collect()) == plain(docs, max_features)


def test_counts_are_shuffled_by_hash(spark):
    docs = corpus(spark, 3)
    counts = RT.term_counts(docs).select("term", F.lit(1).alias("df"), F.col("tf").alias("total"))
    plan = RT.candidate_hashes(counts, F.lit(60.0), 7)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("term" in line for line in exchanges)
