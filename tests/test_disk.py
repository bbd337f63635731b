"""What indexing and searching leave on disk, and the vocabulary from sums that tasks cut."""

import glob
import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sourcelens import session
from sourcelens.operators import retrieval as RT
from tests.test_candidates import corpus, plain


def room(spark, since: int) -> int:
    """Bytes of what was written after the first ``since`` tables."""
    paths = [p.removeprefix("file:") for p in session._WRITTEN[spark.sparkContext.applicationId][since:]]
    return sum(os.path.getsize(f) for p in paths for f in glob.glob(f"{p}/**/*.parquet", recursive=True))


def texts(spark, n=300, words=400):
    r = random.Random(2)
    known = ["".join(r.choices("abcdefghijklmnopqrst", k=r.randint(3, 9))) for _ in range(5000)]
    rows = [(i, " ".join(r.choices(known, k=words)), "s", "t") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, type string").repartition(4), sum(len(x[1]) for x in rows)


def test_written_leaves_no_shuffle_files(spark):
    tops = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in tops for f in glob.glob(f"{d}/*/shuffle_*")}
    before = files()
    session.written(spark.range(10_000).repartition(5, "id"), "shuffled")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before


def test_an_index_takes_less_room_than_its_texts(spark):
    docs, size = texts(spark)
    since = session.written_so_far(spark)
    RT.build_index(docs, max_features=300)
    assert room(spark, since) < size


@pytest.mark.parametrize("passed_on, held", [(3, 5), (3, 10_000), (50, 20), (1000, 10_000)])
def test_sums_passed_on_and_their_bound(passed_on, held):
    r = np.random.default_rng(passed_on + held)
    pieces = [np.unique(r.zipf(1.3, 300) % 997, return_counts=True) for _ in range(20)]
    out = pa.Table.from_batches(list(RT._frequent(iter(pieces), passed_on, held))).to_pylist()
    lacking = sum(x["total"] for x in out if x["h"] is None)
    sums, true = {}, {}
    for x in out:
        if x["h"] is not None:
            sums[x["h"]] = sums.get(x["h"], 0) + x["total"]
    for h, n in pieces:
        for a, b in zip(h.tolist(), n.tolist()):
            true[a] = true.get(a, 0) + b
    assert all(sums.get(h, 0) <= n <= sums.get(h, 0) + lacking for h, n in true.items())
    assert lacking == 0 if passed_on == 1000 else lacking > 0


def test_where_candidates_do_not_decide_all_terms_are_counted(spark, monkeypatch):
    monkeypatch.setattr(RT, "PASSED_ON", 1)
    docs = corpus(spark, 8)
    for max_features in (5, 120):
        assert sorted(tuple(r) for r in RT.build_index(docs, max_features=max_features).vocab.collect()) == plain(docs, max_features)


def test_postings_of_repeated_and_null_ids(spark, monkeypatch):
    """The rows of one id are one document, in pieces of any size."""
    docs = corpus(spark, 6)
    want = None
    for piece in (4 << 20, 1):
        monkeypatch.setattr(RT, "PIECE_BYTES", piece)
        index = RT.build_index(docs, max_features=90)
        tf = RT.term_counts(docs).join(index.vocab, "term").withColumn("w", F.col("tf") * F.col("idf"))
        norms = {r["doc_id"]: r["n"] for r in tf.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n")).collect()}
        want = want or sorted((str(r["doc_id"]), r["term"], round(r["w"] / norms[r["doc_id"]], 9)) for r in tf.collect())
        assert sorted((str(r["doc_id"]), r["term"], round(r["weight"], 9)) for r in index.postings.collect()) == want
        assert {r["doc_id"]: round(r["norm"], 9) for r in index.norms.collect()} == {k: round(v, 9) for k, v in norms.items()}


def test_blocks_of_questions_and_documents(spark, monkeypatch):
    """However the questions and the documents of a task are cut, the hits are the same, and equal scores go by id."""
    docs, _ = texts(spark, 60, 30)
    docs = docs.unionByName(docs.limit(20).withColumn("doc_id", F.col("doc_id") + 1000))
    index = RT.build_index(docs)
    questions = docs.select(F.col("doc_id").alias("qid"), F.substring("text", 1, 90).alias("text"))
    hits = lambda i, **kw: sorted(tuple(r) for r in RT.search(i, questions, **kw).collect())
    want = hits(index)
    assert want and hits(index, block_bytes=2000) == want
    monkeypatch.setattr(RT, "POSTING_BLOCK_BYTES", 600)
    assert hits(index) == want
    assert hits(RT.Index(index.vocab, index.postings, index.norms, index.docs)) == want
