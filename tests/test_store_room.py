"""What a growing index leaves on disk."""

import glob
import os

from pyspark.sql import functions as F

from sourcelens.operators import index_store
from sourcelens.operators import retrieval as RT
from sourcelens.operators.index_store import IndexStore
from tests.test_candidates import corpus
from tests.test_disk import texts


def test_steps_sum_their_terms_by_shares(spark, tmp_path, monkeypatch):
    """Where a step has much text, its statistics are shuffled by shares of the terms, and are those of all at once."""
    monkeypatch.setattr(index_store, "SHARE_CHARS", 100)
    written = []
    append = IndexStore._append
    monkeypatch.setattr(IndexStore, "_append", lambda self, df, table, segment: (written.append((table, segment)), append(self, df, table, segment))[1])
    docs = corpus(spark, 3).where("doc_id is not null").dropDuplicates(["doc_id"])
    store = IndexStore(spark, str(tmp_path / "store"))
    store.apply(added=docs)
    store.apply(added=docs.where("doc_id % 5 = 0"), deleted=docs.where("doc_id % 7 = 3"))
    left = docs.where("doc_id % 7 <> 3 or doc_id % 5 = 0")
    counts = RT.term_counts(left).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    got = {tuple(r) for r in store.statistics().where("term is not null").select("term", "df", "total").collect()}
    assert got == {tuple(r) for r in counts.collect()}
    assert written == [("stats", 1)] * 3 + [("stats", 2)] * 3


def test_a_store_takes_little_more_room_than_its_texts(spark, tmp_path):
    docs, size = texts(spark)
    store = IndexStore(spark, str(tmp_path / "store"))
    store.apply(added=docs)
    files = lambda table: sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/store/{table}/**/*.parquet", recursive=True))
    assert files("tokens") < size / 2 and files("tokens") + files("docs") + files("stats") < 2 * size
