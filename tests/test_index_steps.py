"""Steps of a growing index: the vocabulary of one built anew, each term shuffled once a step."""

from sourcelens.operators import retrieval as RT
from sourcelens.operators.index_store import IndexStore
from tests.test_candidates import corpus, plain


def test_steps_give_the_vocabulary_of_an_index_built_anew(spark, tmp_path):
    docs = corpus(spark, 9).where("doc_id is not null").dropDuplicates(["doc_id"])
    store = IndexStore(spark, str(tmp_path / "store"))
    store.apply(added=docs.where("doc_id % 3 <> 0"))
    store.apply(added=docs.where("doc_id % 3 = 0 or doc_id % 5 = 0"))
    store.apply(deleted=docs.where("doc_id % 7 = 3").select("doc_id"))
    left = docs.where("doc_id % 7 <> 3")
    for max_features in (7, 300, 10_000):
        got = store.load(max_features)
        assert sorted(tuple(r) for r in got.vocab.collect()) == plain(left, max_features)
        rows = lambda x: sorted((r[0], r[1], round(r[2], 9)) for r in x.postings.collect())
        assert rows(got) == rows(RT.build_index(left, max_features=max_features))


def test_a_step_sums_its_terms_once(spark, tmp_path, monkeypatch):
    plans = {}
    write = IndexStore._write
    monkeypatch.setattr(IndexStore, "_write", lambda self, df, table, segment: (
        plans.__setitem__((table, segment), df._jdf.queryExecution().executedPlan().toString()), write(self, df, table, segment))[1])
    docs = corpus(spark, 4).where("doc_id is not null").dropDuplicates(["doc_id"])
    store = IndexStore(spark, str(tmp_path / "store"))
    store.apply(added=docs)
    store.apply(added=docs.where("doc_id % 2 = 0"))
    for step in (1, 2):
        assert sum("Exchange hashpartitioning(term" in line for line in plans["stats", step].splitlines()) == 1
