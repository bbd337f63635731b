"""An index grown by steps against one built anew."""

import random

from sourcelens.operators import retrieval as RT
from sourcelens.operators.index_store import IndexStore

WORDS = [f"word{k}" for k in range(60)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "src", "kind") for i, t in rows], "doc_id long, text string, source string, type string")


def table(index):
    vocab = sorted((r.term, r.df, r.total, round(r.idf, 9)) for r in index.vocab.collect())
    postings = sorted((r.doc_id, r.term, round(r.weight, 9)) for r in index.postings.collect())
    norms = sorted((r.doc_id, round(r.norm, 9)) for r in index.norms.collect())
    return vocab, postings, norms, sorted(r.doc_id for r in index.docs.collect())


def test_steps_equal_a_full_rebuild(spark, tmp_path):
    r = random.Random(4)
    text = lambda: " ".join(r.choice(WORDS) for _ in range(r.randint(0, 25)))
    store, state = IndexStore(spark, str(tmp_path / "index")), {}

    def step(added=(), deleted=()):
        new = {i: text() for i in added}
        store.apply(docs(spark, new.items()) if added else None, docs(spark, [(i, "") for i in deleted]) if deleted else None)
        for i in deleted:
            state.pop(i, None)
        state.update(new)

    def same():
        assert table(store.load(max_features=40)) == table(RT.build_index(docs(spark, sorted(state.items())), max_features=40))

    step(added=range(12))
    step(added=range(8, 20), deleted=[1, 2, 99])    # some replaced, some deleted, one never there
    same()
    step(deleted=[3, 9])
    step(added=[3, 1])                              # back again
    same()
    assert len(store.segments()) == 4 and not store.merge()
    assert store.merge(force=True) and len(store.segments()) == 1
    same()
    step(added=[50], deleted=[0])
    same()


def test_a_step_that_fails_leaves_no_trace(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.apply(docs(spark, [(1, "alpha beta"), (2, "beta gamma")]))
    before = table(store.load())
    store._commit = lambda segments: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        store.apply(docs(spark, [(3, "delta")]), docs(spark, [(1, "")]))
    except RuntimeError:
        pass
    again = IndexStore(spark, str(tmp_path / "index"))
    assert table(again.load()) == before
    again.apply(docs(spark, [(4, "epsilon beta")]))
    assert table(again.load()) == table(RT.build_index(docs(spark, [(1, "alpha beta"), (2, "beta gamma"), (4, "epsilon beta")])))


def test_all_documents_deleted(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.apply(docs(spark, [(1, "alpha beta")]))
    store.apply(deleted=docs(spark, [(1, "")]))
    assert table(store.load()) == ([], [], [], [])
