"""Recall and exact scores against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourcelens.llm import ann


def brute(ids, x, queries, k=20):
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        s = x @ x[i]
        order = np.lexsort((ids, -s))
        out[int(q)] = [(int(ids[j]), float(s[j])) for j in order if j != i][:k]
    return out


def vectors(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "vec_id long, embedding array<double>")


def recall(rows, want):
    found = {}
    for r in rows:
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = sum(len(set(found.get(q, {})) & {i for i, _ in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["spherical", "norms", "clusters"])
def test_recall(spark, kind):
    r = np.random.default_rng(7)
    n, d = 3000, 24
    x = r.standard_normal((n, d))
    if kind == "clusters":
        x = r.standard_normal((20, d))[r.integers(0, 20, n)] * 3 + x * 0.5
    if kind != "norms":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    else:
        x *= r.uniform(0.2, 3, (n, 1))
    ids = np.arange(n)
    rows = ann.search(vectors(spark, ids, x), F.col("vec_id") % 20 == 0).collect()
    want = brute(ids, x, ids[::20])
    assert recall(rows, want) >= 0.95
    assert len(rows) == 20 * len(want)
    for q in want:
        mine = sorted((a for a in rows if a.query_id == q), key=lambda a: a.rank)
        assert [a.rank for a in mine] == list(range(1, 21))
        assert [(-a.score, a.vec_id) for a in mine] == sorted((-a.score, a.vec_id) for a in mine)
        assert all(abs(a.score - float(x[a.vec_id] @ x[q])) < 1e-9 for a in mine)


def test_given_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = ann.search(table, F.col("vec_id") % 20 == 0).collect()
    assert recall(got, brute(ids, x, [i for i in ids if i % 20 == 0])) >= 0.95


def test_hot_vector_and_ties(spark):
    """A third of the rows hold one vector; its queries find the smallest other ids, each other's among them."""
    r = np.random.default_rng(1)
    n = 900
    x = r.standard_normal((n, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0]
    ids = np.arange(n)
    got = ann.search(vectors(spark, ids, x), F.col("vec_id") % 20 == 0).collect()
    mine = {}
    for a in sorted(got, key=lambda a: a.rank):
        mine.setdefault(a.query_id, []).append(a.vec_id)
    for q in range(0, n, 60):
        assert mine[q] == [i for i in range(0, n, 3) if i != q][:20]


def test_adaptive_scan_keeps_the_nearest_and_abandons_most():
    r = np.random.default_rng(2)
    block, queries = r.standard_normal((4000, 64)), r.standard_normal((30, 64))
    q, found, d = ann.adaptive_scan(queries, block, 10)
    hits = 0
    for k in range(30):
        near = set(np.argsort(((block - queries[k]) ** 2).sum(1))[:10].tolist())
        hits += len(near & set(found[q == k].tolist()))
    assert hits >= 0.98 * 300 and len(found) == 300
    assert np.allclose(d, ((block[found] - queries[q]) ** 2).sum(1))
    # only the rows that a query looks at
    looks = r.random((30, 4000)) < 0.02
    q, found, _ = ann.adaptive_scan(queries, block, 10, looks)
    assert looks[q, found].all() and len(found) == 300


def test_lists_are_dealt_into_even_blocks():
    where = ann.deal_lists({0: 10, 1: 9000, 2: 4000, 3: 100, 4: 200, 7: 3900, 8: 1}, 4096)
    blocks = {}
    for k, n in {0: 10, 1: 9000, 2: 4000, 3: 100, 4: 200, 7: 3900, 8: 1}.items():
        first, count = where[k]
        for b in range(first, first + count):
            blocks[b] = blocks.get(b, 0) + n / count
    assert max(blocks.values()) <= 4096 and sorted(blocks) == list(range(len(blocks)))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (1, [0.5, 0.5], "x"), (2, None, "x"), (3, [0.0, 0.0], "x"), (4, [nan, 1.0], "x"), (5, [inf, 1.0], "x"),
            (6, [None, 1.0], "x"), (7, [], "x"), (20, [0.0, 1.0], None), (40, None, "x"), (60, [0.0, 0.0], "x"), (None, [1.0, 1.0], "x"),
            (8, [1.0, 2.0, 3.0], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0)]
    assert ann.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(table.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(table, F.lit(False)).count() == 0
