"""The dynamic program against every way to cut, and the batches' invariants."""

import itertools
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from sourcelens.llm import packing as K


def least_padding(lengths, n_buckets):
    values = sorted(set(lengths))
    best = float("inf")
    for k in range(min(n_buckets, len(values))):
        for cuts in itertools.combinations(values[:-1], k):
            bounds = [*cuts, values[-1]]
            best = min(best, sum(next(b for b in bounds if b >= x) - x for x in lengths))
    return best


def test_buckets_have_the_least_padding():
    r = random.Random(4)
    for _ in range(200):
        lengths = [r.choice([r.randint(0, 9), r.randint(0, 60)]) for _ in range(r.randint(1, 25))]
        lengths = [x for x in lengths if x in set(sorted(set(lengths))[:9])]
        n = r.randint(1, 4)
        cells = sorted(set(lengths))
        got = K.optimal_buckets(*(np.array(x) for x in (cells, [lengths.count(c) for c in cells], [lengths.count(c) * c for c in cells], cells)), n)
        assert len(got) <= n and sum(b.rows for b in got) == len(lengths)
        pad = sum(next(b.boundary for b in got if b.boundary >= x) - x for x in lengths)
        assert pad == least_padding(lengths, n)


def test_cells_are_monotone_and_few(spark):
    rows = spark.range(0, 40_000).select("id", K.cell(F.col("id"), 64).alias("c")).collect()
    cells = [r.c for r in sorted(rows)]
    assert all(c >= i for i, c in enumerate(cells)) and cells == sorted(cells)
    assert cells[:64] == list(range(64)) and len(set(cells)) < 64 + 32 * 11


def test_batches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for per_salt in (10, 2_000):
        rows = K.pack(docs, token_budget=4_000, n_buckets=5, rows_per_salt=per_salt).collect()
        assert len(rows) == docs.count()
        batches = defaultdict(list)
        for r in rows:
            assert r.n_tokens <= r.boundary
            batches[r.batch_id].append(r)
        part_full = 0
        for b in batches.values():
            assert len({r.bucket for r in b}) == 1 and sorted(r.slot for r in b) == list(range(len(b)))
            assert len(b) == 1 or len(b) * b[0].boundary <= 4_000
            part_full += len(b) < max(1, 4_000 // b[0].boundary)
        assert part_full <= 5               # one batch a bucket at most isn't full, however it is salted
        assert sorted(batches) == list(range(len(batches)))


def test_odd_tables(odd_docs, no_docs):
    rows = K.pack(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.doc_id: r.n_tokens for r in rows}[3] == 0 == {r.doc_id: r.n_tokens for r in rows}[4]
    long = K.pack(odd_docs, token_budget=100).where("n_tokens > 100").collect()
    assert long and all(r.slot == 0 for r in long)
    assert K.pack(no_docs).count() == 0


def test_rows_of_one_id_are_spread_over_the_salts(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    for of in (docs, docs.withColumn("doc_id", F.lit(None).cast("long"))):
        rows = K.pack(of, token_budget=30, rows_per_salt=100).collect()
        assert len({(r.batch_id, r.slot) for r in rows}) == 3000 and {r.batch_id for r in rows} == set(range(300))
        salts = of.withColumn("row", F.monotonically_increasing_id()).groupBy(F.pmod(F.xxhash64("row"), F.lit(30))).count()
        assert salts.agg(F.max("count")).first()[0] < 200
