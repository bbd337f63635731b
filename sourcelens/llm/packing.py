"""Packing (method: optimal length buckets).

The global histogram of document lengths is one small aggregate.  A dynamic
program over it finds the ``n_buckets`` boundaries with the least padding,
where a document of length ``n`` in a bucket with boundary ``b`` is padded by
``b - n``.  Inside each bucket, documents form batches whose padded size
(rows x boundary) stays within ``token_budget``.

Plan: lengths are computed once and written (id and length only); texts are
never shuffled.  A bucket may hold any share of the rows, so its rows are
salted; the rank of a row is its rank within (bucket, salt) plus the count of
the salts before it, so a bucket has only one batch that isn't full.

Defined cases: a null or empty text has length 0 and is packed; a document
longer than the budget makes a batch of its own (never cut); repeated rows
are packed once per row; a null id is packed like any other; an empty table
gives no rows; columns beyond id and text are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TOKEN_BUDGET = 32_768
N_BUCKETS = 16
RESOLUTION = 256        # lengths up to this are told apart; above it, RESOLUTION / 2 steps an octave
ROWS_PER_SALT = 2_000


class Bucket(NamedTuple):
    low: int            # smallest histogram cell of the bucket
    high: int           # largest
    boundary: int       # padded length: the longest document in it
    rows: int


def word_count(text: Column) -> Column:
    """Length of a document: its words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def cell(length: Column, resolution: int = RESOLUTION) -> Column:
    """The histogram cell of a length: itself, or for long ones the next multiple of a power of two.

    Bounds the histogram by the logarithm of the longest document.
    """
    n = length.cast("long")
    bits = F.length(F.bin(n)) - (resolution.bit_length() - 1)
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(bits, F.lit(0)))
    return F.ceil(n / step).cast("long") * step


def optimal_buckets(cells: np.ndarray, counts: np.ndarray, sums: np.ndarray, longest: np.ndarray,
                    n_buckets: int) -> list[Bucket]:
    """Least total padding over all ways to cut the sorted cells into at most ``n_buckets`` runs."""
    m = len(cells)
    if not m:
        return []
    c = np.concatenate(([0], np.cumsum(counts, dtype=np.float64)))
    s = np.concatenate(([0], np.cumsum(sums, dtype=np.float64)))
    best = np.full(m + 1, np.inf)
    best[0] = 0
    back = np.zeros((min(n_buckets, m), m + 1), np.int64)
    last = best
    for k in range(len(back)):
        now = np.full(m + 1, np.inf)
        for j in range(1, m + 1):
            cost = last[:j] + longest[j - 1] * (c[j] - c[:j]) - (s[j] - s[:j])
            back[k, j] = i = int(np.argmin(cost))
            now[j] = cost[i]
        last = now
    out, j = [], m
    for k in range(len(back) - 1, -1, -1):
        i = int(back[k, j])
        out.append(Bucket(int(cells[i]), int(cells[j - 1]), int(longest[j - 1]), int(c[j] - c[i])))
        j = i
        if not j:
            break
    return out[::-1]


def plan_buckets(lengths: DataFrame, n_buckets: int = N_BUCKETS, resolution: int = RESOLUTION) -> list[Bucket]:
    rows = (lengths.groupBy(cell(F.col("n_tokens"), resolution).alias("cell"))
            .agg(F.count(F.lit(1)).alias("c"), F.sum("n_tokens").alias("s"), F.max("n_tokens").alias("m"))
            .orderBy("cell").collect())
    return optimal_buckets(*(np.array([r[i] for r in rows], np.int64) for i in range(4)), n_buckets)


def pack(docs: DataFrame, length: Column | None = None, token_budget: int = TOKEN_BUDGET,
         n_buckets: int = N_BUCKETS, rows_per_salt: int = ROWS_PER_SALT, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, bucket, boundary, batch_id (unique over all buckets), slot (from 0)."""
    length = word_count(F.col("text")) if length is None else length
    # each row has a number of its own, so that repeated and null ids are spread over the salts as well
    lengths = written(docs.select(F.col(id_col).alias("doc_id"), length.cast("long").alias("n_tokens"))
                      .withColumn("row", F.monotonically_increasing_id()), "lengths")
    buckets = plan_buckets(lengths, n_buckets)
    if not buckets:
        return lengths.select("doc_id", "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("boundary"),
                              F.lit(0).cast("long").alias("batch_id"), F.lit(0).cast("long").alias("slot"))
    bucket, at = F.lit(len(buckets) - 1), cell(F.col("n_tokens"))
    for k in range(len(buckets) - 2, -1, -1):
        bucket = F.when(at <= buckets[k].high, k).otherwise(bucket)
    capacity = [max(1, token_budget // max(1, b.boundary)) for b in buckets]
    first, start = 0, []
    for b, cap in zip(buckets, capacity):
        start.append(first)
        first += -(-b.rows // cap)

    def of_bucket(values) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket") + 1)

    salted = (lengths.withColumn("bucket", bucket)
              .withColumn("salt", F.pmod(F.xxhash64("row"), of_bucket([-(-b.rows // rows_per_salt) for b in buckets]))))
    before = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (salted.groupBy("bucket", "salt").agg(F.count(F.lit(1)).alias("c"))
               .select("bucket", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset")))
    ranked = salted.withColumn("rn", F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("doc_id", "n_tokens", "row")))
    rank = F.col("offset") + F.col("rn") - 1
    cap = of_bucket(capacity)
    return (ranked.join(offsets, ["bucket", "salt"])
            .select("doc_id", "n_tokens", "bucket", of_bucket([b.boundary for b in buckets]).alias("boundary"),
                    (of_bucket(start) + F.floor(rank / cap)).alias("batch_id"), (rank % cap).alias("slot")))
