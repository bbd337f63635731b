"""Approximate nearest neighbours (method: adaptive dimension scan).

Vectors are turned by one random rotation and grouped into inverted lists
around centroids that are fitted on a bounded sample.  A query scans the lists
nearest to it.  Within them, distances are summed column block by column block;
after each a hypothesis test compares the partial distance, scaled to all
dimensions, with the query's current k-th distance, and abandons candidates
that are too far with high probability.  What remains is scored in double
precision on the original vectors.

Largest inner product is searched as smallest distance: each candidate gets
one more coordinate ``sqrt(M^2 - |x|^2)`` and each query a zero there, with M
the largest norm, so distances order as inner products do.

Plan: equal vectors are collapsed first (they share one score, so only the
``k + 1`` smallest ids of each can ever be returned), which takes away hot
vectors.  Lists are dealt into blocks of ``BLOCK_ROWS`` rows (a long list into
several, short ones together) and queries into blocks of ``BLOCK_QUERIES``; a
query goes once to each block that holds a list it probes.  So a list of any
size is many small tasks.  A block returns k + 1 rows a query (and ties), and a
top-k window, limited before its shuffle, merges them.  Only the centroids and one rotation go to every task:
``LISTS`` x dimensions doubles at most.

``probes`` is fitted: the fewest lists with which a sample of queries finds
the target recall among a sample of vectors.

Defined cases: vectors that are null, empty, zero, of another length than most
or hold a null or non-finite component take no part; repeated ids count once
for each row; an empty table gives no rows; ties go to the smaller id; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, hash_sample, small_batches, written

K = 20
LISTS = 512             # upper bound of the number of inverted lists
SAMPLE_ROWS = 16_384    # vectors on which centroids and probes are fitted
SAMPLE_QUERIES = 256
RECALL = 0.985          # recall that the probes reach on the sample
BLOCK_ROWS = 4_096
BLOCK_QUERIES = 1_024
COLUMNS = 16            # dimensions of a column block
SCAN_ROWS = 512         # rows between two updates of the distance to beat
EPSILON = 2.1           # strictness of the test: higher abandons less


def sound(vector: Column) -> Column:
    """Whether every component is a finite number and one of them isn't zero."""
    v = vector.cast("array<double>")
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                      & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def lift(x: np.ndarray, largest: float) -> np.ndarray:
    """Candidates with the coordinate that turns inner products into distances."""
    rest = np.sqrt(np.maximum(0.0, largest * largest - (x * x).sum(1)))
    return np.hstack([x, rest[:, None]])


def flat(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.zeros((len(x), 1))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T


def centroids(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Lloyd's algorithm; an empty list takes a random vector again."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        near = distances(x, c).argmin(1)
        n = np.bincount(near, minlength=lists)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), lists)])
    return c


class Index:
    """Centroids, rotation and the number of lists to probe."""

    def __init__(self, sample: np.ndarray, largest: float, k: int, lists: int = LISTS, recall: float = RECALL):
        self.largest = largest
        x = lift(sample, largest)
        self.turn = rotation(x.shape[1])
        x = x @ self.turn
        self.centroids = centroids(x, max(1, min(lists, len(x) // 32)))
        self.probes = self._fit_probes(x, flat(sample[:SAMPLE_QUERIES]) @ self.turn, k, recall)

    def _fit_probes(self, x: np.ndarray, queries: np.ndarray, k: int, recall: float) -> int:
        home = distances(x, self.centroids).argmin(1)
        d = distances(queries, x)
        k = min(k + 1, len(x))
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        rank = np.argsort(np.argsort(distances(queries, self.centroids), axis=1), axis=1)
        need = np.take_along_axis(rank, home[near], axis=1)
        found = np.bincount(need.ravel(), minlength=len(self.centroids)).cumsum() / need.size
        return int(np.searchsorted(found, recall) + 1)


def adaptive_scan(queries: np.ndarray, block: np.ndarray, k: int, probed: np.ndarray | None = None, columns: int = COLUMNS,
                  epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of ``block`` (rotated vectors) to each query, with all that tie: places of queries, places in the
    block, distances; each true neighbour is among them with high probability.

    ``probed`` tells for each query which rows of the block it looks at (default: all).  The block is scanned some
    rows at a time by all queries together, so that the distances to beat shrink on the way; pairs that a test
    abandons are looked at no more.
    """
    (m, dims), n = queries.shape, len(block)
    beat = np.full(m, np.inf)
    asked, found, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for start in range(0, n, SCAN_ROWS):
        rows = block[start:start + SCAN_ROWS]
        looks = np.ones((m, len(rows)), bool) if probed is None else probed[:, start:start + SCAN_ROWS]
        q, r = np.nonzero(looks)
        partial = np.zeros(len(q))
        for lo in range(0, dims, columns):
            hi = min(lo + columns, dims)
            a, b = queries[:, lo:hi], rows[:, lo:hi]
            if 4 * len(q) > m * len(rows):              # most pairs are alive: all of them as one product
                partial = partial + np.maximum(distances(a, b), 0.0)[q, r]
            else:
                diff = b[r] - a[q]
                partial = partial + np.einsum("ij,ij->i", diff, diff)
            # sqrt(D / d) * partial distance estimates the distance: reject beyond its error bound
            slack = (1 + epsilon / np.sqrt(hi)) ** 2 if hi < dims else 1 + 1e-9
            keep = partial * (dims / hi) <= beat[q] * slack + 1e-12
            q, r, partial = q[keep], r[keep], partial[keep]
        asked, found, best = np.concatenate([asked, q]), np.concatenate([found, r + start]), np.concatenate([best, partial])
        order = np.lexsort((best, asked))
        asked, found, best = asked[order], found[order], best[order]
        first = np.searchsorted(asked, np.arange(m))
        count = np.searchsorted(asked, np.arange(m), side="right") - first
        full = count >= k
        beat[full] = best[first[full] + k - 1]
        keep = best <= beat[asked] * (1 + 1e-9) + 1e-12
        asked, found, best = asked[keep], found[keep], best[keep]
    return asked, found, best


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def _unpacked(column: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), dims)


def deal_lists(sizes: dict[int, int], block_rows: int = BLOCK_ROWS) -> dict[int, tuple[int, int]]:
    """For each list its first block and how many it has: long lists are cut, short neighbours share a block."""
    out, block, room = {}, -1, 0
    for k in sorted(sizes):
        if sizes[k] > block_rows // 2:
            n = -(-sizes[k] // block_rows)
            out[k] = (block + 1, n)
            block, room = block + n, 0
        else:
            if sizes[k] > room:
                block, room = block + 1, block_rows
            room -= sizes[k]
            out[k] = (block, 1)
    return out


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding",
           lists: int = LISTS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k nearest other rows among all vectors."""
    spark = vectors.sparkSession
    small_batches(spark)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where(
        F.col("vec_id").isNotNull() & sound(F.col("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    facts = base.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m")).orderBy(F.desc("n"), "dims").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if facts is None:
        return spark.createDataFrame([], schema)
    base = base.where(F.size("v") == facts["dims"])
    sample = bounded(base.where(hash_sample(F.col("vec_id"), SAMPLE_ROWS / facts["n"])).select("v"), 2 * SAMPLE_ROWS).toPandas()["v"]
    if not len(sample):
        sample = base.limit(SAMPLE_ROWS).select("v").toPandas()["v"]
    index = Index(_matrix(sample), float(facts["m"]), k, lists, recall)
    turn, centers, largest, probes = index.turn, index.centroids, index.largest, index.probes

    # equal vectors: one row with the smallest ids that can be returned
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    few = base.withColumn("rn", F.row_number().over(by_vector)).where(F.col("rn") <= k + 1)
    distinct = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    distinct = written(distinct.withColumn("vid", F.element_at("ids", 1)), "vectors")
    wanted = base.where(F.coalesce(is_query, F.lit(False)))
    queries = written(wanted.join(distinct.select("v", "vid"), "v").select(F.col("vec_id").alias("query_id"), "vid", "v"), "queries")

    dims = facts["dims"] + 1
    n_lists = len(centers)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The list and the rotated vector of each candidate."""
        for f in frames:
            if len(f):
                x = lift(_matrix(f["v"]), largest) @ turn
                yield pd.DataFrame({"list": distances(x, centers).argmin(1).astype(np.int32), "vid": f["vid"].to_numpy(),
                                    "x": [row.tobytes() for row in x]})

    placed = written(distinct.select("vid", "v").mapInPandas(place, "list int, vid long, x binary"), "lists")
    where = deal_lists({r["list"]: r["count"] for r in placed.groupBy("list").count().collect()})   # LISTS rows at most
    asked = queries.select("vid", "v").dropDuplicates(["vid"])
    q_blocks = max(1, -(-asked.count() // BLOCK_QUERIES))

    def probed(x: np.ndarray) -> np.ndarray:
        d = distances(x, centers)
        return np.argpartition(d, probes - 1, axis=1)[:, :probes] if probes < n_lists else np.tile(np.arange(n_lists), (len(x), 1))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query, rotated, once for every block that holds a list it probes."""
        for f in frames:
            if not len(f):
                continue
            x = flat(_matrix(f["v"])) @ turn
            rows, blocks = [], []
            for k, lists_of in enumerate(probed(x)):
                mine = {where[l][0] + j for l in lists_of.tolist() if l in where for j in range(where[l][1])}
                rows += [k] * len(mine)
                blocks += sorted(mine)
            raw = [row.tobytes() for row in x]
            yield pd.DataFrame({"b": np.array(blocks, np.int32), "vid": f["vid"].to_numpy()[np.array(rows, np.int64)],
                                "x": [raw[k] for k in rows]})

    first, count = ([(where.get(k, (0, 1)))[i] for k in range(n_lists)] for i in (0, 1))
    of_list = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("list") + 1)
    # every block meets each block of the queries that probe it
    left = (placed.withColumn("b", (of_list(first) + F.pmod(F.xxhash64("vid"), of_list(count))).cast("int"))
            .withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))
    right = asked.mapInPandas(ask, "b int, vid long, x binary").withColumn("q", F.pmod(F.xxhash64("vid"), F.lit(q_blocks)).cast("int"))

    def scan(candidates: pd.DataFrame, probing: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(probing):
            return pd.DataFrame({"qid": np.zeros(0, np.int64), "vid": np.zeros(0, np.int64), "d": np.zeros(0)})
        candidates = candidates.sort_values("list")
        ids, lists_of, qids = candidates["vid"].to_numpy(), candidates["list"].to_numpy(), probing["vid"].to_numpy()
        asking = _unpacked(probing["x"], dims)
        mine = np.zeros((len(asking), n_lists), bool)
        np.put_along_axis(mine, probed(asking), True, axis=1)
        q, r, d = adaptive_scan(asking, _unpacked(candidates["x"], dims), k + 1, mine[:, lists_of])
        return pd.DataFrame({"qid": qids[q], "vid": ids[r], "d": d})

    pairs = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(scan, "qid long, vid long, d double")
    # twice as many as are asked for go on to the exact score, so rounding in the rotated space can't decide
    nearest = Window.partitionBy("qid").orderBy("d", "vid")
    pairs = written(pairs.withColumn("rn", F.row_number().over(nearest)).where(F.col("rn") <= 2 * (k + 1)).select("qid", "vid"), "pairs")
    product = F.aggregate(F.zip_with("qv", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    scored = (pairs.join(distinct.select("vid", "v", "ids"), "vid")
              .join(queries.select(F.col("vid").alias("qid"), F.col("v").alias("qv")).dropDuplicates(["qid"]), "qid")
              .select("qid", "vid", "ids", product.alias("score")))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vid")
    top = scored.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1).drop("rn", "vid")
    # every row of the queries, every id of the vectors found, the query's own row left out
    rows = (queries.select("query_id", F.col("vid").alias("qid")).join(top, "qid")
            .select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
