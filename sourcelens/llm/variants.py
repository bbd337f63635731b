"""Spelling variant grouping (method: dense prefix-suffix tiling).

Words are counted over the whole corpus; then each word looks for the words one edit away.  Two words differ by exactly
one inserted, deleted or replaced code point if, L being the longer length, their common prefix and common suffix
together reach L - 1.  Tiles of words stand as padded matrices of code points, once aligned left and once right; a pair
of tiles is compared column by column, all words of one against all of the other, and the two running lengths of
agreement decide.

Which tiles meet: of a near pair, prefix or suffix reaches half of L, L // 2 code points.  So each word has four keys,
for L its own length and one more, the first and the last L // 2 code points, and only words of one key are compared.  A
pair that shares both counts under the prefix.  Small keys share a tile.  A key of more than ``TILE`` words is dealt
into parts by hash, and each pair of parts is one tile pair in a task of its own: memory stays bounded and nothing is
cut, however common a beginning or an ending is.  A tile sends one row a word (number of near words, the most frequent
of them), never the pairs.

A word's form is its most frequent near word, if that has at least ``RATIO`` times its count.  Counts grow by that
ratio along a chain of forms, so chains are shorter than the logarithm of the largest count; roots are found by
doubling, following 1, 2, 4, ... forms.

Defined cases: a null text has no words, a null id hashes as an empty string; ties go to the smallest word in code-point
order; repeated rows count again; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
EVERY = 199             # one run in so many loses a code point
TILE = 4096             # words of one key that one task compares with each other
PANEL = 256             # rows of one dense comparison
FEW = 64                # smaller keys are compared together, up to so many words at a time

_UPPER = "".join(chr(c) for c in range(65, 91))


def runs(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """word: the runs of letters of each text, A-Z in lower case, one in ``EVERY`` less one code point.

    A word has at least ``LEAST_LENGTH`` code points, so shorter runs are never looked at.
    """
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"),
                        F.explode(F.regexp_extract_all(F.translate(F.col("text").cast("string"), _UPPER, _UPPER.lower()),
                                                       F.lit(rf"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat(F.col("doc"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return found.withColumn("h", h).select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))


def word_counts(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """word, n: words of ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences at least."""
    return runs(docs, id_col).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")) \
        .where(F.col("n") >= LEAST_COUNT)


def with_keys(words: DataFrame) -> DataFrame:
    """Four rows a word: L, side (0 prefix, 1 suffix), half (the code points of that half)."""
    keys = []
    for more in (0, 1):
        longer = F.length("word") + more
        size = F.floor(longer / 2).cast("int")
        for side, half in enumerate((F.substring(F.col("word"), F.lit(1), size), F.expr(f"right(word, CAST(floor((length(word) + {more}) / 2) AS INT))"))):
            keys.append(F.struct(longer.cast("int").alias("len"), F.lit(side).alias("side"), half.alias("half")))
    return words.select("word", "n", F.explode(F.array(*keys)).alias("k")).select("word", "n", "k.len", "k.side", "k.half")


def dealt(keyed: DataFrame, tile: int = TILE) -> DataFrame:
    """``keyed`` with the pair of parts (i <= j) in which a row stands: one for a key of at most ``tile`` words, else as
    many as the key has parts; ``part`` is the row's own."""
    key = ["len", "side", "half"]
    large = keyed.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > tile) \
        .select(*key, F.ceil(F.col("size") / tile).cast("int").alias("parts"))
    return keyed.join(large, key, "left") \
        .withColumn("parts", F.coalesce("parts", F.lit(1))) \
        .withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))) \
        .select("word", "n", *key, "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))


class Tile:
    """Words as rows of code points, aligned left and right; the paddings of two tiles never agree."""

    def __init__(self, words: list[str], width: int, pad: int):
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        self.length = np.array([len(w) for w in words], np.int32)
        ends = np.cumsum(self.length)
        row = np.repeat(np.arange(len(words)), self.length)
        at = np.arange(len(points)) - np.repeat(ends - self.length, self.length)
        self.left = np.full((width, len(words)), pad, np.uint32)
        self.right = self.left.copy()
        self.left[at, row] = points
        self.right[np.repeat(self.length, self.length) - 1 - at, row] = points


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading columns on which each row of one tile agrees with each row of the other."""
    on = np.ones((a.shape[1], b.shape[1]), bool)
    total = np.zeros(on.shape, np.int16)
    for x, y in zip(a, b):
        on &= x[:, None] == y[None, :]
        if not on.any():
            break
        total += on
    return total


def near_pairs(words: list[str], key: np.ndarray, longest: np.ndarray, side: np.ndarray, part: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Pairs of places (two rows) of near words that share a key, each pair under one of its keys only.

    ``longest`` is the key's L; where ``across`` is set, only words of different parts are compared.
    """
    found = [np.empty((2, 0), np.int64)]
    width = int(longest.max(initial=1))
    cuts = range(0, len(words), PANEL)
    for lo in cuts:
        a = Tile(words[lo:lo + PANEL], width, 0xFFFFFFFE)
        p = slice(lo, lo + PANEL)
        for at in range(lo, len(words), PANEL):
            q = slice(at, at + PANEL)
            meets = (key[p][:, None] == key[q][None, :]) & ~(across[p][:, None] & (part[p][:, None] == part[q][None, :]))
            if at == lo:
                meets = np.triu(meets, 1)
            if not meets.any():
                continue
            b = Tile(words[q], width, 0xFFFFFFFF)
            prefix, suffix = agreement(a.left, b.left), agreement(a.right, b.right)
            long, la, lb = longest[p][:, None], a.length[:, None], b.length[None, :]
            near = meets & (prefix + suffix >= long - 1) & (np.maximum(la, lb) == long) & (np.minimum(la, lb) >= long - 1)
            near &= ~((la == lb) & (prefix == la))
            near &= (side[p] == 0)[:, None] | (prefix < long // 2)
            found.append(np.array(np.nonzero(near)) + [[lo], [at]])
    return np.concatenate(found, axis=1)


def nearest(words: list[str], n: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
    """A row for each word with a near one: how many, and the most frequent (ties: the smallest)."""
    a, b = np.concatenate([pairs, pairs[::-1]], axis=1)
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(np.array(words))] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.empty(0, int)
    count = np.diff(np.append(first, len(a)))
    return pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in a[first]], pa.string()), pa.array(count, pa.int64()),
         pa.array(n[b[first]], pa.int64()), pa.array([words[i] for i in b[first]], pa.string())],
        ["word", "n_near", "near_n", "near"])


def compare_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their group (len, side, half, i, j); small groups share a comparison, a large one has its own."""
    def compared(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.append(starts[1:], rows.num_rows)
        key = np.repeat(np.arange(len(starts)), ends - starts)
        col = {c: rows[c].to_numpy() for c in ("n", "len", "side", "part", "i", "j")}
        words, across = rows["word"].to_pylist(), col["i"] != col["j"]
        g = 0
        while g < len(starts):
            lo, to = int(starts[g]), g + 1
            while to < len(starts) and ends[to] - lo <= FEW:
                to += 1
            p = slice(lo, int(ends[to - 1]))
            if p.stop - p.start > 1:
                pairs = near_pairs(words[p], key[p], col["len"][p], col["side"][p], col["part"][p], across[p])
                if pairs.size:
                    yield nearest(words[p], col["n"][p], pairs)
            g = to

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        starts = group_starts(rows)
        cut = int(starts[-1]) if len(starts) else 0
        yield from compared(rows.slice(0, cut), starts[:-1])
        held = rows.slice(cut)
    if held is not None and held.num_rows:
        yield from compared(held, group_starts(held))


def group_starts(rows: pa.Table) -> np.ndarray:
    if not rows.num_rows:
        return np.empty(0, np.int64)
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for c in ("len", "side", "i", "j"):
        v = rows[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    v = np.array(rows["half"].to_pylist())
    new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """word, n_near, near_n, near: for words (word, n; distinct) that have near ones, how many and the most frequent."""
    ship(words.sparkSession)
    group = ["len", "side", "half", "i", "j"]
    rows = dealt(with_keys(words), tile).repartition(*group).sortWithinPartitions(*group)
    parts = rows.select("word", "n", *group, "part").mapInArrow(compare_groups, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")) \
        .select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """word, root: the end of each word's chain of forms (``forms``: word, form), by doubling; chains have at most
    ``longest`` links."""
    reach = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, longest))))):
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        reach = written(reach.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "roots")
    return reach


def variants(docs: DataFrame, id_col: str = "doc_id", ratio: int = RATIO) -> DataFrame:
    """word, n, form, root, n_near, form_n."""
    words = written(word_counts(docs, id_col), "words")
    near = written(near_words(words), "near-words")
    known = words.join(near, "word", "left")
    is_form = F.col("near_n") >= ratio * F.col("n")
    forms = written(known.where(is_form).select("word", F.col("near").alias("form")), "forms")
    most = words.agg(F.max("n")).first()[0] or 1
    longest = int(math.log(max(1, most / LEAST_COUNT), ratio)) + 1
    return known.join(roots(forms, longest), "word", "left").select(
        "word", F.when(is_form, F.col("near")).alias("form"), F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near_n")).alias("form_n"))
