"""Suffix-array dedup (method: merging shard Burrows-Wheeler transforms by interleave refinement).

A byte is removed if it lies in a string of ``length`` bytes that also starts anywhere else.

Which bytes can repeat.  Each window of ``length`` bytes has an anchor: the smallest hash among its short grams.  Equal
windows have equal anchors, so windows of different anchors are never compared, and an anchor that occurs at one place
in the corpus is done.  A run of windows with one anchor is a *stretch*, kept with all of its bytes.  Equal stretches
collapse to one, with the fact that it repeats; it then stands for its copies.

Which bytes do repeat.  The stretches of one anchor meet in one task.  A stretch is read as strings over an alphabet of
``length // 5`` bytes, one string for each phase, each with an end mark of its own; symbols are 64-bit hashes, ranked.
Each shard of stretches has its Burrows-Wheeler transform built once.  The transforms are then merged: the interleave
(which shard does the next suffix come from) starts as shard after shard, and each pass deals it out by the symbols
before the suffixes, stably, so that after t passes it is the order by the first t symbols.  Suffixes are not sorted
again.  The pass in which a border first appears between two rows gives their common prefix; rows between which none has
appeared after five passes share ``length`` bytes and form the repeated intervals.

Bounds.  Stretches of an anchor that hold over ``GROUP_BYTES`` after equal ones have collapsed (a passage in very many
documents, each time with other text around it) aren't merged in one task: each of their windows is matched with all
others by a 128-bit hash, in a plain shuffle of 32 bytes a window.  Texts are shuffled once, as far as they hold a
repeated anchor once more; windows that can't repeat leave the scan as 16 bytes for some 180 bytes of text.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; repeated rows remove each other; an empty
table gives no rows; other columns are ignored; null ids get a row each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_bytes, text_slices, written

LENGTH = 400
SYMBOLS = 5                 # a window is so many symbols long
ANCHORS = 10                # and an anchor the tenth part of a window
BLOCK = 1 << 18             # windows hashed at a time
SHARD_BYTES = 1 << 18       # bytes of one shard's transform
SET_BYTES = 1 << 20         # small groups are merged together up to so many bytes
GROUP_BYTES = 1 << 21       # a larger group is matched by hashes of its windows
OUT_BYTES = 1 << 22
NOTHING = hashlib.sha256(b"").hexdigest()

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two."""
    z = u * _A
    z ^= v + _B
    z ^= z >> np.uint64(29)
    z *= _B
    z ^= z >> np.uint64(32)
    return z


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each position."""
    part, size = data.astype(np.uint64), 1
    out, done = None, 0
    while True:
        if k & size:
            n = len(data) - done - size + 1
            out = part if out is None else mix(out[:n], part[done:done + n])
            done += size
        if 2 * size > k:
            break
        if size < 8:
            part = part[:-size] | part[size:] << np.uint64(8 * size)
        else:
            part = mix(part[:-size], part[size:])
        size *= 2
    return out[:len(data) - k + 1]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:len(values) - (width - size)], values[width - size:]) if width > size else values


def stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in each of the texts: row, first window, number of windows, anchor, and whether
    the anchor stands in them at several places, so that they may repeat one another."""
    begin, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    gram = length // ANCHORS
    width = length - gram + 1
    rows, starts, counts, anchors, several = [], [], [], [], []
    for lo in range(0, size - length + 1, BLOCK):
        n = min(BLOCK, size - length + 1 - lo)
        hashes = grams(data[begin + lo:begin + lo + n + length - 1], gram)
        least = sliding_least(hashes, width)
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = least[1:] != least[:-1]
        for edge in (offsets[:-1] - begin - lo, offsets[1:] - length + 1 - begin - lo):
            new[edge[(edge >= 0) & (edge < n)]] = True
        at = np.flatnonzero(new)
        # places that are the anchor of a window around them; two of one value that a window or two neighbours see
        edge = np.full(width - 1, ~np.uint64(0))
        seen = np.flatnonzero(~sliding_least(np.concatenate([edge, ~least, edge]), width) == hashes)
        pair = np.flatnonzero((hashes[seen[1:]] == hashes[seen[:-1]]) & (np.diff(seen) <= width))
        sees = np.minimum(seen[pair], np.maximum(seen[pair + 1] - width + 1, 0))
        twice = np.zeros(len(at), bool)
        twice[np.searchsorted(at, sees[sees < n], side="right") - 1] = True
        place = at + begin + lo
        row = np.searchsorted(offsets, place, side="right") - 1
        whole = place + length <= offsets[row + 1]
        rows.append(row[whole])
        starts.append((place - offsets[row])[whole])
        counts.append(np.diff(np.append(at, n))[whole])
        anchors.append(least[at][whole])
        several.append(twice[whole])
    if not rows:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), np.empty(0, bool))
    return tuple(np.concatenate(x) for x in (rows, starts, counts, anchors, several))


def anchored(texts: DataFrame, length: int) -> DataFrame:
    """fp and the stretches of its text (arrays): anchors, starts, windows, several."""
    kinds = [("anchors", pa.int64()), ("starts", pa.int64()), ("windows", pa.int64()), ("several", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                row, start, count, anchor, several = stretches(*text_bytes(part.column(1)), length)
                at = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(v, t)) for v, (_, t) in
                         zip((anchor.view(np.int64), start, count, several), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["fp", *(name for name, _ in kinds)])

    return texts.select("fp", "text").mapInArrow(
        run, "fp binary, anchors array<long>, starts array<long>, windows array<long>, several array<boolean>")


def cut(texts: DataFrame, length: int) -> DataFrame:
    """The stretches of ``texts`` (fp, text, stretches array of (anchor, start, windows)) with their bytes and a hash of these."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "content", "bytes", "fp", "start", "windows"]
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        out, size = [[] for _ in names], 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for k, (fp, found) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2))):
                base = int(offsets[k])
                fields = found.values
                for anchor, start, n in zip(*(fields.field(f).to_pylist() for f in range(3))):
                    whole = data[base + start:base + start + n + length - 1].tobytes()
                    for column, value in zip(out, (anchor, hashlib.blake2b(whole, digest_size=16).digest(), whole, fp, start, n)):
                        column.append(value)
                    size += len(whole)
                    if size > OUT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
                        out, size = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return texts.mapInArrow(run, "anchor long, content binary, bytes binary, fp binary, start long, windows long")


class Strings:
    """Stretches as strings over an alphabet of ``step`` bytes: positions in one array, each stretch's grams and then one
    end mark for each phase; the symbol after position p stands at p + step."""

    def __init__(self, stretch: list[bytes], step: int):
        self.step = step
        data = np.frombuffer(b"".join(stretch), np.uint8)
        sizes = np.array([len(s) for s in stretch])
        ends = np.cumsum(sizes)
        # a gram from each byte but the last step - 1 of a stretch; in their place, and one more, the end marks
        self.sizes = sizes + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        n = int(self.sizes.sum())
        self.mark, self.first = np.zeros(n, bool), np.zeros(n, bool)
        for k in range(step):
            self.mark[self.starts + self.sizes - 1 - k] = True
            self.first[self.starts + k] = True
        hashed = grams(np.append(data, np.zeros(step, np.uint8)), step)
        place = np.arange(n) - np.repeat(np.arange(len(stretch)), self.sizes)
        self.hashes = hashed[place]
        self.marks = int(self.mark.sum())
        assert int(ends[-1]) + len(stretch) == n


def ranked(strings: Strings) -> np.ndarray:
    """Symbols as small numbers: 0 for every end mark, the others from 1."""
    symbol = np.zeros(len(strings.hashes), np.int64)
    symbol[~strings.mark] = np.unique(strings.hashes[~strings.mark], return_inverse=True)[1] + 1
    return symbol


def transform(symbol: np.ndarray, mark: np.ndarray, step: int) -> np.ndarray:
    """The suffix array of one shard's strings, end marks apart and first, by doubling."""
    n = len(symbol)
    marks = np.cumsum(mark) - 1
    rank = np.where(mark, marks, symbol + int(mark.sum()))
    reach = step
    while True:
        key = rank * np.int64(2 * n + int(rank.max()) + 2)
        if reach < n:
            key[:-reach] += np.where(mark[:-reach], 0, rank[reach:] + 1)
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        sorted_key = key[order]
        new[order] = np.cumsum(np.append(0, sorted_key[1:] != sorted_key[:-1]))
        rank, before = new, rank
        if rank[order[-1]] == n - 1:
            return order
        # past an end mark the next position is another stretch's, but a mark is unique and decides before
        reach *= 2


def merged(shards: list[tuple[np.ndarray, np.ndarray]], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' rows by their first ``passes`` symbols, and the pass in which each border appeared.

    Each shard: its transform (symbol before each suffix, 0 at the start of a string) and its number of end marks.
    Returns the rows (numbered through all shards) in merged order, and for each row the common prefix with the row
    before in symbols, ``passes`` meaning that or more.
    """
    sizes = np.array([len(t) for t, _ in shards])
    offset = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    before = np.concatenate([t for t, _ in shards])
    marks = int(sum(k for _, k in shards))
    shard_of_marks = np.repeat(np.arange(len(shards)), [k for _, k in shards])
    shard = np.repeat(np.arange(len(shards), dtype=np.int16), sizes)
    rows = np.arange(n)
    border = np.full(n, -1, np.int64)                   # the pass that drew a border before this row
    border[0] = 0
    block = np.zeros(n, np.int64)
    bits = max(1, int(n - 1).bit_length())
    for t in range(1, passes + 1):
        symbols = before[rows]
        inner = np.flatnonzero(symbols)
        key = np.sort(symbols[inner] << bits | inner)   # stable by symbol
        source = key & ((1 << bits) - 1)
        drawn = np.ones(n, bool)                        # every end mark differs
        same = (key[1:] >> bits) == (key[:-1] >> bits)
        drawn[marks + 1:] = ~same | (block[source[1:]] != block[source[:-1]])
        shard = np.concatenate([shard_of_marks.astype(np.int16), shard[source]])
        for s in range(len(shards)):
            at = np.flatnonzero(shard == s)
            rows[at] = offset[s] + np.arange(len(at))
        border[drawn & (border < 0)] = t - 1
        block = np.cumsum(drawn) - 1
        if drawn.all():
            break
    border[border < 0] = passes
    return rows, border


def repeated_windows(stretch: list[bytes], length: int, shard_bytes: int | None = None) -> list[np.ndarray]:
    """For each stretch the windows (by first byte) that stand at another place among the stretches too."""
    step = length // SYMBOLS
    strings = Strings(stretch, step)
    symbol = ranked(strings)
    ends = np.cumsum(strings.sizes)
    # shards of whole stretches
    part = (ends - 1) // (shard_bytes or SHARD_BYTES)
    cuts = np.append(0, ends[np.append(np.flatnonzero(np.diff(part)), len(ends) - 1)])
    shards, suffixes = [], []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        sa = transform(symbol[lo:hi], strings.mark[lo:hi], step)
        bwt = np.where(strings.first[lo:hi][sa], 0, symbol[lo:hi][np.maximum(sa - step, 0)])
        shards.append((bwt, int(strings.mark[lo:hi].sum())))
        suffixes.append(sa + lo)
    rows, border = merged(shards, SYMBOLS)
    with_previous = border >= SYMBOLS
    repeats = with_previous.copy()
    repeats[:-1] |= with_previous[1:]
    place = np.sort(np.concatenate(suffixes)[rows[repeats]])
    of = np.searchsorted(strings.starts, place, side="right") - 1
    at = np.searchsorted(of, np.arange(len(stretch) + 1))
    return [place[a:b] - s for a, b, s in zip(at[:-1], at[1:], strings.starts)]


def spans(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers as runs [from, to)."""
    gap = np.flatnonzero(np.diff(at) != 1)
    return at[np.append(0, gap + 1)], at[np.append(gap, len(at) - 1)] + 1


def compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, content, bytes, repeats) in order of anchor: their repeated windows as runs."""
    def found(rows: list[tuple]) -> pa.RecordBatch:
        out = [[], [], [], []]
        for (anchor, content, whole, repeats), at in zip(rows, repeated_windows([r[2] for r in rows], length)):
            lo, hi = ([0], [len(whole) - length + 1]) if repeats else (x.tolist() for x in spans(at)) if len(at) else ((), ())
            if lo:
                for column, value in zip(out, (anchor, content, lo, hi)):
                    column.append(value)
        types = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["anchor", "content", "lo", "hi"])

    whole, group, size, group_size = [], [], 0, 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if group and row[0] != group[-1][0]:
                if whole and size + group_size > SET_BYTES:
                    yield found(whole)
                    whole, size = [], 0
                whole, size, group, group_size = whole + group, size + group_size, [], 0
            group.append(row)
            group_size += len(row[2])
    for rows in ((whole, group) if size + group_size > SET_BYTES else (whole + group,)):
        if rows:
            yield found(rows)


def window_hashes(whole: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each window."""
    data, step = np.frombuffer(whole, np.uint8), length // SYMBOLS
    g = grams(data, step)
    n = len(whole) - length + 1
    x, y = g[:n], g[:n] ^ _B
    for k in range(1, SYMBOLS):
        x, y = mix(x, g[k * step:k * step + n]), mix(g[k * step:k * step + n], y)
    return x, y


def matched(large: DataFrame, length: int) -> DataFrame:
    """The same result for anchors whose stretches are too many for one task: windows with equal hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, content, whole in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = window_hashes(whole, length)
                for lo in range(0, len(x), 1 << 16):
                    n = min(1 << 16, len(x) - lo)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, anchor)), pa.array([content] * n, pa.binary()), pa.array(np.arange(lo, lo + n)),
                         pa.array(x[lo:lo + n].view(np.int64)), pa.array(y[lo:lo + n].view(np.int64))],
                        ["anchor", "content", "at", "x", "y"])

    windows = written(large.select("anchor", "content", "bytes").mapInArrow(run, "anchor long, content binary, at long, x long, y long"), "windows")
    place = F.xxhash64("content", "at")
    twice = windows.groupBy("x", "y").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("x", "y")
    runs = windows.join(twice, ["x", "y"]).groupBy("anchor", "content").agg(F.collect_list("at").alias("lo")) \
        .select("anchor", "content", "lo", F.transform("lo", lambda a: a + 1).alias("hi"))
    whole = large.where("repeats").select("anchor", "content", F.array(F.lit(0).cast("long")).alias("lo"),
                                          F.array((F.octet_length("bytes") - (length - 1)).cast("long")).alias("hi"))
    return runs.unionByName(whole)


def removed(texts: DataFrame, length: int) -> DataFrame:
    """``texts``: fp, text, found (array of start, lo, hi).  fp, n_removed, n_spans, kept_sha256."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            n_removed, n_spans, sha = [], [], []
            for k, found in enumerate(batch.column(2)):
                text = data[offsets[k]:offsets[k + 1]]
                change = np.zeros(len(text) + 1, np.int32)
                for f in found.as_py():
                    np.add.at(change, np.array(f["lo"]) + f["start"], 1)
                    np.add.at(change, np.array(f["hi"]) + f["start"] + length - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                n_removed.append(int(gone.sum()))
                n_spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]))
                sha.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())],
                                             ["fp", "n_removed", "n_spans", "kept_sha256"])

    return texts.select("fp", "text", "found").mapInArrow(run, "fp binary, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", length: int = LENGTH, group_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (``length``: a multiple of 10)."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")) \
        .withColumn("n_bytes", F.octet_length("text").cast("long")).withColumn("fp", F.unhex(F.sha2("text", 256)))
    texts = rows.where(F.col("n_bytes") >= length).select("fp", "text")

    # one row for each different text; it knows whether it has copies
    index = written(anchored(texts, length).groupBy("fp").agg(
        *[F.first(c).alias(c) for c in ("anchors", "starts", "windows", "several")], F.count("*").alias("copies")), "anchors")
    stretch = index.select("fp", F.explode(F.arrays_zip("anchors", "starts", "windows", "several")).alias("s")) \
        .select("fp", F.col("s.anchors").alias("anchor"), F.col("s.starts").alias("start"), F.col("s.windows").alias("windows"), "s.several")
    place = F.xxhash64("fp", "start")
    wanted = stretch.groupBy("anchor").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("several").alias("several")) \
        .where("a <> b or several").select("anchor")
    wanted = stretch.drop("several").join(wanted, "anchor").groupBy("fp") \
        .agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("stretches"))
    held = written(texts.groupBy("fp").agg(F.first("text").alias("text")).join(wanted, "fp").select("fp", "text", "stretches"), "held")

    pieces = written(cut(held, length), "stretches")
    own = pieces.groupBy("anchor", "content").agg(F.first("bytes").alias("bytes"), F.min(place).alias("a"), F.max(place).alias("b")) \
        .select("anchor", "content", "bytes", (F.col("a") != F.col("b")).alias("repeats"))
    large = written(pieces.select("anchor", "content", "windows").distinct().groupBy("anchor")
                    .agg(F.sum(F.col("windows") + (length - 1)).alias("size")).where(F.col("size") > (group_bytes or GROUP_BYTES))
                    .select("anchor"), "large-anchors")
    small = own.join(large, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    runs = small.mapInArrow(lambda batches: compare(batches, length), "anchor long, content binary, lo array<long>, hi array<long>")
    if not large.isEmpty():
        runs = runs.unionByName(matched(own.join(large, "anchor"), length))
    runs = written(runs, "repeats")

    found = pieces.select("anchor", "content", "fp", "start").join(runs, ["anchor", "content"]) \
        .groupBy("fp").agg(F.collect_list(F.struct("start", "lo", "hi")).alias("found"))
    judged = removed(held.select("fp", "text").join(found, "fp"), length)
    verdicts = index.select("fp", "copies").join(judged, "fp", "left").where("copies > 1 or n_removed is not null")
    copied = F.coalesce(F.col("copies") > 1, F.lit(False))
    return rows.select("doc_id", "n_bytes", "fp").join(verdicts, "fp", "left").select(
        "doc_id", "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(NOTHING)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("fp")))).alias("kept_sha256"))
