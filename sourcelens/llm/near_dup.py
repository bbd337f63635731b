"""Near-duplicate classes (method: Order MinHash, candidates verified by banded alignment).

A document is the sequence of its lower-cased words, and its k-mers are the
runs of ``K`` = 5 words.  Each k-mer is labelled with its occurrence number, so
repeats differ.  One Order MinHash element takes the ``PICK`` smallest
labelled k-mers under a hash function and hashes them *in text order*: equal
elements mean shared k-mers in the same order.  ``ROWS`` elements make a band.

Two documents are near duplicates if their k-mer sequences align with
``matches / (n + m - matches) >= 0.8``; the alignment is a longest common
subsequence inside the band of diagonals that this bound leaves, worked out
with one bit for each cell.

Plan.  Equal word sequences are collapsed first, by a fingerprint and map-side
minimum.  Rows that share a band key form a bucket, and any two members of a
bucket are candidates.  Every member is first compared with the bucket's
smallest and largest id, also under keys of 2, 3, 4 and 6 bands that follow
each other; that joins most groups at the cost of a few pairs a member.  In
buckets that still hold several classes (documents that share a long passage,
groups whose copies are like a middle one only), all members of different
classes then meet, in blocks of at most about ``2 CHUNK`` rows.  There a bound
that loses no pair goes first: where the k-mers' parity bitmaps differ in more
bits than two alike sequences can, the pair is not alike.  The rest is aligned.
This step is quadratic in such a bucket's members of like length: in bitmap
comparisons, and in rows by a ``CHUNK``-th of that.  Links become classes by alternating large-star
and small-star steps on id pairs, each step written to the shared folder.  Only
documents in a bucket of two or more have their texts shuffled, once.  What a hot
key is joined with is written first, so that the join stands alone above its
exchanges and Spark splits it.

Defined cases: documents of fewer than K words are duplicates only if all
their words are equal; a null text or one without words is a class of its own
for each id; rows with equal ids and texts get a row each with one class; a
null id comes back with a null class and equals nothing; an empty table gives
no rows; other columns are ignored; texts are read whole, whatever their
length.  Of an id with several texts each row has the class of its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, small_batches, text_bytes, text_slices, written

K = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 2
PICK = 2
DEPTHS = (2, 3, 4, 6)    # bands that stand together in the further keys
CHUNK = 1024             # members of a large bucket in one part; two parts meet in one block
MAP_BITS = 4             # bits of a parity bitmap for each k-mer, up to MAP_MOST in all
MAP_MOST = 1 << 17
SEED = 20_240_611

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _INVERSE = U(pow(int(_BASE), -1, 1 << 64))
# bytes that stand in a word: ASCII letters and digits, and all of a non-ASCII character
_IN_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of a 64-bit value."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of the hash base and of its inverse, as far as they have been needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 21)
            cls.up = np.multiply.accumulate(np.concatenate(([U(1)], np.full(size, _BASE))))
            cls.down = np.multiply.accumulate(np.concatenate(([U(1)], np.full(size, _INVERSE))))
        return cls.up[:n], cls.down[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and how many words each text has."""
    base = int(offsets[0])
    data = data[base:int(offsets[-1])]
    bounds = offsets - base
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = _IN_WORD[data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1]
    cuts = bounds[1:-1]
    before[cuts] = False                # a word ends where its text ends
    starts = np.flatnonzero(inside & ~before)
    after = np.ones(n, bool)
    after[:-1] = ~inside[1:n]
    after[cuts[(cuts > 0)] - 1] = True
    ends = np.flatnonzero(inside[:n] & after) + 1
    up, down = Powers.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, bounds))


def kmers(words: np.ndarray, counts: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside each text, and how many each text has."""
    n = np.maximum(counts - k + 1, 0)
    total = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for j in range(k):
        total += words[j:j + len(total)] * U(pow(int(_BASE), j + 1, 1 << 64))
    ends = np.cumsum(counts)
    inside = np.ones(len(total), bool)
    drop = (ends[:-1][:, None] - np.arange(1, k)[None]).ravel()
    inside[drop[(drop >= 0) & (drop < len(total))]] = False
    first = np.repeat(ends - counts, n)
    at = first + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return mix(total[at]) if len(at) else np.zeros(0, np.uint64), n


def labelled(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """k-mers told apart by their occurrence number inside their text."""
    if not len(hashes):
        return hashes
    doc = np.repeat(np.arange(len(n)).astype(np.uint64), n)
    key = hashes ^ mix(doc + U(SEED))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    run = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    if len(run) == len(key):
        return hashes
    nth = np.arange(len(key)) - np.repeat(run, np.diff(np.append(run, len(key))))
    out = hashes.copy()
    out[order] += mix(nth.astype(np.uint64)) * (nth > 0)
    return out


def sketches(kmer: np.ndarray, n: np.ndarray, elements: int = BANDS * ROWS, pick: int = PICK) -> np.ndarray:
    """Order MinHash elements, one row for each text that has a k-mer."""
    n = n[n > 0]
    starts = np.cumsum(n) - n
    seeds = mix(np.arange(1, 2 * elements + 1).astype(np.uint64) * _BASE + U(SEED))
    out = np.zeros((len(n), elements), np.uint64)
    for e in range(elements):
        value = (kmer ^ seeds[e]) * (seeds[elements + e] | U(1))
        value ^= value >> U(32)
        value[value == U(2**64 - 1)] -= U(1)
        taken = np.zeros((len(n), pick), np.int64)
        for p in range(pick):
            least = np.minimum.reduceat(value, starts)
            at = np.flatnonzero(value == np.repeat(least, n))
            at = at[np.searchsorted(at, starts)]        # the first one of each text
            taken[:, p] = at
            value[at] = U(2**64 - 1)                    # out of the next pick
        if pick > 1:
            short = n < pick
            taken[short] = starts[short][:, None] + np.minimum(np.arange(pick)[None], n[short][:, None] - 1)
            taken.sort(axis=1)
        h = np.zeros(len(n), np.uint64)
        for p in range(pick):
            h = mix(h + kmer[taken[:, p]] + U(p + 1))
        out[:, e] = h
    return out


def band_keys(elements: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key for each band; the band's number is part of it."""
    h = np.tile(mix(np.arange(1, bands + 1).astype(np.uint64)), (len(elements), 1))
    for r in range(rows):
        h = mix(h + elements[:, r::rows][:, :bands])
    return h.view(np.int64)


def fingerprints(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the whole word sequence of each text."""
    starts = np.cumsum(counts) - counts
    place = (np.arange(len(words)) - np.repeat(starts, counts)).astype(np.uint64)
    full = counts > 0
    out = []
    for salt in (1, 2):
        h = np.zeros(len(counts), np.uint64)
        if len(words):
            term = mix(words + U(salt)) * (mix(place * U(2 * salt + 1)) | U(1))
            h[full] = np.add.reduceat(term, starts[full])
        out.append(mix(h + U(salt)).view(np.int64))
    return out[0], out[1]


def sketch_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, f1, f2 (fingerprint), bands (null under K words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in text_slices(batch.column(1)):
                with np.errstate(over="ignore"):
                    words, counts = word_hashes(data, offsets[lo:hi + 1])
                    f1, f2 = fingerprints(words, counts)
                    hashes, n = kmers(words, counts)
                    keys = band_keys(sketches(labelled(hashes, n), n))
                sizes = np.where(n > 0, BANDS, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(counts, pa.int64()), pa.array(f1), pa.array(f2), lists],
                    ["doc_id", "n_words", "f1", "f2", "bands"])

    return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, f1 long, f2 long, bands array<long>")


def kmer_table(docs: DataFrame) -> DataFrame:
    """The fingerprint of each text and its k-mer sequence, 4 bytes each."""
    names = ["f1", "f2", "n_words", "kmers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for lo, hi in text_slices(batch.column(0)):
                with np.errstate(over="ignore"):
                    words, counts = word_hashes(data, offsets[lo:hi + 1])
                    f1, f2 = fingerprints(words, counts)
                    hashes, n = kmers(words, counts)
                raw = (hashes >> U(32)).astype("<u4").tobytes()
                ends = np.cumsum(n) * 4
                cut = pa.array([raw[e - 4 * k:e] for e, k in zip(ends.tolist(), n.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(f1), pa.array(f2), pa.array(counts, pa.int64()), cut], names)

    return docs.select(F.lower("text").alias("text")).mapInArrow(run, "f1 long, f2 long, n_words long, kmers binary")


def banded_matches(a: np.ndarray, b: np.ndarray, width: int) -> int:
    """Longest common subsequence over cells with |i - j| <= width, one bit a cell.

    Column by column, bit i of ``v`` is 0 where the best path gains at row i.  The window slides along with
    the band; rows that leave it are final and counted.
    """
    where: dict[int, list[int]] = {}
    for i, x in enumerate(a.tolist()):
        where.setdefault(x, []).append(i)
    n, low, high = len(a), 0, 0
    v, gained = 0, 0
    for j, x in enumerate(b.tolist()):
        top = min(n, j + width + 1)
        if top > high:                          # rows that come into the band
            v |= ((1 << (top - high)) - 1) << (high - low)
            high = top
        bottom = min(max(0, j - width), high)
        if bottom > low:                        # rows that leave it
            gone = bottom - low
            gained += gone - (v & ((1 << gone) - 1)).bit_count()
            v >>= gone
            low = bottom
        rows = where.get(x)
        if rows:
            m = 0
            for i in rows:
                if low <= i < high:
                    m |= 1 << (i - low)
            u = v & m
            if u:
                v = ((v + u) | (v - u)) & ((1 << (high - low)) - 1)
    return gained + (high - low) - v.bit_count()


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two k-mer sequences align with at least this share of matches."""
    n, m = len(a), len(b)
    if not n or not m:
        return False
    need = int(np.ceil((n + m) * similarity / (1 + similarity) - 1e-9))     # matches / (n + m - matches) >= similarity
    if min(n, m) < need:
        return False
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    front = int(differ[0]) if len(differ) else short
    a, b, short = a[front:], b[front:], short - front
    differ = np.flatnonzero(a[len(a) - short:][::-1] != b[len(b) - short:][::-1])
    back = int(differ[0]) if len(differ) else short
    a, b = a[:len(a) - back], b[:len(b) - back]
    need -= front + back
    if need <= 0:
        return True
    if min(len(a), len(b)) < need:
        return False
    # no more matches than equal k-mers, counted with repeats
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if np.minimum(ca[ia], cb[ib]).sum() < need:
        return False
    return banded_matches(a, b, len(a) + len(b) - 2 * need) >= need


def verified(pairs: DataFrame, kmer: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose k-mer sequences align."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), "<u4") for v in (x, y))
                keep.append(alike(x, y, similarity))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = (pairs.join(kmer.select(F.col("rep").alias("b"), F.col("kmers").alias("kb")), "b")
              .join(kmer.select(F.col("rep").alias("a"), F.col("kmers").alias("ka")), "a"))
    return joined.select("a", "b", "ka", "kb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id and the smallest id of its connected component, for ids that have a link."""
    spark = links.sparkSession
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # leaders are written first, so that the join on a hub stands alone and Spark can split it
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "leaders")
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "leaders")
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = written(small.where("u <> v").distinct(), "small-star")
        state = [e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first() for e in (edges, new)]
        edges = new
        if state[0] == state[1]:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("class")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("class")).distinct()) if state[0]["n"] else \
        spark.createDataFrame([], "id long, class long")


def _met(keyed: DataFrame) -> DataFrame:
    """Members of the buckets of two or more, with their bucket's smallest and largest id as leaders."""
    leader = lambda pick, by: F.struct(pick("rep").alias("rep"), by("n", "rep").alias("n"))
    leaders = written(keyed.groupBy("key").agg(F.array(leader(F.min, F.min_by), leader(F.max, F.max_by)).alias("leaders"), F.count(F.lit(1)).alias("c"))
                      .where("c > 1").drop("c"), "bucket-leaders")
    return keyed.join(leaders, "key").select("key", "rep", "n", "band", "leaders")


def parity_map(kmer: np.ndarray) -> np.ndarray:
    """For each hash value modulo a power of two, whether an odd number of labelled k-mers has it; as 64-bit words."""
    size = min(MAP_MOST, 1 << max(6, (MAP_BITS * len(kmer) - 1).bit_length()))
    with np.errstate(over="ignore"):
        told_apart = labelled(kmer.astype(np.uint64), np.array([len(kmer)]))
    odd = np.bincount((told_apart & U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Parity maps (one a row) brought to fewer words."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, words), axis=1)


def may_be_alike(n: np.ndarray, classes: np.ndarray, side: np.ndarray, maps: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of rows of different classes that ``alike`` could accept; those of one side don't meet, but for side 0.

    Maps differ in at most as many bits as there are k-mers without a partner, n + m - 2 matches.
    """
    widths = np.array([len(x) for x in maps])
    rows = {w: np.flatnonzero(widths == w) for w in np.unique(widths).tolist()}
    stacks = {(w, w): np.stack([maps[i] for i in at]) for w, at in rows.items()}
    out = []
    for i in range(len(n)):
        for w, at in rows.items():
            j = at[np.searchsorted(at, i, side="right"):]
            first = len(at) - len(j)
            ok = (classes[j] != classes[i]) & ((side[j] == 0) | (side[i] == 0) | (side[j] != side[i])) \
                & (np.minimum(n[j], n[i]) >= similarity * np.maximum(n[j], n[i]) - 1e-9)
            if not ok.any():
                continue
            common = min(w, int(widths[i]))
            if (w, common) not in stacks:
                stacks[w, common] = folded(stacks[w, w], common)
            differ = np.bitwise_count(stacks[w, common][first:][ok] ^ folded(maps[i][None], common)).sum(axis=1, dtype=np.int64)
            j = j[ok]
            need = np.ceil((n[j] + n[i]) * similarity / (1 + similarity) - 1e-9)
            out.extend((i, k) for k in j[differ <= n[j] + n[i] - 2 * need].tolist())
    return out


def _unmet(members: DataFrame, classes: DataFrame, kmer: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) and their classes: members of a bucket that are in different classes and may be alike."""
    members = members.join(classes.withColumnRenamed("id", "rep"), "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    members = written(members, "members")
    several = written(members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("class").alias("lo"), F.max("class").alias("hi"))
                      .where("lo < hi"), "mixed-buckets")
    mixed = written(members.join(several.select("key", "c"), "key"), "mixed")
    small = mixed.where(F.col("c") <= CHUNK).select("rep", "n", "class", F.col("key").alias("block"), F.lit(0).alias("side"))
    # large buckets by length, where only equal and following steps can be alike, and each length in parts
    large = mixed.where(F.col("c") > CHUNK).withColumn("step", F.floor(F.log("n") / float(np.log(1.01 / similarity))).cast("int"))
    parts = (large.groupBy("key", "step").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("m"))
             .groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("step", "m"))).alias("parts")))
    of = lambda d: F.coalesce(F.try_element_at("parts", F.col("step") + d), F.lit(0))
    others = lambda d: F.when(of(d) > 0, F.transform(F.sequence(F.lit(0), of(d) - 1), lambda j: F.struct((F.col("step") + d).alias("step"), j.alias("part"))))         .otherwise(F.array().cast("array<struct<step:int,part:int>>"))
    large = (large.join(parts, "key").withColumn("me", F.struct("step", F.pmod(F.xxhash64("rep"), of(0)).cast("int").alias("part")))
             .withColumn("other", F.explode(F.concat(others(-1), others(0), others(1))))
             .select("rep", "n", "class", F.xxhash64("key", F.least("me", "other"), F.greatest("me", "other")).alias("block"),
                     F.when(F.col("me") == F.col("other"), 0).when(F.col("me") < F.col("other"), 1).otherwise(2).alias("side")))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [parity_map(np.frombuffer(x.as_buffer(), "<u4")).tobytes() for x in batch.column(1)], pa.binary())], ["rep", "map"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "a_class", "b_class")])

        def block(t: pa.RecordBatch) -> pa.RecordBatch:
            rep, n, cls, side = (t.column(c).to_numpy() for c in ("rep", "n", "class", "side"))
            pairs = np.array(may_be_alike(n, cls, side, [np.frombuffer(x.as_buffer(), "<u8") for x in t.column("map")], similarity), np.int64).reshape(-1, 2)
            i, j = np.where(rep[pairs[:, 0]] < rep[pairs[:, 1]], pairs.T, pairs.T[::-1])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (rep[i], rep[j], cls[i], cls[j])], schema=schema)

        rest: list[pa.RecordBatch] = []         # the last block, which may go on
        for batch in batches:
            rest.append(batch)
            key = batch.column("block").to_numpy()
            if not len(key) or rest[0].column("block")[0].as_py() == key[-1]:
                rest = [x for x in rest if x.num_rows]
                continue
            rows = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
            key = rows.column("block").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield block(rows.slice(lo, hi - lo))
            rest = [rows.slice(int(cuts[-1]))]
        if rest:
            yield block(pa.Table.from_batches(rest).combine_chunks().to_batches()[0])

    bitmaps = kmer.join(mixed.select("rep").distinct(), "rep", "left_semi").select("rep", "kmers").mapInArrow(maps, "rep long, map binary")
    return (small.unionByName(large).join(bitmaps, "rep").select("block", "side", "rep", "n", "class", "map")
            .repartition("block").sortWithinPartitions("block")
            .mapInArrow(meet, "a long, b long, a_class long, b_class long").where("a < b").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest id of its class): one row for each document."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    sketch = written(sketch_documents(docs), "sketches")
    full = sketch.where((F.col("n_words") > 0) & F.col("doc_id").isNotNull())
    # one row for each different word sequence, with a number of its own: one id may have several texts
    text = ["f1", "f2", "n_words"]
    reps = written(full.groupBy(*text).agg(F.min("doc_id").alias("first_id"), F.min_by("bands", "doc_id").alias("bands"))
                   .withColumn("rep", F.monotonically_increasing_id()), "representatives")
    bands = reps.where(F.size("bands") > 0).select("rep", (F.col("n_words") - K + 1).alias("n"), "bands")
    one = written(_met(bands.select("rep", "n", F.posexplode("bands").alias("band", "key"))), "buckets")
    # the same with keys of several bands, for the members of a bucket whose leaders aren't like them
    around = F.concat("bands", "bands")
    keys = F.array(*[F.xxhash64(F.slice(around, F.col("band") + 1, F.lit(depth)), F.lit(depth)) for depth in DEPTHS])
    deep = one.select("rep", "n", "band").join(bands.select("rep", "bands"), "rep").select("rep", "n", "band", F.explode(keys).alias("key"))
    # alignment needs at least as many k-mers in the shorter as similarity x those of the longer
    pairs = written(one.unionByName(_met(deep)).select("rep", "n", F.explode("leaders").alias("l"))
                    .where((F.col("rep") != F.col("l.rep")) & (F.least("n", "l.n") >= similarity * F.greatest("n", "l.n")))
                    .select(F.least("rep", "l.rep").alias("a"), F.greatest("rep", "l.rep").alias("b")).distinct(), "pairs")
    needed = written(reps.select(*text, "rep", F.col("first_id").alias("doc_id")).join(one.select("rep").distinct(), "rep"), "needed")
    kmer = kmer_table(docs.join(needed.select("doc_id").hint("merge"), "doc_id", "left_semi")).dropDuplicates(text)
    kmer = written(kmer.join(needed.select(*text, "rep"), text).select("rep", "kmers"), "kmers")
    first = written(components(verified(pairs, kmer, similarity)), "classes")
    # the buckets whose members aren't in one class yet
    unmet = written(_unmet(one.select("key", "rep", "n"), first, kmer, similarity), "unmet")
    links = verified(unmet, kmer, similarity).join(unmet, ["a", "b"]).select(F.col("a_class").alias("a"), F.col("b_class").alias("b"))
    joined = components(links).select(F.col("id").alias("class"), F.col("class").alias("to"))
    # a class of one document isn't in ``first``
    classes = written(first.join(joined, "class", "left").select("id", F.coalesce("to", "class").alias("class")).union(
        joined.select(F.col("class").alias("id"), F.col("to").alias("class")).join(first, "id", "left_anti")), "classes")
    # a class is named after its smallest document id
    whole = written(reps.join(classes, reps["rep"] == classes["id"], "left").select(*text, "first_id", F.coalesce("class", "rep").alias("class")), "by-text")
    named = written(whole.groupBy("class").agg(F.min("first_id").alias("class_id")), "class-names")
    by_text = whole.join(named, "class").select(*text, "class_id")
    return (sketch.join(by_text, text, "left")
            .select("doc_id", F.when(F.col("n_words") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
            .withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id"))))


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without all but the smallest id of each class; rows without an id stay.  Of rows that share an id one
    stays, that with the smallest hash of its text."""
    kept = classes.where("doc_id = class_id").select(F.col("doc_id").alias(id_col)).distinct()
    columns = [quoted(c) for c in docs.columns]
    one = docs.join(kept, id_col, "left_semi").groupBy(F.col(id_col)).agg(
        F.min_by(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(columns)]), F.xxhash64("text")).alias("row"))
    one = one.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
    return one.union(docs.where(F.col(id_col).isNull()).select(*columns))
