"""Conversation prefix trie (method: sparse-table range minimum over sorted LCPs).

A conversation is its sequence of turns; here it is the sequence of 128-bit chain hashes of its turn prefixes, so equal
prefixes have equal hashes and one hash names one trie node.  Conversations are sorted by that sequence (then by id)
across the cluster, in ranges of a bounded number of turns.  In each range the lengths of the common prefixes of
neighbours (LCP) go into a sparse table of minima.  Every candidate prefix (conversation, depth) then finds the left and
right end of its members by two independent binary searches over that table, all candidates as one array, with no stack
and no order among them.  Members, subtree sums, leaves and smallest ids are differences of prefix sums and range
minima over that interval:

* leaves: positions whose next LCP is shorter than the conversation itself;
* saved bytes of a subtree: over its members but the first, the bytes of the turns shared with the member before, less
  those above the node.

Both are sums over members, so the parts of a node that lies in several ranges add up.  Each range knows the LCP with
its neighbours; only nodes that reach over a border (at most the shared depth, for each border) are grouped by hash.
Exact copies of a conversation may fill many ranges: the id is part of the sort key.

Rebuilding: conversation c is the first h turns of c - c % 5 and its own turns after its first h, h = crc32(c) % 9.

Defined cases: turns are ordered by turn (null first), then by the md5 of role and text; null role or text is empty;
rows without conv_id belong to no conversation; repeated rows are repeated turns; an empty table has no nodes, not even
a root; other columns are ignored.  Texts leave the scan only as 16 bytes and a length for each turn, so one
conversation is one row of 24 bytes a turn.  The ids of equal conversations are hashed as a stream, in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

KEY = 16                # bytes of a prefix hash
BLOCK_TURNS = 1 << 20   # turns of one sorted range, about
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

PART = ("key binary, parent_key binary, depth long, n_convs long, conv_id long, parent_conv_id long, n_children long, "
        "n_leaves long, saved_tokens long, ends_sha256 string, ends binary, shared boolean, parent_shared boolean, pid int")


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as (turn, sym, bytes): a hash of role and text, the bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    sym = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn"), sym.alias("sym"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """conv_id, syms, bytes: the first h turns of the group's first conversation, then the own turns after the first h."""
    own = sequences(conversations).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")) \
        .withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    heads = own.where(F.col("conv_id") == F.col("base")).select("base", F.slice("turns", 1, most - 1).alias("head"))
    none = F.expr("slice(turns, 1, 0)")
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")),
                     F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    return own.join(heads, "base", "left").select("conv_id", turns.alias("turns")) \
        .select("conv_id", F.col("turns.sym").alias("syms"), F.col("turns.bytes").alias("bytes"))


def with_paths(convs: DataFrame) -> DataFrame:
    """conv_id, path (the prefix hashes, 16 bytes a turn, so that byte order is the trie's order), sizes (8 bytes a turn)."""
    small_batches(convs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blake = hashlib.blake2b
        for batch in batches:
            paths, sizes = [], []
            for syms, lengths in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                key, path = b"", []
                for sym in syms:
                    key = blake(key + sym, digest_size=KEY).digest()
                    path.append(key)
                paths.append(b"".join(path))
                sizes.append(np.array(lengths, "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.binary()), pa.array(sizes, pa.binary())],
                                             ["conv_id", "path", "sizes"])

    return convs.select("conv_id", "syms", "bytes").mapInArrow(run, "conv_id long, path binary, sizes binary")


class RangeMinimum:
    """Sparse table of minima over windows of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of values[lo..hi], ends included."""
        k = np.frexp(hi - lo + 1)[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for level in np.unique(k).tolist():
            at = k == level
            table = self.levels[level]
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << level) + 1])
        return out

    def right(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The largest r for which values[at+1..r] are all at least the bound."""
        r = at.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            table = self.levels[level]
            fits = r + (1 << level) < len(self.levels[0])
            ok = fits & (table[np.where(fits, r + 1, 0)] >= bound)
            r[ok] += 1 << level
        return r

    def left(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest l for which values[l+1..at] are all at least the bound."""
        l = at.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            table = self.levels[level]
            fits = l - (1 << level) >= 0
            ok = fits & (table[np.where(fits, l - (1 << level) + 1, 0)] >= bound)
            l[ok] -= 1 << level
        return l


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths share."""
    n = min(len(a), len(b)) // KEY
    x, y = (np.frombuffer(p, f"V{KEY}", n) for p in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


def lcps(paths: list[bytes]) -> np.ndarray:
    """Shared turns of each path and the one before it (0 for the first)."""
    lengths = np.array([len(p) // KEY for p in paths])
    starts = np.cumsum(lengths) - lengths
    keys = np.frombuffer(b"".join(paths), f"V{KEY}")
    out = np.zeros(len(paths), np.int64)
    on = np.arange(1, len(paths))
    depth = 0
    while len(on):
        on = on[np.minimum(lengths[on], lengths[on - 1]) > depth]
        on = on[keys[starts[on] + depth] == keys[starts[on - 1] + depth]]
        depth += 1
        out[on] = depth
    return out


def block_nodes(pid: int, conv: np.ndarray, paths: list[bytes], sizes: list[bytes], before: bytes | None,
                after: bytes | None) -> pa.Table:
    """The trie nodes of one sorted range, or the parts of those that reach over its borders."""
    m = len(conv)
    length = np.array([len(p) // KEY for p in paths], np.int64)
    inner = lcps(paths)
    first = -1 if before is None else common_turns(before, paths[0])
    following = np.append(inner[1:], -1 if after is None else common_turns(paths[-1], after))
    table, ids = RangeMinimum(inner), RangeMinimum(conv)

    # candidates: each conversation's prefixes that the one before doesn't have
    least = np.append(0, inner[1:] + 1)
    count = length - least + 1
    base = np.cumsum(count) - count
    at = np.repeat(np.arange(m), count)
    depth = np.arange(len(at)) - base[at] + least[at]
    lo, hi = table.left(at, depth), table.right(at, depth)
    up = np.maximum(depth - 1, 0)
    parent_lo = table.left(at, up)
    parent = base[parent_lo] + up - least[parent_lo]

    # bytes of the first k turns of a conversation: at row offset + k
    flat = np.frombuffer(b"".join(sizes), "<i8")
    total = np.append(0, np.cumsum(flat))
    begin = np.cumsum(length) - length
    upto = lambda i, k: total[begin[i] + k] - total[begin[i]]
    shared = np.append(max(first, 0), inner[1:])
    saved_to = np.append(0, np.cumsum(upto(np.arange(m), np.minimum(shared, length))))
    leaf_to = np.append(0, np.cumsum(following < length))
    from_before = (lo == 0) & (first >= depth)          # the interval begins in an earlier range
    skip = lo + np.where(from_before, 0, 1)
    saved = saved_to[hi + 1] - saved_to[skip] - (hi + 1 - skip) * upto(lo, up)
    saved[depth == 0] = (saved_to[hi + 1] - saved_to[skip])[depth == 0]
    counted = (depth > 0) & ~from_before                # else counted as a child in an earlier range
    children = np.bincount(parent[counted], minlength=len(at))
    reaches = from_before | ((hi == m - 1) & (following[-1] >= depth))
    n_ends = np.where(depth == length[lo], 0, -1)
    smallest = ids.least(lo, hi)

    # members that end in the node: the copies of its first conversation
    here = np.flatnonzero(n_ends == 0)
    same = np.append(False, (inner[1:] == length[1:]) & (length[1:] == length[:-1]))
    run_end = np.append(np.flatnonzero(~same)[1:], m)
    end_of = run_end[np.cumsum(~same) - 1]
    ends: list[bytes | None] = [None] * len(at)
    sha: list[str | None] = [EMPTY_SHA] * len(at)
    names = [str(c).encode() for c in conv.tolist()]
    for k in here.tolist():
        joined = b",".join(names[lo[k]:end_of[lo[k]]])
        if reaches[k]:
            ends[k] = joined
        else:
            sha[k] = hashlib.sha256(joined).hexdigest()

    def name(i: int, d: int) -> bytes:
        return paths[i][(d - 1) * KEY:d * KEY] if d > 0 else b""

    keys = [name(i, d) for i, d in zip(lo.tolist(), depth.tolist())]
    parents = [name(i, d - 1) if d else None for i, d in zip(lo.tolist(), depth.tolist())]
    root = depth == 0
    known = ~root & ~reaches[parent]
    return pa.table({
        "key": pa.array(keys, pa.binary()), "parent_key": pa.array(parents, pa.binary()), "depth": pa.array(depth),
        "n_convs": pa.array(hi - lo + 1), "conv_id": pa.array(smallest),
        "parent_conv_id": pa.array(smallest[parent], mask=~known),
        "n_children": pa.array(children.astype(np.int64)), "n_leaves": pa.array(leaf_to[hi + 1] - leaf_to[lo]),
        "saved_tokens": pa.array(saved), "ends_sha256": pa.array(sha, pa.string()), "ends": pa.array(ends, pa.binary()),
        "shared": pa.array(reaches), "parent_shared": pa.array(~root & reaches[parent]),
        "pid": pa.array(np.full(len(at), pid, np.int32))})


def streamed_sha(segments: DataFrame) -> DataFrame:
    """key, ends_sha256: SHA-256 of the comma-joined segments of a key in order, hashed as they come."""
    ordered = segments.repartition("key").sortWithinPartitions("key", "pid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            keys, out = [], []
            for k, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != key:
                    if sha is not None:
                        keys.append(key)
                        out.append(sha.hexdigest())
                    key, sha = k, hashlib.sha256(ends)
                else:
                    sha.update(b"," + ends)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["key", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])

    return ordered.select("key", "pid", "ends").mapInArrow(run, "key binary, ends_sha256 string")


def trie(convs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Nodes of the prefix trie of ``convs`` (conv_id, syms array<binary>, bytes array<long>; ids are distinct).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = convs.sparkSession
    paths = written(with_paths(convs), "paths")
    turns = paths.agg(F.sum(F.length("path")).alias("n")).first()["n"] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // (KEY * block_turns)))
    ranges = written(paths.repartitionByRange(blocks, "path", "conv_id").withColumn("pid", F.spark_partition_id()), "ranges")
    # one row a range: the paths at its ends and those next to them
    order = Window.orderBy("pid")
    edges = ranges.groupBy("pid").agg(F.min("path").alias("lo"), F.max("path").alias("hi")) \
        .select("pid", F.lag("hi").over(order).alias("before"), F.lead("lo").over(order).alias("after"))

    def nodes(key: tuple, rows: pa.Table, edge: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in empty})
        rows = rows.sort_by([("path", "ascending"), ("conv_id", "ascending")])
        return block_nodes(rows["pid"][0].as_py(), rows["conv_id"].to_numpy(), rows["path"].to_pylist(),
                           rows["sizes"].to_pylist(), edge["before"][0].as_py(), edge["after"][0].as_py())

    long, b = pa.int64(), pa.binary()
    empty = pa.schema([("key", b), ("parent_key", b), ("depth", long), ("n_convs", long), ("conv_id", long),
                       ("parent_conv_id", long), ("n_children", long), ("n_leaves", long), ("saved_tokens", long),
                       ("ends_sha256", pa.string()), ("ends", b), ("shared", pa.bool_()), ("parent_shared", pa.bool_()),
                       ("pid", pa.int32())])
    parts = written(ranges.groupBy("pid").cogroup(edges.groupBy("pid")).applyInArrow(nodes, PART), "nodes")

    over = parts.where("shared")
    merged = over.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"))
    merged = written(merged.join(streamed_sha(over.where("ends is not null")), "key", "left")
                     .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA))), "shared-nodes")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parent = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return parts.where("not shared and not parent_shared").select(*columns) \
        .unionByName(parts.where("not shared and parent_shared").drop("parent_conv_id").join(parent, "parent_key", "left").select(*columns)) \
        .unionByName(merged.join(parent, "parent_key", "left").select(*columns))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    return trie(rebuilt(conversations))
