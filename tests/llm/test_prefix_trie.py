"""Trie nodes against brute force over all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sourcelens.llm import prefix_trie as T


def brute(rows):
    """Nodes by prefix of (role, text) turns, as the contract states them."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sym = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0), sym, (role, text)))
    for turns in convs.values():
        turns.sort(key=lambda t: t[:2])
    whole = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = convs.get(c - c % 5, [])
        whole[c] = tuple(t[2] for t in base[:h] + turns[h:])
    members = defaultdict(set)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    nodes = {}
    for key, ids in members.items():
        below = [k for k in members if k[:len(key)] == key]
        nodes[key] = (
            min(ids), len(key), min(members[key[:-1]]) if key else None, len(ids),
            sum(len(k) == len(key) + 1 for k in below),
            sum(not any(len(x) == len(k) + 1 and x[:len(k)] == k for x in members) for k in below),
            sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k),
            hashlib.sha256(",".join(map(str, sorted(c for c in ids if len(whole[c]) == len(key)))).encode()).hexdigest())
    return sorted(nodes.values(), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                               "saved_tokens", "ends_sha256").collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string, path string, key long, n_convs int, pid int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(3)


def sample(seed, n=70):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        if r.random() < 0.1:
            continue
        for t in range(r.choice([1, 2, 3, 8, 8, 12])):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a", "é", "", None, "bb" * 40, f"only {c}"])))
    return rows


@pytest.mark.parametrize("partitions", ["1", "4", "31"])
def test_nodes_equal_brute_force(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for seed in range(2):
            rows = sample(seed)
            assert got(T.conversation_trie(table(spark, rows))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_copies_that_fill_several_ranges(spark):
    """Equal conversations, more than a range holds; one that ends where others go on; long ones."""
    rows = [(5 * c, t, "user", f"turn {t}") for c in range(60) for t in range(4)]
    rows += [(1000 + 5 * c, t, "user", f"turn {t}") for c in range(9) for t in range(3)]
    rows += [(2000 + 5 * c, t, "user", f"turn {t}") for c in range(3) for t in range(150)]
    assert got(T.conversation_trie(table(spark, rows))) == brute(rows)


def test_odd_tables(spark):
    rows = [(1, None, None, None), (1, None, "user", "first"), (1, 0, "user", "x"), (1, 0, "user", "x"), (None, 1, "user", "lost"),
            (2, 1, None, None), (7, 3, "a", "b:c"), (8, 3, "a:b", "c"), (10, 1, "user", "y" * 200_000), (-3, 0, "user", "minus")]
    want = [x for x in brute([r for r in rows if (r[0] or 0) >= 0])]
    assert got(T.conversation_trie(table(spark, [r for r in rows if (r[0] or 0) >= 0]))) == want
    root = T.conversation_trie(table(spark, rows)).where("depth = 0").collect()
    assert [(r.n_convs, r.conv_id) for r in root] == [(6, -3)]     # negative ids too; a row without id is in no conversation
    assert T.conversation_trie(table(spark, rows).limit(0)).count() == 0


def test_range_minimum_ends():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64):
        v = r.integers(0, 5, n)
        table = T.RangeMinimum(v)
        at, bound = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(6)))
        for i, b, lo, hi in zip(at, bound, table.left(at, bound), table.right(at, bound)):
            assert all(v[lo + 1:i + 1] >= b) and (lo == 0 or v[lo] < b)
            assert all(v[i + 1:hi + 1] >= b) and (hi == n - 1 or v[hi + 1] < b)
        lo, hi = np.minimum(at % n, bound % n), np.maximum(at % n, bound % n)
        assert table.least(lo, hi).tolist() == [min(v[a:b + 1]) for a, b in zip(lo, hi)]
