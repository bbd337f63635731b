"""Alignment and classes against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sourcelens.llm import near_dup as N
from sourcelens.llm.common import text_bytes


def lcs(a, b):
    before = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(before[j] + 1 if x == y else max(before[j + 1], now[j]))
        before = now
    return before[-1]


def test_banded_alignment_equals_the_full_table():
    r = random.Random(3)
    for k in range(1500):
        a = [r.randint(0, r.choice([3, 20, 100])) for _ in range(r.randint(1, 40))]
        b = [x for x in a if r.random() > 0.1]
        for _ in range(r.randint(0, 4)):
            b.insert(r.randint(0, len(b)), r.randint(0, 20))
        if k % 5 == 0:
            r.shuffle(b)
        if b:
            best = lcs(a, b)
            x, y = np.array(a, "<u4"), np.array(b, "<u4")
            assert N.banded_matches(x, y, 100) == best
            assert N.alike(x, y) == (best / (len(a) + len(b) - best) >= 0.8 - 1e-12)


@np.errstate(over="ignore")
def test_equal_words_have_equal_hashes_wherever_they_stand():
    texts = ["one two, three", "", None, "three;one", "é one\nél", "x"]
    data, offsets = text_bytes(pa.array(texts))
    hashes, counts = N.word_hashes(data, offsets)
    words = "one two three three one é one él x".split()
    assert counts.tolist() == [3, 0, 0, 2, 3, 1]
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert (hashes[i] == hashes[j]) == (a == b)


@np.errstate(over="ignore")
def test_order_minhash_sees_order():
    r = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    first, second = words[:150], words[150:]
    texts = [" ".join(words), " ".join(words), " ".join(second + first), " ".join(r.sample(words, 300))]
    data, offsets = text_bytes(pa.array(texts))
    hashes, n = N.kmers(*N.word_hashes(data, offsets))
    e = N.sketches(N.labelled(hashes, n), n)
    assert (e[0] == e[1]).all()
    same = (e[0] == e[2]).mean()
    assert 0.2 < same < 0.8             # the same k-mers but for the seam, half of the pairs in the other order
    assert (e[0] == e[3]).mean() < 0.1


def classes_by_brute_force(rows):
    ids = sorted({i for i, _ in rows})
    text = dict(rows)
    data, offsets = text_bytes(pa.array([(text[i] or "").lower() for i in ids]))
    with np.errstate(over="ignore"):
        words, counts = N.word_hashes(data, offsets)
        hashes, n = N.kmers(words, counts)
    ends, word_ends = np.cumsum(n), np.cumsum(counts)
    seqs = [hashes[e - k:e].astype("<u4") for e, k in zip(ends, n)]
    whole = [tuple(words[e - k:e].tolist()) for e, k in zip(word_ends, counts)]
    best = {i: i for i in ids}

    def find(x):
        while best[x] != x:
            x = best[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            if whole[i] and (whole[i] == whole[j] or N.alike(seqs[i], seqs[j])):
                a, b = sorted((find(ids[i]), find(ids[j])))
                best[b] = a
    return {i: find(i) for i in ids}


def corpus():
    """Chains, hubs, a passage that many share, groups of copies and of near copies."""
    r = random.Random(9)
    vocabulary = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "en", "or")]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows, i = [], 0

    def add(w):
        nonlocal i
        rows.append((i, " ".join(w)))
        i += 1
    passage = words(60)
    for _ in range(60):
        add(words(r.randint(5, 90)) + passage + words(r.randint(0, 90)))
    for _ in range(8):
        w = words(r.randint(60, 200))
        for _ in range(r.randint(2, 12)):
            add(w)
            changed = list(w)
            for _ in range(r.randint(0, 2)):
                changed[r.randrange(len(w))] = "zzz"
            add(changed)
    w = words(150)
    for _ in range(12):                     # a chain: each is near the next, the ends aren't near
        w = w[3:] + words(3)
        add(w)
    for _ in range(60):
        add(words(r.randint(1, 120)))
    return rows


def test_classes_equal_brute_force(spark):
    rows = corpus()
    want = classes_by_brute_force(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()}
    assert got == want
    assert len(set(want.values())) < len(want) - 50


@pytest.mark.parametrize("part", [N.CHUNK, 16])
def test_copies_that_are_like_a_middle_one_only(spark, monkeypatch, part):
    """Hubs whose ids are neither smallest nor largest: their spokes are alike through them only."""
    monkeypatch.setattr(N, "CHUNK", part)
    r, rows = random.Random(11), []
    for first, spokes in ((0, 300), (1000, 40)):
        hub = [f"h{first}x{k}" for k in range(100)]
        for k in range(spokes):
            w, at = list(hub), r.randint(6, 80)
            for p in (at, r.randint(at + 6, 93)):
                w[p] = f"s{first}x{k}x{p}"
            rows.append((first + k + (k >= spokes // 2), " ".join(w)))
        rows.append((first + spokes // 2, " ".join(hub)))
    rows += [(5000 + k, f"only {k} here, and these words say {k} again, {k} times") for k in range(20)]
    want = classes_by_brute_force(rows)
    assert {want[i] for i, _ in rows if i < 1000} == {0} and {want[i] for i, _ in rows if 1000 <= i < 5000} == {1000}
    got = {x.doc_id: x.class_id for x in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == want


def test_parity_maps_lose_no_alike_pair():
    r = random.Random(4)
    seqs = []
    for _ in range(60):
        a = [r.getrandbits(32) for _ in range(r.choice([1, 5, 15, 17, 60, 130, 250, 400]))] * r.choice([1, 1, 2])
        for cut in (0, 0.05, 0.1, 0.2):
            seqs.append(np.array([x if r.random() > cut else r.getrandbits(32) for x in a] + a[:int(len(a) * r.choice([0, 0, 0.1]))], "<u4"))
    n, ids = np.array([len(x) for x in seqs]), np.arange(len(seqs))
    may = set(N.may_be_alike(n, ids, np.zeros(len(seqs), int), [N.parity_map(x) for x in seqs]))
    are = {(i, j) for j in range(len(seqs)) for i in range(j) if N.alike(seqs[i], seqs[j])}
    assert are and are <= may
    assert len(may) < 3 * len(are)


def test_hot_group_of_copies_and_of_near_copies(spark):
    r = random.Random(2)
    base = [f"w{r.randint(0, 500)}" for _ in range(80)]
    rows = [(k, " ".join(base)) for k in range(300)]
    rows += [(1000 + k, " ".join(base[:40] + [f"v{k}"] + base[41:])) for k in range(150)]
    rows += [(5000 + k, f"only {k} here") for k in range(50)]
    got = {x.doc_id: x.class_id for x in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i, _ in rows if i < 5000} == {0}
    assert all(got[i] == i for i, _ in rows if i >= 5000)


def test_odd_tables(odd_docs, no_docs):
    got = sorted((r.doc_id or -1, r.class_id or -1) for r in N.near_duplicates(odd_docs).collect())
    # the same words in capitals are equal; null, empty and wordless texts stand alone
    assert got == [(-1, -1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (9, 9)]
    kept = N.keep_one(odd_docs, N.near_duplicates(odd_docs))
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 7, 8, 9]
    assert N.near_duplicates(no_docs).count() == 0


def test_batches_of_fewer_words_than_a_run():
    for n in range(7):
        with np.errstate(over="ignore"):
            hashes, counts = N.kmers(np.arange(n, dtype=np.uint64), np.array([n]))
        assert len(hashes) == counts.sum() == max(0, n - 4)


def test_one_id_with_several_texts_loses_no_link(spark):
    r = random.Random(7)
    a, b = ([f"{x}{r.randint(0, 500)}" for _ in range(80)] for x in "ab")
    near = lambda w: w[:40] + ["other"] + w[41:]
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (4, near(near(b))), (9, ["alone"] * 3)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = sorted((x.doc_id, x.class_id) for x in N.near_duplicates(docs).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (9, 9)]
    kept = sorted((x.doc_id, x.text) for x in N.keep_one(docs, N.near_duplicates(docs)).collect())
    assert [i for i, _ in kept] == [1, 9]
    assert kept == sorted((x.doc_id, x.text) for x in N.keep_one(docs.repartition(3), N.near_duplicates(docs)).collect())


@pytest.mark.parametrize("n", [0, 1, 40])
def test_components_of_a_path(spark, n):
    links = spark.createDataFrame([(k, k + 1) for k in range(n)], "a long, b long")
    got = {r["id"]: r["class"] for r in N.components(links).collect()}
    assert got == ({k: 0 for k in range(n + 1)} if n else {})
