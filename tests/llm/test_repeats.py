"""Repeated strings against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sourcelens.llm import repeats as R
from sourcelens.llm.common import text_bytes


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    places = defaultdict(int)
    for t in texts:
        for k in range(len(t) - length + 1):
            places[t[k:k + length]] += 1
    out = []
    for (doc, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if places[t[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        n_spans = bytes(gone).count(b"\0\1") + (gone[:1] == b"\1")
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((doc, len(t), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def corpus(seed, n=150):
    """Passages that many share, copies, near copies, repeats in one text, periods, letters of several bytes."""
    r = random.Random(seed)
    letters = "abcdefgh ijklé日"
    text = lambda n: "".join(r.choice(letters) for _ in range(n))
    passages = [text(r.choice([38, 40, 41, 60, 150])) for _ in range(12)]
    rows = []
    for k in range(n):
        parts = [text(r.choice([0, 1, 5, 30, 200]))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passages), text(r.choice([0, 0, 1, 2, 90]))]
        if r.random() < 0.15:
            parts.append(r.choice(["x", "xy", "abcdefg"]) * r.randint(1, 60))
        rows.append((k, "".join(parts)))
        if r.random() < 0.2:
            rows.append((1000 + k, rows[-1][1]))
        if r.random() < 0.2:
            at = r.randrange(len(rows[-1][1]) + 1)
            rows.append((2000 + k, rows[-1][1][:at] + "Q" + rows[-1][1][at:]))
    return rows + [(None, None), (5000, ""), (5001, "short")]


@pytest.mark.parametrize("group_bytes", [1 << 21, 300])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, group_bytes):
    for name, value in (("BLOCK", 1000), ("SHARD_BYTES", 700), ("SET_BYTES", 3000)):
        monkeypatch.setattr(R, name, value)
    rows = corpus(group_bytes)
    want = brute(rows, 40)
    assert got(R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), length=40, group_bytes=group_bytes)) == want
    assert sum(0 < x[2] < x[1] for x in want) > 40 and any(x[3] > 1 for x in want)


def test_windows_of_a_set_however_it_is_cut_into_shards():
    r = random.Random(6)
    for _ in range(60):
        length = r.choice([10, 20, 40])
        base = bytes(r.choice(b"ab" if r.random() < 0.5 else b"abcdefgh") for _ in range(120))
        pieces = []
        for _ in range(r.randint(1, 9)):
            lo = r.randint(0, 60)
            pieces.append(base[lo:lo + r.randint(length, 100)] if r.random() < 0.7 else bytes(r.choice(b"abc") for _ in range(r.randint(length, 70))))
        pieces = [p for p in pieces if len(p) >= length]
        count = defaultdict(int)
        for p in pieces:
            for k in range(len(p) - length + 1):
                count[p[k:k + length]] += 1
        want = [[k for k in range(len(p) - length + 1) if count[p[k:k + length]] > 1] for p in pieces]
        for shard in (1, 90, 10_000):
            assert [x.tolist() for x in R.repeated_windows(pieces, length, shard)] == want


def test_merge_gives_the_order_and_common_prefixes_of_all_suffixes():
    """Against plainly sorted suffixes, symbol by symbol."""
    r = random.Random(2)
    for _ in range(30):
        step = 2
        pieces = [bytes(r.choice(b"ab") for _ in range(r.randint(10, 30))) for _ in range(5)]
        strings = R.Strings(pieces, step)
        symbol = R.ranked(strings)
        ends = np.cumsum(strings.sizes)
        shards, suffixes = [], []
        for lo, hi in ((0, int(ends[1])), (int(ends[1]), int(ends[-1]))):
            sa = R.transform(symbol[lo:hi], strings.mark[lo:hi], step)
            shards.append((np.where(strings.first[lo:hi][sa], 0, symbol[lo:hi][np.maximum(sa - step, 0)]), int(strings.mark[lo:hi].sum())))
            suffixes.append(sa + lo)
        order, border = R.merged(shards, 50)
        order = np.concatenate(suffixes)[order]
        mark_number = np.cumsum(strings.mark) - 1

        def suffix(p):
            out = []
            while not strings.mark[p]:
                out.append(int(symbol[p]) + 10_000)
                p += step
            return (*out, int(mark_number[p]))
        want = sorted(range(len(symbol)), key=suffix)
        assert order.tolist() == want
        for k in range(1, len(want)):
            a, b = suffix(want[k - 1]), suffix(want[k])
            assert border[k] == next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)


def test_stretches_cover_each_window_once():
    r = random.Random(1)
    texts = ["".join(r.choice("abcd") for _ in range(r.choice([0, 39, 40, 41, 300]))) for _ in range(30)] + ["z" * 500]
    data, offsets = text_bytes(pa.array(texts))
    row, start, n, anchor, several = R.stretches(data, offsets, 40)
    seen = sorted((a, k) for a, s, m in zip(row.tolist(), start.tolist(), n.tolist()) for k in range(s, s + m))
    assert seen == [(a, k) for a, t in enumerate(texts) for k in range(len(t) - 39)]
    assert several[row == 30].all() and not several[row < 30].all()


def test_odd_tables(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    want = brute([(i, t) for i, t in rows if (len(t or "") < 10_000)], 400)
    found = got(R.remove_repeats(odd_docs))
    assert [x for x in found if x[1] < 10_000] == want
    assert {x[0]: x[2] for x in found if x[1] > 10_000} == {7: 2000 * 84, 8: 50_000}
    assert R.remove_repeats(no_docs).count() == 0
