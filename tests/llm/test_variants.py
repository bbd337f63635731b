"""Near words and variant groups against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourcelens.llm import variants as V


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows):
    counts = Counter()
    upper = {c: c + 32 for c in range(65, 91)}
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    form, near = {}, {}
    for w in n:
        close = [v for v in n if one_edit(v, w)]
        near[w] = len(close)
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], n[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def corpus(seed):
    """Words with misspellings of misspellings, common beginnings and endings, letters beyond ASCII."""
    r = random.Random(seed)
    letters = "abcdeéüßÿÀ"
    words = ["".join(r.choice(letters) for _ in range(r.randint(5, 12))) for _ in range(40)]
    words += ["vorher" + "".join(r.choice("ab") for _ in range(r.randint(0, 5))) for _ in range(30)]
    words += ["".join(r.choice("ab") for _ in range(r.randint(0, 5))) + "gehend" for _ in range(30)]
    bag = []
    for w in words:
        many = r.choice([6, 40, 200, 1100])
        bag += [w] * many
        for _ in range(3):
            for k in (0, 1):
                at = r.randrange(len(w) + 1)
                w2 = r.choice([w[:at] + r.choice(letters) + w[at:], w[:at] + w[at + 1:], w[:at] + r.choice(letters) + w[at + 1:]])
                bag += [w2] * max(5, many // 6)
                w, many = (w2, many // 6) if k else (w, many)
    r.shuffle(bag)
    return [(k, " ".join(x.upper() if r.random() < 0.1 and x.isascii() else x for x in bag[k::90]) + ".x1") for k in range(90)]


@pytest.mark.parametrize("tile", [V.TILE, 5])
def test_variants_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(V.near_words, "__defaults__", (tile,))
    rows = corpus(tile)
    want = brute(rows)
    assert got(V.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == want
    assert any(r[2] != r[1] for r in want if r[1]) and any(r[4] > 3 for r in want)


def test_panels_of_any_size_find_the_same_pairs(monkeypatch):
    r = random.Random(5)
    words = sorted({"".join(r.choice("abc") for _ in range(r.choice([6, 7]))) for _ in range(300)})
    m = len(words)
    want = {(a, b) for a in words for b in words if a < b and one_edit(a, b) and 7 in (len(a), len(b))}
    args = np.zeros(m, int), np.full(m, 7), np.zeros(m, int), np.zeros(m, int), np.zeros(m, bool)
    for panel in (1, 7, 64, 1000):
        monkeypatch.setattr(V, "PANEL", panel)
        pairs = V.near_pairs(words, *args)
        assert {tuple(sorted((words[x], words[y]))) for x, y in pairs.T} == want and pairs.shape[1] == len(want)


def test_prefix_and_suffix_that_overlap_in_repeats(spark):
    rows = [(w, n) for n, w in enumerate(["aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "ababababab", "ababab", "abababa"], 5)]
    found = {r.word: r.n_near for r in V.near_words(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert found == {w: sum(one_edit(w, v) for v, _ in rows) for w, _ in rows if any(one_edit(w, v) for v, _ in rows)}


def test_odd_tables(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert got(V.variants(odd_docs)) == brute(rows)
    assert V.variants(no_docs).count() == 0


def test_chains_of_forms_end_at_their_root(spark):
    links = [(f"w{k}", f"w{k + 1}") for k in range(11)]
    found = {r.word: r.root for r in V.roots(spark.createDataFrame(links, "word string, form string"), 11).collect()}
    assert found == {f"w{k}": "w11" for k in range(11)}


def test_a_common_beginning_is_dealt_into_bounded_pairs(spark):
    words = spark.range(600).select(F.concat(F.lit("gemein"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("word"), F.lit(5).cast("long").alias("n"))
    sizes = V.dealt(V.with_keys(words), 100).groupBy("len", "side", "half", "i", "j").count().agg(F.max("count")).first()[0]
    assert sizes < 320
    assert {r.n_near for r in V.near_words(words, 100).collect()} == {r.n_near for r in V.near_words(words).collect()}
