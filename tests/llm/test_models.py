"""Language ID and the quality network: exact sums, gradients, held-out accuracy, awkward tables."""

import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from sourcelens.llm import lang_id as L
from sourcelens.llm import quality_cnn as Q
from sourcelens.llm.common import text_bytes

VOCABULARY = P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    trie = L.Trie(L.load_pieces(VOCABULARY))
    return L.learn(trie, {"de": ["Der Fluss zog an der alten Mühle vorbei, und niemand sah ihm nach."] * 3, "en": ["The river ran past the old mill and nobody watched it go."]})


def test_forward_sums_all_segmentations(model):
    index = {p: i for i, p in enumerate(model.trie.pieces)}

    def total(word, k):
        return sum(model.probability[index[word[:j]], k] * (total(word[j:], k) if word[j:] else 1)
                   for j in range(1, min(model.trie.reach, len(word)) + 1) if word[:j] in index)
    words = [w.encode() for w in (" the", " river", " mühle", " a", " qxzzy", " strömung")]
    for word, row in zip(words, model.log_probabilities(words)):
        assert np.allclose(row, [np.log(total(word, k)) for k in range(2)])


def test_long_words_have_the_same_sum(model):
    word = (" " + "mühlenfluss" * 6).encode()
    index = {p: i for i, p in enumerate(model.trie.pieces)}
    alpha = np.zeros((len(word) + 1, 2))
    alpha[0] = 1
    for i in range(len(word)):
        for j in range(i + 1, min(len(word), i + model.trie.reach) + 1):
            if word[i:j] in index:
                alpha[j] += alpha[i] * model.probability[index[word[i:j]]]
    assert np.allclose(model._long(word), np.log(alpha[-1]))
    assert np.isfinite(model._long(b" " + b"x" * 20_000)).all()


def forward_in_logs(model, word):
    """The sum over all segmentations, position by position, with logarithms throughout."""
    index = {p: i for i, p in enumerate(model.trie.pieces)}
    alpha = np.full((len(word) + 1, len(model.languages)), -np.inf)
    alpha[0] = 0
    for j in range(1, len(word) + 1):
        terms = [alpha[i] + np.log(model.probability[index[word[i:j]]]) for i in range(max(0, j - model.trie.reach), j) if word[i:j] in index]
        alpha[j] = np.logaddexp.reduce(terms)
    return alpha[-1]


def test_rare_words_never_decide_a_document(spark):
    """With a model of the real size: words of scripts without pieces, of any length, have finite scores."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    trie = L.Trie(L.load_pieces(VOCABULARY))
    big = L.learn(trie, L.training_texts(docs))
    rare = ["ⴰⴱⴳⴷⴻⴼⴽⵀⵃⵄⵅⵇⵉⵊⵍ", "ꦲꦤꦕꦫꦏꦢꦠꦱꦮꦭꦥꦝꦗꦪꦚꦩꦒꦧꦛꦔ", "ሀለሐመሠረሰሸቀበተቸኀነኘአከኸወዐዘዠየደጀገጠጨጰጸፀፈፐ" * 30, "x" * 700, "Ж" * 24]
    for word in rare:
        raw = L.START + word.lower().encode()
        assert np.allclose(big.log_probabilities([raw])[0], forward_in_logs(big, raw))
    texts = [("the " * 50) + w for w in rare] + [("and the river ran past the old mill " * 6) + " ".join(rare)]
    best, score = big.predict(texts)
    assert best == ["en"] * len(texts) and min(score) > 0.99
    best, score = big.predict(rare)
    assert np.isfinite(score).all() and all(0 <= x <= 1 for x in score)


def test_words_of_any_length_are_learned_from():
    """Expected counts of a long word are those of the plain recursion in logs."""
    trie = L.Trie([bytes((b,)) for b in range(256)] + [b"ab", b"aba", b" a", b"abababab"])
    word = "ab" * 150 + "c"
    m = L.learn(trie, {"q": [word]}, 1, smoothing=1e-9)
    assert np.isfinite(m.probability).all() and np.isclose(m.probability.sum(), 1)
    p0 = 1 / len(trie.pieces)
    raw = (" " + word).encode()
    index = {p: i for i, p in enumerate(trie.pieces)}
    n = len(raw)
    a, b = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    a[0] = b[n] = 0
    edges = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + 8) + 1) if raw[i:j] in index]
    for i, j in sorted(edges, key=lambda e: e[1]):
        a[j] = np.logaddexp(a[j], a[i] + np.log(p0))
    for i, j in sorted(edges, key=lambda e: -e[0]):
        b[i] = np.logaddexp(b[i], b[j] + np.log(p0))
    expected = np.zeros(len(trie.pieces))
    for i, j in edges:
        expected[index[raw[i:j]]] += np.exp(a[i] + np.log(p0) + b[j] - a[n])
    assert np.allclose(m.probability[:, 0], expected / expected.sum())


def test_a_sample_is_bounded_where_one_id_repeats(spark):
    docs = spark.createDataFrame([(1, f"word {k} of it", "en") for k in range(900)] + [(k, f"text {k}", "en") for k in range(2, 200)],
                                 "doc_id long, text string, lang string")
    assert sum(map(len, L.training_texts(docs, 20).values())) <= 40
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 200)], "doc_id long, quality int")
    assert len(Q.training_rows(docs.select("doc_id", "text"), labels, 20)[0]) <= 40


def test_probabilities_and_likelihood(model):
    assert np.allclose(model.probability.sum(0), 1)
    counts = L.word_counts(["the river ran past the old mill"])
    likelihood = []
    for rounds in (1, 2, 4):
        m = L.learn(model.trie, {"en": ["the river ran past the old mill"]}, rounds, smoothing=1e-9)
        likelihood.append(float((m.log_probabilities(list(counts))[:, 0] * list(counts.values())).sum()))
    assert likelihood == sorted(likelihood)     # expectation-maximisation never lowers it


def test_language_accuracy_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = L.identify(docs, VOCABULARY).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_language_of_odd_tables(odd_docs, no_docs):
    rows = L.identify(odd_docs, VOCABULARY).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert len(rows) == odd_docs.count()
    assert got[3] == got[4] == got[5] == got[6] == ("und", 0.0)
    assert got[1][0] == got[2][0] == "en" and got[7][0] in ("de", "en") and got[9][0] != "und"
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert L.identify(no_docs, VOCABULARY).count() == 0
    unlabelled = odd_docs.withColumn("lang", odd_docs["lang"].substr(0, 0)).where("lang is null")
    assert {r.lang_pred for r in L.identify(unlabelled, VOCABULARY).collect()} <= {"und"}


def test_gradients():
    net = Q.Network()
    net.p["filter_bias"] += 0.05        # padding then stands off the rectifier's kink
    texts = ["plain words here " * 40, "###&&&" * 70, "short", "", "ÀÉ|x| " * 200]
    labels = np.array([1, 0, 1, 1, 0.0])
    rows, n = Q.halves(*text_bytes(pa.array(texts)))
    g = net.gradients(rows, n, labels)

    def loss():
        s = net.combine(*net.pool(rows), n)["score"]
        return -(labels * np.log(s) + (1 - labels) * np.log(1 - s)).mean()
    for name, value in net.p.items():
        for at in np.argsort(-np.abs(g[name]).ravel())[:3]:
            i, e = np.unravel_index(at, value.shape), 2e-3
            kept = value[i]
            value[i] = kept + e
            up = loss()
            value[i] = kept - e
            down = loss()
            value[i] = kept
            assert abs((up - down) / 2 / e - g[name][i]) < 0.05 * abs(g[name][i]) + 1e-3, name


def test_halves_cover_every_byte_and_overlap():
    text = bytes(range(1, 256)) * 9
    rows, n = Q.halves(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert n[0] == -(-len(text) // Q.HALF)
    for k, row in enumerate(rows):
        want = list(text[k * Q.HALF:k * Q.HALF + Q.SPAN])
        assert row.tolist() == want + [Q.PAD] * (Q.SPAN - len(want))
    a, b = Q.Network.chunk_partner(np.array([1, 3, 2]))
    assert list(zip(a, b)) == [(0, 0), (1, 2), (2, 3), (4, 5)]


def test_scores_do_not_depend_on_neighbours():
    net = Q.Network(3)
    texts = ["one text " * 100, "", "another", "x" * 5000]
    data, offsets = text_bytes(pa.array(texts))
    together = net.score(data, offsets)
    alone = [net.score(*text_bytes(pa.array([t])))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi").where("doc_id % 2 = 0")
    rows = Q.classify(labelled, labels, sample_docs=1500).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_quality_of_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (8, 0, 0), (8, 1, 0), (None, 1, 1), (2, None, 1)], "doc_id long, quality int, toxic int")
    rows = Q.classify(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert Q.classify(no_docs, labels).count() == 0
    none = Q.classify(odd_docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {0}
