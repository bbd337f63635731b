"""Language ID (method: segmentation-marginalised unigrams).

The pieces are those of a fixed public vocabulary.  Each language has a
probability for each piece, and a word's probability is the sum over *all* its
segmentations into pieces, by the forward algorithm.  The probabilities are
learned from labelled texts by expectation-maximisation (forward-backward over
the same segmentations).  A text's words are independent, so its score in a
language is the sum of its words' log-probabilities; the posterior of the best
language is returned.

Words are runs of letters, lower-cased, with the vocabulary's word-start mark
before them.  New words of a batch are scored together: words of one length
walk the vocabulary's trie as one array, from each start position.  The sums
are scaled every few positions and the scale kept in logs, in scoring and in
learning, so no word is too long or too rare for them and every score is
finite; a piece that no language has seen has one probability in all of them,
so it decides nothing.  Word scores are kept in a bounded table.

Learning uses a bounded sample: about ``SAMPLE_DOCS`` labelled documents in
all, alike for each language, of at most ``SAMPLE_CHARS`` characters, and no
more than twice ``SAMPLE_DOCS`` rows however often an id repeats.  All words of
the sample count, and every text is scored whole.  Nothing is shuffled.

Defined cases: a null text and one without a letter are ``und`` with score 0;
so is every text if there is nothing to learn from; ties go to the first
language by name; repeated rows get a row each; an empty table gives no rows;
other columns are ignored; a null id is held in no fold and never learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, bounded, hash_sample, in_fold

UNKNOWN = "und"
SAMPLE_DOCS = 4_000
SAMPLE_CHARS = 20_000
ROUNDS = 4
SMOOTHING = 1e-3        # share of the probability that goes to all pieces alike, the same in each language
SCALED = 8              # positions after which sums are scaled anew
LONE = 512              # bytes; longer words are worked out one by one, by the same sums
MAX_WORDS = 300_000
START = b" "            # the word-start mark, in bytes

_WORD = re.compile(r"[^\W\d_]+")


def load_pieces(path: str) -> list[bytes]:
    """Letter pieces of the vocabulary as bytes, word-start mark as a space; every single byte is a piece."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes((b,)) for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        mark, letters = piece.startswith("▁"), piece.lstrip("▁")
        if letters and letters.isalpha() and letters == letters.lower() and piece.count("▁") <= 1:
            pieces.add((START if mark else b"") + letters.encode("utf-8"))
    return sorted(pieces)


class Trie:
    """The pieces as arrays: child[node, byte class], and the piece that ends in a node (or -1)."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.reach = max(map(len, pieces)) + 1      # positions that a step can touch
        used = sorted({b for p in pieces if len(p) > 1 for b in p})
        self.classes = np.zeros(256, np.int32)
        for k, b in enumerate(used):
            self.classes[b] = k + 1
        nodes: dict[tuple[int, int], int] = {}
        ends = [-1]
        for i, p in enumerate(pieces):
            if len(p) == 1:
                continue
            node = 0
            for b in p:
                nxt = nodes.get((node, int(self.classes[b])))
                if nxt is None:
                    nxt = nodes[node, int(self.classes[b])] = len(ends)
                    ends.append(-1)
                node = nxt
            ends[node] = i
        self.child = np.zeros((len(ends), len(used) + 1), np.int32)
        for (node, c), nxt in nodes.items():
            self.child[node, c] = nxt
        self.ends = np.array(ends, np.int32)
        self.single = np.array([pieces.index(bytes((b,))) for b in range(256)], np.int32)

    def edges(self, words: np.ndarray, i: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For words as rows of bytes: the pieces that start at position i, as (end, rows, pieces)."""
        m, n = words.shape
        rows = np.arange(m)
        node = self.child[0, self.classes[words[:, i]]]
        yield i + 1, rows, self.single[words[:, i]]
        on = node > 0
        rows, node, end = rows[on], node[on], i + 1
        while len(rows) and end < n:
            node = self.child[node, self.classes[words[rows, end]]]
            on = node > 0
            rows, node, end = rows[on], node[on], end + 1
            piece = self.ends[node]
            whole = piece >= 0
            if whole.any():
                yield end, rows[whole], piece[whole]


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of words of one length: their places in the list, and their bytes as rows."""
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for at in np.split(order, cuts):
        for part in np.array_split(at, max(1, len(at) // 4096)):
            if len(part):
                yield part, np.frombuffer(b"".join([words[k] for k in part]), np.uint8).reshape(len(part), -1)


class Model:
    """Languages and their piece probabilities (pieces x languages)."""

    def __init__(self, trie: Trie, languages: list[str], probability: np.ndarray):
        self.trie, self.languages = trie, languages
        self.probability = probability
        self.words: dict[str, int] = {}
        self.scores = np.zeros((1024, len(languages)))

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Log of the sum over all segmentations, for each word and language."""
        out = np.zeros((len(words), len(self.languages)))
        together = [k for k, w in enumerate(words) if len(w) <= LONE]
        for at, rows in by_length([words[k] for k in together]):
            out[np.array(together)[at]] = self._forward(rows)
        for k, w in enumerate(words):
            if len(w) > LONE:
                out[k] = self._long(w)
        return out

    def _forward(self, rows: np.ndarray) -> np.ndarray:
        """For words of one length: the positions in reach as a ring, scaled together."""
        (m, n), reach = rows.shape, self.trie.reach
        alpha, scale = np.zeros((m, reach, len(self.languages))), np.zeros((m, len(self.languages)))
        alpha[:, 0] = 1
        for i in range(n):
            here = alpha[:, i % reach].copy()
            alpha[:, i % reach] = 0
            for end, at, piece in self.trie.edges(rows, i):
                alpha[at, end % reach] += here[at] * self.probability[piece]
            if i % SCALED == SCALED - 1:
                top = alpha.max(axis=1)
                alpha /= top[:, None]
                scale += np.log(top)
        return scale + np.log(alpha[:, n % reach])

    def _long(self, word: bytes) -> np.ndarray:
        """The same sum for one long word: the positions in reach are scaled together, their scale kept in logs."""
        reach, trie = self.trie.reach, self.trie
        codes = trie.classes[np.frombuffer(word, np.uint8)].tolist()
        alpha = np.zeros((reach, len(self.languages)))
        alpha[0], scale = 1, np.zeros(len(self.languages))
        for i in range(len(word)):
            here = alpha[i % reach].copy()
            alpha[i % reach] = 0
            alpha[(i + 1) % reach] += here * self.probability[trie.single[word[i]]]
            node, end = trie.child[0, codes[i]], i + 1
            while node and end < len(word):
                node, end = trie.child[node, codes[end]], end + 1
                if node and trie.ends[node] >= 0:
                    alpha[end % reach] += here * self.probability[trie.ends[node]]
            if i % SCALED == SCALED - 1:
                top = alpha.max(axis=0)
                alpha /= top
                scale += np.log(top)
        return scale + np.log(alpha[len(word) % reach])

    def _ids(self, words: list[str]) -> list[int]:
        get = self.words.get
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        ids = [get(w, -1) for w in words]
        if -1 in ids:
            new = list(dict.fromkeys(w for w, i in zip(words, ids) if i < 0))
            base = len(self.words)
            while base + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[base:base + len(new)] = self.log_probabilities([START + w.encode("utf-8") for w in new])
            self.words.update(zip(new, range(base, base + len(new))))
            ids = [i if i >= 0 else self.words[w] for w, i in zip(words, ids)]
        return ids

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words, counts = [], []
        for t in texts:
            found = _WORD.findall(t.lower()) if t else []
            if not any(c.isalpha() for w in found for c in w):
                found = []
            counts.append(len(found))
            words += found
        best, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not words or not self.languages:
            return best, score
        counts = np.array(counts)
        full = np.flatnonzero(counts)
        ids = np.array(self._ids(words))
        total = np.add.reduceat(self.scores[ids], (np.cumsum(counts) - counts)[full], axis=0)
        top = total.argmax(axis=1)
        posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for k, at, p in zip(full.tolist(), top.tolist(), posterior.tolist()):
            best[k], score[k] = self.languages[at], p
        return best, score


def word_counts(texts: Iterable[str]) -> dict[bytes, int]:
    counts: dict[str, int] = {}
    for t in texts:
        for w in _WORD.findall(t.lower()):
            counts[w] = counts.get(w, 0) + 1
    return {START + w.encode("utf-8"): n for w, n in counts.items()}


def learn(trie: Trie, texts: dict[str, list[str]], rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> Model:
    """Piece probabilities of each language by expectation-maximisation over all segmentations."""
    languages = sorted(texts)
    pieces = len(trie.pieces)
    probability = np.full((pieces, len(languages)), 1 / pieces)
    for k, language in enumerate(languages):
        counts = word_counts(texts[language])
        words, weight = list(counts), np.array(list(counts.values()), float)
        groups = [(at, rows, [(i, list(trie.edges(rows, i))) for i in range(rows.shape[1])]) for at, rows in by_length(words)] if words else []
        p = probability[:, k]
        for _ in range(rounds):
            expected = np.zeros(pieces)
            for at, rows, edges in groups:
                m, n = rows.shape
                alpha, beta = np.zeros((m, n + 1)), np.zeros((m, n + 1))
                alpha[:, 0], beta[:, n] = 1, 1
                scales, scale = [], np.zeros(m)         # logs: alpha at position i is still to be multiplied by exp(scales[i])
                for i, out in edges:
                    scales.append(scale)
                    for end, r, piece in out:
                        alpha[r, end] += alpha[r, i] * p[piece]
                    if i % SCALED == SCALED - 1:
                        ahead = alpha[:, i + 1:i + 1 + trie.reach]
                        top = ahead.max(axis=1)
                        ahead /= top[:, None]
                        scale = scale + np.log(top)
                whole = np.log(alpha[:, n]) + scale
                scale = np.zeros(m)
                for i, out in reversed(edges):
                    share = weight[at] * alpha[:, i]
                    factor = scales[i] + scale - whole
                    for end, r, piece in out:
                        onward = p[piece] * beta[r, end]
                        beta[r, i] += onward
                        some = (share[r] > 0) & (onward > 0)
                        used = np.exp((factor[r] + np.log(share[r], where=some, out=np.zeros(len(r))))[some] + np.log(onward[some]))
                        expected += np.bincount(piece[some], used, pieces)
                    if i % SCALED == 0:
                        behind = beta[:, i:i + trie.reach]
                        top = behind.max(axis=1)
                        behind /= top[:, None]
                        scale = scale + np.log(top)
            p = (1 - smoothing) * expected / expected.sum() + smoothing / pieces if words else p
        probability[:, k] = p
    return Model(trie, languages, probability)


def training_texts(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """Texts by language from the rows outside the held-out fold, about ``sample_docs`` in all."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"))
                          & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    each = sample_docs / max(1, len(counts))
    chosen = F.lit(False)
    for language, n in counts.items():
        chosen = chosen | ((F.col("lang") == language) & hash_sample(F.col("doc_id"), each / n))
    texts: dict[str, list[str]] = {}
    for r in bounded(labelled.where(chosen).select("lang", "text"), 2 * sample_docs).collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    return texts


def with_language(docs: DataFrame, vocabulary: str, name: str = "found", keep: list[str] | None = None,
                  id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a struct of lang_pred and score; learned from its text, lang and id."""
    pieces = load_pieces(vocabulary)
    examples = docs.select(F.col(id_col).alias("doc_id"), "text", "lang")
    model = learn(Trie(pieces), training_texts(examples, sample_docs))
    # pieces x languages floats: bounded by the fixed vocabulary
    shared = docs.sparkSession.sparkContext.broadcast((pieces, model.languages, model.probability))

    def make():
        vocabulary, languages, probability = shared.value
        model = Model(Trie(vocabulary), languages, probability)

        def run(texts: pa.Array) -> list[pa.Array]:
            best, score = model.predict(texts.to_pylist())
            return [pa.array(best, pa.string()), pa.array(score, pa.float64())]
        return run

    return annotate(docs, make, "lang_pred string, score double", name, keep)


def identify(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), in_fold(F.col(id_col)).alias("held_out"), "text", "lang")
    found = with_language(docs, vocabulary, "found", ["doc_id", "held_out"], sample_docs=sample_docs)
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")
