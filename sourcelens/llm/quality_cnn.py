"""Quality classifier (method: byte-level convolutional network in numpy).

The bytes of the whole text are cut into overlapping chunks of ``2 * HALF``
bytes, each starting half a chunk after the one before.  In a chunk, learned
filters of ``WIDTH`` bytes (over learned byte embeddings, stride ``STRIDE``)
run through a rectifier; a filter's largest and mean activation are the
chunk's features.  A small hidden layer reads them, its units are max-pooled
and averaged over all chunks of the document, and a logistic unit combines
these into one probability.

Halves are pooled once and two neighbours make a chunk, so overlapping costs
no second convolution.  The network is learned on the driver with Adam, from a
bounded sample (about ``SAMPLE_DOCS`` labelled documents of at most
``SAMPLE_CHARS`` characters); every text is scored whole, whatever its length,
some chunks at a time.  Nothing is shuffled but the labels of the sample.

Defined cases: a null or empty text is one chunk of padding and has a score;
rows without a label, or with more than one value of it, aren't learned from;
without labels, or with one class only, every score is that class's share (0.5
without any); repeated rows get a row each; an empty table gives no rows;
other columns are ignored; a null id is in no fold and never learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, bounded, hash_sample, in_fold, text_bytes

HALF = 256
WIDTH = 8
STRIDE = 2
EMBEDDING = 8
FILTERS = 16
HIDDEN = 16
PAD = 256               # byte value of padding; its embedding stays zero
SAMPLE_DOCS = 4_000
SAMPLE_CHARS = 20_000
EPOCHS = 5              # passes over the sample, and more if they make fewer than
LEAST_STEPS = 400       # batches
BATCH = 32
RATE = 0.004
ACCEPT = 0.7
ROWS = 256              # halves convolved at a time

STEPS = HALF // STRIDE
SPAN = (STEPS - 1) * STRIDE + WIDTH


def halves(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of SPAN bytes, one for each half chunk of each text, and how many each text has (one at least).

    A row takes in the first bytes of the next half, so no filter position is lost between two.
    """
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-sizes // HALF))
    doc = np.repeat(np.arange(len(n)), n)
    within = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * HALF
    at = (offsets[:-1][doc] + within)[:, None] + np.arange(SPAN)[None]
    inside = at < offsets[1:][doc][:, None]
    out = np.full(at.shape, PAD, np.int16)
    out[inside] = data[at[inside]]
    return out, n


class Network:
    """Parameters, the forward pass and its gradients."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        f = lambda *shape: r.standard_normal(shape).astype(np.float32)
        self.p = {"embedding": f(257, EMBEDDING) * 0.5, "filters": f(WIDTH * EMBEDDING, FILTERS) / np.sqrt(WIDTH * EMBEDDING / 2),
                  "filter_bias": np.zeros(FILTERS, np.float32), "hidden": f(2 * FILTERS, HIDDEN) / np.sqrt(2 * FILTERS),
                  "hidden_bias": np.zeros(HIDDEN, np.float32), "out": f(2 * HIDDEN) * 0.1, "out_bias": np.zeros(1, np.float32)}
        self.p["embedding"][PAD] = 0
        self.constant: float | None = None

    def _windows(self, rows: np.ndarray) -> np.ndarray:
        e = self.p["embedding"][rows].reshape(len(rows), SPAN * EMBEDDING)
        view = np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBEDDING, axis=1)[:, ::STRIDE * EMBEDDING]
        return view.reshape(-1, WIDTH * EMBEDDING)

    def convolve(self, rows: np.ndarray) -> np.ndarray:
        """Activations: rows x positions x filters."""
        y = self._windows(rows) @ self.p["filters"]
        y += self.p["filter_bias"]
        np.maximum(y, 0, out=y)
        return y.reshape(len(rows), STEPS, FILTERS)

    def pool(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest and mean activation of each filter in each half, some rows at a time."""
        top, mean = np.empty((len(rows), FILTERS), np.float32), np.empty((len(rows), FILTERS), np.float32)
        for lo in range(0, len(rows), ROWS):
            y = self.convolve(rows[lo:lo + ROWS])
            top[lo:lo + ROWS], mean[lo:lo + ROWS] = y.max(1), y.mean(1)
        return top, mean

    @staticmethod
    def chunk_partner(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the chunks of all texts: their first half, and their second (the first again in a one-half text)."""
        chunks = np.maximum(1, n - 1)
        first = np.repeat(np.cumsum(n) - n, chunks) + np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        return first, first + np.repeat(n > 1, chunks)

    def combine(self, top: np.ndarray, mean: np.ndarray, n: np.ndarray) -> dict:
        p = self.p
        a, b = self.chunk_partner(n)
        chunks = np.maximum(1, n - 1)
        starts = np.cumsum(chunks) - chunks
        x = np.hstack([np.maximum(top[a], top[b]), (mean[a] + mean[b]) / 2])
        h = np.tanh(x @ p["hidden"] + p["hidden_bias"])
        z = np.hstack([np.maximum.reduceat(h, starts), np.add.reduceat(h, starts) / chunks[:, None].astype(np.float32)])
        logit = z @ p["out"] + p["out_bias"][0]
        return {"a": a, "b": b, "chunks": chunks, "starts": starts, "x": x, "h": h, "z": z, "score": 1 / (1 + np.exp(-logit.astype(np.float64)))}

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        rows, n = halves(data, offsets)
        return self.combine(*self.pool(rows), n)["score"]

    def gradients(self, rows: np.ndarray, n: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        y = self.convolve(rows)
        arg = y.argmax(1)
        top = np.take_along_axis(y, arg[:, None], 1)[:, 0]
        c = self.combine(top, y.mean(1), n)
        d = ((c["score"] - labels) / len(labels)).astype(np.float32)
        g = {"out": c["z"].T @ d, "out_bias": d.sum(keepdims=True)}
        dz = d[:, None] * p["out"][None]
        doc = np.repeat(np.arange(len(n)), c["chunks"])
        dh = dz[doc, HIDDEN:] / c["chunks"][doc][:, None].astype(np.float32)
        best = c["h"] == c["z"][doc, :HIDDEN]
        dh += dz[doc, :HIDDEN] * best / np.add.reduceat(best, c["starts"], dtype=np.float32)[doc]
        dh *= 1 - c["h"] ** 2
        g["hidden"], g["hidden_bias"] = c["x"].T @ dh, dh.sum(0)
        dx = dh @ p["hidden"].T
        dtop, dmean = np.zeros_like(top), np.zeros_like(top)
        first = top[c["a"]] >= top[c["b"]]
        np.add.at(dtop, c["a"], dx[:, :FILTERS] * first)
        np.add.at(dtop, c["b"], dx[:, :FILTERS] * ~first)
        np.add.at(dmean, c["a"], dx[:, FILTERS:] / 2)
        np.add.at(dmean, c["b"], dx[:, FILTERS:] / 2)
        dy = np.repeat(dmean[:, None] / STEPS, STEPS, axis=1)
        np.put_along_axis(dy, arg[:, None], np.take_along_axis(dy, arg[:, None], 1) + dtop[:, None], 1)
        dy *= y > 0
        dy = dy.reshape(-1, FILTERS)
        g["filters"], g["filter_bias"] = self._windows(rows).T @ dy, dy.sum(0)
        dw = (dy @ p["filters"].T).reshape(len(rows), STEPS, WIDTH, EMBEDDING)
        de = np.zeros((len(rows), SPAN, EMBEDDING), np.float32)
        for k in range(WIDTH):
            de[:, k:k + (STEPS - 1) * STRIDE + 1:STRIDE] += dw[:, :, k]
        flat = rows.ravel()
        g["embedding"] = np.stack([np.bincount(flat, de[:, :, k].ravel(), 257) for k in range(EMBEDDING)], 1).astype(np.float32)
        g["embedding"][PAD] = 0
        return g


def learn(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 1, least_steps: int = LEAST_STEPS) -> Network:
    """Adam over shuffled batches of whole texts, with a falling rate."""
    net = Network(seed)
    if len(set(labels)) < 2:
        net.constant = float(labels[0]) if labels else 0.5
        return net
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    rows, n = halves(data, offsets)
    first = np.cumsum(n) - n
    y = np.array(labels, np.float64)
    net.p["out_bias"][:] = np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    rng, t = np.random.default_rng(seed), 0
    epochs = max(epochs, -(-least_steps // -(-len(y) // BATCH)))
    steps = epochs * -(-len(y) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            at = order[lo:lo + BATCH]
            g = net.gradients(rows[np.concatenate([np.arange(first[k], first[k] + n[k]) for k in at])], n[at], y[at])
            t += 1
            rate = RATE * (1 - t / (steps + 1))
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                net.p[k] -= (rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(s[k] / (1 - 0.99 ** t)) + 1e-7)).astype(np.float32)
    return net


def training_rows(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], list[int]]:
    """Texts and labels outside the held-out fold, about ``sample_docs`` of them."""
    known = (labels.where(F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id")) & F.col("quality").isin(0, 1))
             .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most"))
    chosen = known.where(hash_sample(F.col("doc_id"), sample_docs / max(1, known.count()))).select("doc_id", "quality")
    # the sample is bounded by its parameter, so it may go to every task
    rows = bounded(docs.where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(chosen), "doc_id")
                   .select("doc_id", "text", "quality"), 2 * sample_docs).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [r["quality"] for r in rows]


def with_quality(docs: DataFrame, labels: DataFrame, name: str = "found", keep: list[str] | None = None,
                 id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a struct of score and predicted."""
    examples = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    net = learn(*training_rows(examples, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), sample_docs))

    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            data, offsets = text_bytes(texts)
            parts = [net.score(data, offsets[lo:lo + 65]) for lo in range(0, len(texts), 64)]
            score = np.concatenate(parts or [np.zeros(0)])
            return [pa.array(score, pa.float64()), pa.array((score >= ACCEPT).astype(np.int32))]
        return run

    return annotate(docs, make, "score double, predicted int", name, keep)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), in_fold(F.col(id_col)).alias("held_out"), "text")
    found = with_quality(docs, labels, "found", ["doc_id", "held_out"], sample_docs=sample_docs)
    return found.select("doc_id", "held_out", "found.score", "found.predicted")
