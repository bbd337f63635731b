"""TF-IDF index as relational tables, batch cosine search and answers (H1–H7).

Index model (the public scikit-learn defaults the analysed tool relies on):
lower-case; tokens are runs of ≥ 2 letters/digits/underscores; stop words are
removed before n-grams; unigrams + bigrams; raw counts; vocabulary = the
``max_features`` terms with the highest corpus counts among terms with
``df <= max_df * N``; ``idf = ln((1 + N) / (1 + df)) + 1``; rows L2-normalised.

Plan shape:
  * the corpus is tokenised once, and its tokens are written as text; terms
    are counted from them where they stand, so tokenising never shuffles;
  * counts over the corpus are taken by 64-bit hashes of the terms, of which
    a task passes on only the most frequent and a bound for the others; then
    exactly for the few terms that can be in the vocabulary;
  * the vocabulary is at most ``max_features`` rows (a hard bound), so it is
    broadcast;
  * a document's postings are one row of numbers, shuffled and written once;
  * search broadcasts a block of questions after another to the documents,
    as plain numbers, so no question-document pair is ever a row and neither
    side is dealt out once for each block of the other.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import explode_rows, has_text, render
from ..session import cores_of, new_path, shuffles_freed, written
from ..functions.stopwords import ENGLISH_STOP_WORDS
from ..functions.rules import ANSWER_HEADER, ANSWER_PROMPT_TEMPLATE, NO_ANSWER_TEXT, UNICODE_WORD
from .rank import top_k

TOKEN_PATTERN = UNICODE_WORD + "{2,}"
MAX_FEATURES = 5000
MAX_DF = 0.95
# Bytes of question vectors (and of postings) that meet in one task; more of them make more blocks.
QUESTION_BLOCK_BYTES = 64 << 20
POSTING_BLOCK_BYTES = 96 << 20
ROW_BYTES = 24      # of a vector's term: two numbers and a weight
DENSE_BYTES = 64 << 20      # for the weights of terms that very many documents of a block have
PIECE_BYTES = 4 << 20       # of tokens counted at once: rows x words x words of them still count in 63 bits
HASHES_HELD = 4_000_000     # by a task that counts by hash; then it passes on the most frequent and begins anew
PASSED_ON = 10              # times max_features hashes


def terms(text: Column, stop_words: tuple[str, ...] | None = None) -> Column:
    """H1: unigrams then bigrams of the stop-word-filtered tokens of ``text``."""
    stop = ENGLISH_STOP_WORDS if stop_words is None else stop_words
    toks = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)
    kept = F.filter(toks, lambda t: ~t.isin(*stop)) if stop else toks
    return kept


def _with_bigrams(kept: Column) -> Column:
    """Unigrams followed by adjacent-pair bigrams; ``kept`` must be a column reference."""
    n = F.size(kept)
    bigrams = F.when(n >= 2, F.zip_with(F.slice(kept, 1, n - 1), F.slice(kept, 2, n - 1),
                                        lambda a, b: F.concat(a, F.lit(" "), b))) \
               .otherwise(F.array().cast("array<string>"))
    return F.concat(kept, bigrams)


def _run_starts(s: Column) -> Column:
    """1-based positions where a new value starts in the sorted array ``s``."""
    n = F.size(s)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(i == 1, F.lit(True))
                      .otherwise(F.element_at(s, i) != F.element_at(s, i - 1)))
    return F.when(n > 0, starts).otherwise(F.array().cast("array<int>"))


def _run_lengths(s: Column, starts: Column) -> Column:
    """Distinct terms with counts: ``array<struct<term, tf>>``.

    ``s`` (sorted terms) and ``starts`` must be column references: a lambda
    re-evaluates any non-column expression it mentions for every element.
    """
    n = F.size(s)
    return F.transform(starts, lambda st, j: F.struct(
        F.element_at(s, st).alias("term"),
        (F.coalesce(F.try_element_at(starts, j + 2), n + 1) - st).alias("tf")))


def token_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                stop_words: tuple[str, ...] | None = None) -> DataFrame:
    """Per document: kept tokens, bigrams and distinct terms (H1 summary)."""
    d = docs.select(F.col(id_col).alias("doc_id"), terms(F.col(text_col), stop_words).alias("kept"))
    return d.select("doc_id", F.size("kept").alias("tokens"),
                    F.greatest(F.size("kept") - 1, F.lit(0)).alias("bigrams"),
                    F.size(F.array_distinct(_with_bigrams(F.col("kept")))).alias("distinct_terms"))


def document_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   stop_words: tuple[str, ...] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(*keep, doc_id, t)``: the distinct terms of each row in order, with their counts (``array<struct<term, tf>>``).

    Staged projections keep every array a column reference before a lambda
    reads it (tokens → sorted terms → run starts → counts).
    """
    d = docs.select(*keep, F.col(id_col).alias("doc_id"), terms(F.col(text_col), stop_words).alias("kept"))
    # sort_array: array_sort calls an interpreted comparator for each pair
    d = d.select(*keep, "doc_id", F.sort_array(_with_bigrams(F.col("kept"))).alias("s"))
    d = d.select(*keep, "doc_id", "s", _run_starts(F.col("s")).alias("starts"))
    return d.select(*keep, "doc_id", _run_lengths(F.col("s"), F.col("starts")).alias("t"))


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                stop_words: tuple[str, ...] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(*keep, doc_id, term, tf)`` — counted inside each row, then exploded (no shuffle)."""
    return (explode_rows(document_terms(docs, id_col, text_col, stop_words, keep), "t", "t", *keep, "doc_id")
            .select(*keep, "doc_id", "t.term", F.col("t.tf").cast("int").alias("tf")))


def joined_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  stop_words: tuple[str, ...] | None = None) -> DataFrame:
    """``(doc_id, tokens)``: the kept tokens of each row in order, a space between two (no token has one)."""
    return docs.select(F.col(id_col).alias("doc_id"), F.array_join(terms(F.col(text_col), stop_words), " ").alias("tokens"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array]]:
    """Rows of at most ``PIECE_BYTES`` (or one row), with each token's row and number, and the words by number."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch["tokens"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < batch.num_rows:
            most = PIECE_BYTES + (ends[at - 1] if at else 0)
            n = max(1, int(np.searchsorted(ends, most, side="right")) - at)
            piece = batch.slice(at, n)
            at += n
            parts = pc.split_pattern(piece["tokens"], " ")
            row = pc.list_parent_indices(parts).to_numpy().astype(np.int64)
            each = pc.list_flatten(parts).dictionary_encode()
            code = each.indices.to_numpy().astype(np.int64)
            # a row without tokens splits into one empty text
            empty = pc.index(each.dictionary, "").as_py()
            if empty >= 0:
                row, code = row[code != empty], code[code != empty]
            if len(code):
                yield piece, row, code, each.dictionary


def _counted(row: np.ndarray, key: np.ndarray, n_keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key) in order, with how often each stands."""
    cell, n = np.unique(row * n_keys + key, return_counts=True)
    row, key = np.divmod(cell, n_keys)
    return row, key, n


def _summed(row: np.ndarray, code: np.ndarray, words: pa.Array, uni: np.ndarray, bi: np.ndarray) -> pa.RecordBatch:
    """``(term, df, total)`` of the tokens at ``uni`` and the bigrams that begin at ``bi`` (masks)."""
    d = len(words)
    row, key, tf = _counted(np.r_[row[uni], row[:-1][bi]], np.r_[code[uni], d + code[:-1][bi] * d + code[1:][bi]], d + d * d)
    order = np.argsort(key, kind="stable")
    key, tf = key[order], tf[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    total, df = np.add.reduceat(tf, first) if len(first) else first, np.diff(np.r_[first, len(key)])
    key = key[first]
    one, two = key[key < d], key[key >= d] - d
    text = pa.chunked_array([words.take(pa.array(one)), pc.binary_join_element_wise(words.take(pa.array(two // d)), words.take(pa.array(two % d)), " ")])
    return pa.record_batch([text.combine_chunks(), pa.array(df, pa.int64()), pa.array(total, pa.int64())], names=["term", "df", "total"])


def summed_terms(tokens: DataFrame, share: int = 0, shares: int = 1) -> DataFrame:
    """``(term, df, total)``: unigrams and bigrams of ``tokens`` with the rows that have them and their occurrences, summed
    for some rows at a time: a term comes more than once.  With ``shares`` only the terms of that share of the hashes."""
    def each(batches):
        for _, row, code, words in _pieces(batches):
            one, two = np.ones(len(code), bool), row[1:] == row[:-1]
            if shares > 1:
                h, h2 = _hashes(code, words)
                one, two = h % shares == share, two & (h2 % shares == share)
            yield _summed(row, code, words, one, two)
    return tokens.select("tokens").mapInArrow(each, "term string, df long, total long")


def _hashes(code: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each token and of each two tokens that follow one another."""
    h = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)[code]
    x = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ ((h[1:] << np.uint64(31)) | (h[1:] >> np.uint64(33)))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h.view(np.int64), (x ^ (x >> np.uint64(33))).view(np.int64)


def _frequent(pieces: Iterator[tuple[np.ndarray, np.ndarray]], passed_on: int, held: int) -> Iterator[pa.RecordBatch]:
    """Sums of pieces of hashes and counts: the ``passed_on`` greatest at most, and without a hash the greatest sum left out.

    More than ``held`` sums are passed on in between, so one hash can be left out several times: the rows without a hash
    add up to what the sum of all tasks can lack.
    """
    def passed(h, n):
        least = int(np.partition(n, len(n) - passed_on - 1)[len(n) - passed_on - 1]) if len(n) > passed_on else 0
        kept = n > least
        return pa.record_batch([pa.array([*h[kept].tolist(), None], pa.int64()), pa.array(np.r_[n[kept], max(0, least)], pa.int64())], names=["h", "total"])

    parts, n_parts = [], 0

    def summed():
        h, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return h[first], np.add.reduceat(n, first)

    for h, n in pieces:
        if len(h) == 0:
            continue
        parts.append((h, n))
        n_parts += len(h)
        if n_parts > held:
            parts = [summed()]
            n_parts = len(parts[0][0])
            if n_parts > held // 2:
                yield passed(*parts[0])
                parts, n_parts = [], 0
    if parts:
        yield passed(*summed())


class Candidates:
    """The hashes of terms that can be in a vocabulary, and how often a term with another hash can stand at most."""

    def __init__(self, sums: DataFrame, max_features: int):
        """``sums``: rows of ``(h, total)``, and without a hash what the sums can lack."""
        sums = written(sums.groupBy("h").agg(F.sum("total").alias("total")), "sums-by-hash")
        rows = sums.where("h IS NOT NULL").orderBy(F.col("total").desc(), F.col("h")).limit(2 * max_features).collect()
        lacking = sums.where("h IS NULL").agg(F.sum("total")).first()[0] or 0
        self.hashes = np.sort(np.array([r["h"] for r in rows], np.int64))
        self.outside = lacking + (rows[-1]["total"] if rows and len(rows) == 2 * max_features else 0)
        self.max_features = max_features

    def decide(self, vocab: DataFrame) -> bool:
        """Whether no term outside can belong to ``vocab``, taken from them: there are no others, or each of the
        ``max_features`` terms has more occurrences than any of the others."""
        if self.outside == 0:
            return True
        size, fewest = vocab.agg(F.count(F.lit(1)), F.min("total")).first()
        return size == self.max_features and (size == 0 or fewest > self.outside)


def frequent_candidates(tokens: DataFrame, max_features: int = MAX_FEATURES, held: int = HASHES_HELD) -> Candidates:
    """The candidates of written ``tokens``.  A task passes on the most frequent of its own hashes only, and a bound for
    the others."""
    def pieces(batches):
        for _, row, code, words in _pieces(batches):
            one, two = _hashes(code, words)
            yield np.unique(np.r_[one, two[row[1:] == row[:-1]]], return_counts=True)

    return Candidates(tokens.select("tokens").mapInArrow(lambda b: _frequent(pieces(b), PASSED_ON * max_features, held), "h long, total long"), max_features)


def stored_candidates(sums: DataFrame, max_features: int = MAX_FEATURES, held: int = HASHES_HELD) -> Candidates:
    """The same from stored rows of ``(term, df, total)``, by the hashes that ``of_candidates`` takes.  A total can be
    below zero; one that is left out only lowers a sum."""
    def pieces(batches):
        for batch in batches:
            yield batch["h"].to_numpy(), batch["total"].to_numpy()

    hashed = sums.select(F.xxhash64("term").alias("h"), "total")
    return Candidates(hashed.mapInArrow(lambda b: _frequent(pieces(b), PASSED_ON * max_features, held), "h long, total long"), max_features)


def candidate_sums(tokens: DataFrame, hashes: np.ndarray) -> DataFrame:
    """``summed_terms`` of the terms that have one of the (sorted) hashes."""
    def known(h):
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        return hashes[at] == h if len(hashes) else np.zeros(len(h), bool)

    def each(batches):
        for _, row, code, words in _pieces(batches):
            one, two = _hashes(code, words)
            yield _summed(row, code, words, known(one), known(two) & (row[1:] == row[:-1]))
    return tokens.select("tokens").mapInArrow(each, "term string, df long, total long")


def vocabulary_of(sums: DataFrame, n_docs: Column, max_features: int = MAX_FEATURES, max_df: float = MAX_DF) -> DataFrame:
    """H2 from rows of ``(term, df, total)`` that add up to each term's counts."""
    stats = sums.groupBy("term").agg(F.sum("df").cast("bigint").alias("df"), F.sum("total").cast("bigint").alias("total")).where("df > 0")
    kept = stats.where(F.col("df") <= F.lit(max_df) * n_docs)
    top = kept.orderBy(F.col("total").desc(), F.col("term")).limit(max_features)
    return top.select("term", "df", "total", _idf(n_docs).alias("idf"))


def vocabulary(tf: DataFrame, n_docs: Column, max_features: int = MAX_FEATURES,
               max_df: float = MAX_DF) -> DataFrame:
    """H2: ``(term, df, total, idf)`` of at most ``max_features`` terms."""
    return vocabulary_of(tf.select("term", F.lit(1).alias("df"), F.col("tf").alias("total")), n_docs, max_features, max_df)


def candidate_hashes(counts: DataFrame, n_docs: Column, max_features: int = MAX_FEATURES,
                     max_df: float = MAX_DF) -> DataFrame:
    """``(h, common, total)``: hashes of the terms that can be in the vocabulary, from rows of ``(term, df, total)``.

    Summed by hash, so 8 bytes a term are shuffled.  A sum by hash is never below the sum of a term, so a term outside
    has at most the least ``total`` inside.  At most ``2 * max_features`` rows, terms of too many documents first.
    """
    sums = counts.groupBy(F.xxhash64("term").alias("h")).agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    common = F.col("df") > F.lit(max_df) * n_docs
    return sums.select("h", common.alias("common"), "total") \
        .orderBy(F.col("common").desc(), F.col("total").desc(), F.col("h")).limit(2 * max_features)


def of_candidates(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """The rows whose ``term`` has one of the hashes (2 * max_features at most, so always broadcast)."""
    return rows.join(F.broadcast(hashes.select("h")), F.xxhash64("term") == F.col("h"), "left_semi")


def _idf(n_docs: Column) -> Column:
    return F.log((F.lit(1) + n_docs) / (F.lit(1) + F.col("df"))) + F.lit(1.0)


def group_vocabulary(tf: DataFrame, n_docs: DataFrame, group: str, max_features: int = MAX_FEATURES,
                     max_df: float = MAX_DF) -> DataFrame:
    """H2 per group (one knowledge base per repository): ``(group, term, df, total, idf)``.

    The per-group cut is a ``row_number() <= max_features`` window, which
    Spark limits per task before the shuffle; ``n_docs`` has one row per group.
    """
    stats = (tf.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("bigint").alias("total"))
             .join(n_docs, group))
    kept = stats.where(F.col("df") <= F.lit(max_df) * F.col("n_docs"))
    top = top_k(kept, [group], [F.col("total").desc(), F.col("term")], max_features)
    return top.select(group, "term", "df", "total", _idf(F.col("n_docs")).alias("idf"))


class Index:
    """The fitted index: ``vocab``, ``postings`` (normalised) and ``norms``.

    With ``group`` set (e.g. ``"repo"``) every statistic is per group and a
    question is only matched against documents of its own group.
    """

    def __init__(self, vocab: DataFrame, postings: DataFrame, norms: DataFrame, docs: DataFrame,
                 group: str | None = None, vectors: "Vectors | None" = None):
        self.vectors = vectors      # what the postings are read from, if they are stored by document
        self.vocab = vocab
        self.postings = postings
        self.norms = norms
        self.docs = docs
        self.group = group

    @property
    def keys(self) -> list[str]:
        return [self.group] if self.group else []

    def save(self, path: str) -> None:
        """The index as four Parquet tables."""
        self.vocab.write.mode("overwrite").parquet(os.path.join(path, "vocab"))
        self.postings.write.mode("overwrite").parquet(os.path.join(path, "postings"))
        self.norms.write.mode("overwrite").parquet(os.path.join(path, "norms"))
        self.docs.write.mode("overwrite").parquet(os.path.join(path, "kb_docs"))

    @classmethod
    def load(cls, spark, path: str, group: str | None = None) -> "Index":
        r = lambda n: spark.read.parquet(os.path.join(path, n))
        return cls(r("vocab"), r("postings"), r("norms"), r("kb_docs"), group)


def weighted_postings(tf: DataFrame, vocab_side: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The normalised postings of term counts under the vocabularies (term, idf) of groups, and the documents' norms."""
    w = tf.join(vocab_side, [*keys, "term"]).select(*keys, "doc_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys, "doc_id")))
    weighted = written(w.select(*keys, "doc_id", "term", "w", norm.alias("norm")), "postings")
    postings = weighted.select(*keys, "doc_id", "term", (F.col("w") / F.col("norm")).alias("weight"))
    norms = weighted.groupBy(*keys, "doc_id").agg(F.max("norm").alias("norm"))
    return postings, norms


class Vectors:
    """Documents under one vocabulary: ``table`` has a row for each, ``(doc_id, tn, tf, norm)``, with the numbers of its
    terms and their counts; ``numbers`` is ``(term, tn, idf)`` and ``idf`` the same by number."""

    def __init__(self, tokens: DataFrame, vocab: DataFrame, live=lambda rows: rows):
        """``tokens``: ``(doc_id, tokens)`` and more columns; ``live`` takes rows with all but the tokens and leaves those that count."""
        spark = tokens.sparkSession
        known = sorted((r["term"], r["idf"]) for r in vocab.select("term", "idf").collect())
        self.idf = np.array([x for _, x in known], np.float64)
        self.numbers = spark.createDataFrame([(t, i, x) for i, (t, x) in enumerate(known)], "term string, tn int, idf double")
        rows = _document_vectors(tokens, [t for t, _ in known], self.idf)
        # dealt by document before the rows of one are put together, mostly one
        each = live(rows.repartition("doc_id")).groupBy("doc_id").agg(
            F.flatten(F.collect_list("tn")).alias("tn"), F.flatten(F.collect_list("tf")).alias("tf"), F.sqrt(F.sum("sq")).alias("norm"))
        self.table = written(each, "document-vectors", "zstd")

    def postings(self) -> DataFrame:
        each = self.table.select("doc_id", "norm", F.inline(F.arrays_zip("tn", "tf")))
        return each.join(F.broadcast(self.numbers), "tn").select("doc_id", "term", (F.col("tf") * F.col("idf") / F.col("norm")).alias("weight"))

    def norms(self) -> DataFrame:
        return self.table.select("doc_id", "norm")


def _document_vectors(tokens: DataFrame, known: list[str], idf: np.ndarray) -> DataFrame:
    """The columns besides ``tokens`` and ``(tn, tf, sq)`` of the rows that have a known term: numbers and counts of
    theirs, and the sum of squares of their weights."""
    two = np.array([" " in t for t in known], bool)
    of_one, of_two = np.flatnonzero(~two), np.flatnonzero(two)
    single = pa.array([known[i] for i in of_one], pa.string())
    first, second = (pa.array([known[i].split(" ")[k] for i in of_two], pa.string()) for k in (0, 1))
    kept = [f for f in tokens.schema if f.name != "tokens"]
    names = [f.name for f in kept]

    def each(batches):
        for piece, row, code, words in _pieces(batches):
            d = len(words)
            tn = np.full(d, -1, np.int64)
            at = pc.fill_null(pc.index_in(words, single), -1).to_numpy(zero_copy_only=False)
            tn[at >= 0] = of_one[at[at >= 0]]
            one = tn[code]
            a, b = (pc.fill_null(pc.index_in(x, words), -1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (first, second))
            here = (a >= 0) & (b >= 0)
            pair, number = a[here] * d + b[here], of_two[here]
            order = np.argsort(pair)
            pair, number = pair[order], number[order]
            starts, ends = np.zeros(d, bool), np.zeros(d, bool)
            starts[a[here]], ends[b[here]] = True, True
            begin = np.flatnonzero((row[1:] == row[:-1]) & starts[code[:-1]] & ends[code[1:]])
            if len(begin):
                found = code[begin] * d + code[begin + 1]
                place = np.minimum(np.searchsorted(pair, found), len(pair) - 1)
                hit = pair[place] == found
                begin, both = begin[hit], number[place[hit]]
            else:
                both = begin
            r, t, tf = _counted(np.r_[row[one >= 0], row[begin]], np.r_[one[one >= 0], both], max(1, len(known)))
            if not len(r):
                continue
            cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            offsets = pa.array(np.r_[cut, len(r)], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (t, tf)]
            own = [piece[c].take(pa.array(r[cut])) for c in names]
            yield pa.record_batch([*own, *lists, pa.array(np.add.reduceat((tf * idf[t]) ** 2, cut))], names=[*names, "tn", "tf", "sq"])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "tn array<int>, tf array<int>, sq double"])
    return tokens.select(*names, "tokens").mapInArrow(each, schema)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                stop_words: tuple[str, ...] | None = None, max_features: int = MAX_FEATURES,
                max_df: float = MAX_DF, group: str | None = None) -> Index:
    """H3: fit the vocabulary and weight every document.

    ``docs`` keeps its other columns (source, type, …) for answers.  With
    ``group`` the index is one knowledge base per group value.
    """
    named = docs.withColumnRenamed(id_col, "doc_id") if id_col != "doc_id" else docs
    if group is None:
        # Written once to the shared folder, so the corpus is tokenised once.
        tokens = written(joined_tokens(docs, id_col, text_col, stop_words), "tokens", "zstd")
        n_docs = docs.select(F.count(F.lit(1)).cast("double")).scalar()
        candidates = frequent_candidates(tokens, max_features)
        vocab = written(vocabulary_of(candidate_sums(tokens, candidates.hashes), n_docs, max_features, max_df), "vocabulary")
        if not candidates.decide(vocab):
            vocab = written(vocabulary_of(summed_terms(tokens), n_docs, max_features, max_df), "vocabulary")
        # At most max_features rows, so broadcasting it is always safe.
        vectors = Vectors(tokens, vocab)
        return Index(vocab, vectors.postings(), vectors.norms(), named, vectors=vectors)
    keys = (group,)
    # Term counts feed both the document frequencies and the postings; both
    # tables are written once to the shared folder, so the corpus is tokenised
    # once and every search reads the postings as they are.
    tf = written(term_counts(docs, id_col, text_col, stop_words, keys), "term-counts")
    n_docs = docs.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("n_docs"))
    vocab = written(group_vocabulary(tf, n_docs, group, max_features, max_df), "vocabulary")
    # max_features rows per group: grows with the groups, so joined by key.
    postings, norms = weighted_postings(tf, vocab.select(group, "term", "idf"), list(keys))
    return Index(vocab, postings, norms, named, group)


def blocks_of(rows: int, block_bytes: int) -> int:
    """How many blocks so many rows of vectors make, so that one stays within ``block_bytes``."""
    return max(1, -(-rows * ROW_BYTES // block_bytes))


def _best_in_block(k: int, least: float | None):
    """The ``k`` best documents of one block for each question of one block, as a function of two Arrow tables.

    Postings stand by term; a question adds up those of its own terms in one array over the documents.  A document or
    term that occurs more than once in the input counts as often.
    """
    def best(postings: pa.Table, asked: pa.Table) -> pa.Table:
        out = pa.schema([("qn", pa.int64()), ("doc_id", postings.schema.field("doc_id").type), ("score", pa.float64())])
        if postings.num_rows == 0 or asked.num_rows == 0:
            return out.empty_table()
        # documents numbered in the order of their ids, which decides between equal scores
        ids = pc.dictionary_encode(postings["doc_id"].combine_chunks(), null_encoding="encode")
        in_order = pc.sort_indices(ids.dictionary, null_placement="at_start")
        docs, n = ids.dictionary.take(in_order), len(ids.dictionary)
        place = np.empty(n, np.int64)
        place[in_order.to_numpy()] = np.arange(n)
        terms, term = np.unique(postings["tn"].to_numpy(), return_inverse=True)
        cell = term * n + place[ids.indices.to_numpy()]
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        weight = np.add.reduceat(postings["weight"].to_numpy()[order], first)
        term, doc = np.divmod(cell[first], n)
        start = np.searchsorted(term, np.arange(len(terms) + 1))
        # a term that an eighth of the documents have is added faster as one row of all documents
        many = np.argsort(start[:-1] - start[1:], kind="stable")[:DENSE_BYTES // (8 * n)]
        dense = {}
        for t in many[(start[many + 1] - start[many]) * 8 >= n].tolist():
            dense[t] = np.zeros(n)
            dense[t][doc[start[t]:start[t + 1]]] = weight[start[t]:start[t + 1]]

        qn, tn, qw = (asked[c].to_numpy() for c in ("qn", "tn", "qw"))
        at = np.minimum(np.searchsorted(terms, tn), len(terms) - 1)
        known = terms[at] == tn
        qn, at, qw = qn[known], at[known], qw[known]
        order = np.argsort(qn, kind="stable")
        qn, at, qw = qn[order], at[order], qw[order]
        edges = np.flatnonzero(np.r_[True, qn[1:] != qn[:-1], True]) if len(qn) else np.zeros(1, np.int64)
        floor = 0.0 if least is None else max(0.0, least - 1e-6)
        total, found = np.zeros(n), []
        for a, b in zip(edges[:-1], edges[1:]):
            for t, w in zip(at[a:b].tolist(), qw[a:b].tolist()):
                if t in dense:
                    total += w * dense[t]
                else:
                    total[doc[start[t]:start[t + 1]]] += w * weight[start[t]:start[t + 1]]
            hit = np.flatnonzero(total > floor)
            score = np.round(total[hit], 9)
            if least is not None:
                hit, score = hit[score > least], score[score > least]
            if len(hit) > k:
                near = score >= np.partition(score, len(score) - k)[len(score) - k]
                hit, score = hit[near], score[near]
                top = np.lexsort((hit, -score))[:k]
                hit, score = hit[top], score[top]
            if len(hit):
                found.append((np.full(len(hit), qn[a]), hit, score))
            total.fill(0.0)
        if not found:
            return out.empty_table()
        q, hit, score = (np.concatenate(c) for c in zip(*found))
        return pa.table([pa.array(q, pa.int64()), docs.take(pa.array(hit)), pa.array(score)], schema=out)
    return best


def _best_of_documents(k: int, least: float | None, asked, idf: np.ndarray | None):
    """``_best_in_block`` over rows that are documents: ``asked`` is the broadcast block of questions.

    Documents are taken together up to ``POSTING_BLOCK_BYTES``; of all that a task gets a question keeps its ``k`` best.
    """
    best = _best_in_block(k, least)

    def block(rows: list[pa.RecordBatch]) -> pa.Table:
        t = pa.Table.from_batches(rows).combine_chunks()
        terms = t["tn"].combine_chunks()
        at = pc.list_parent_indices(terms)
        tn = pc.list_flatten(terms).to_numpy(zero_copy_only=False)
        if idf is None:
            weight = pc.list_flatten(t["weight"].combine_chunks()).to_numpy(zero_copy_only=False)
        else:
            weight = pc.list_flatten(t["tf"].combine_chunks()).to_numpy(zero_copy_only=False) * idf[tn] / t["norm"].to_numpy()[at.to_numpy()]
        return pa.table([t["doc_id"].combine_chunks().take(at), pa.array(tn, pa.int64()), pa.array(weight, pa.float64())], names=["doc_id", "tn", "weight"])

    def together(found: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(found).combine_chunks()
        t = t.take(pc.sort_indices(t, [("qn", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_start"))
        qn = t["qn"].to_numpy()
        first = np.flatnonzero(np.r_[True, qn[1:] != qn[:-1]]) if len(qn) else np.empty(0, np.int64)
        rank = np.arange(len(qn)) - np.repeat(first, np.diff(np.r_[first, len(qn)]))
        return t.filter(pa.array(rank < k))

    def each(batches):
        questions = pa.table(dict(zip(("qn", "tn", "qw"), asked.value)))
        rows, n, found = [], 0, None
        for batch in batches:
            at, size = 0, np.cumsum(pc.fill_null(pc.list_value_length(batch["tn"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < batch.num_rows:
                before = size[at - 1] if at else 0
                m = max(1, int(np.searchsorted(size, before + POSTING_BLOCK_BYTES // ROW_BYTES - n, side="right")) - at)
                rows.append(batch.slice(at, m))
                n += int(size[at + m - 1] - before)
                at += m
                if n >= POSTING_BLOCK_BYTES // ROW_BYTES or at < batch.num_rows:
                    part = best(block(rows), questions)
                    found, rows, n = part if found is None else together([found, part]), [], 0
        if rows:
            part = best(block(rows), questions)
            found = part if found is None else together([found, part])
        if found is not None:
            yield from found.to_batches()
    return each


def _by_document(index: Index, vocab: DataFrame, used: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """Rows that are documents, with the numbers of their terms, and counts and norm or (an index of long postings) weights."""
    if index.vectors is not None:
        return index.vectors.table, index.vectors.idf
    keys = index.keys
    postings = index.postings.join(used if keys else F.broadcast(used), [*keys, "term"]).select("doc_id", "tn", "weight")
    each = postings.repartition("doc_id").groupBy("doc_id").agg(F.collect_list("tn").alias("tn"), F.collect_list("weight").alias("weight"))
    return written(each, "document-weights", "zstd"), None


def query_vectors(index: Index, questions: DataFrame, id_col: str = "qid", text_col: str = "text",
                  stop_words: tuple[str, ...] | None = None) -> DataFrame:
    """H4: questions weighted with the fitted vocabulary (blank ones dropped).

    For a grouped index the questions carry the group column and are weighted
    with their own group's vocabulary.
    """
    keys = index.keys
    q = questions.where(has_text(F.col(text_col)))
    tf = term_counts(q, id_col, text_col, stop_words, tuple(keys)).withColumnRenamed("doc_id", "qid")
    vocab = index.vocab.select(*keys, "term", "idf")
    w = tf.join(vocab if keys else F.broadcast(vocab), [*keys, "term"]).select(
        *keys, "qid", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys, "qid")))
    return w.select(*keys, "qid", "term", (F.col("w") / norm).alias("qw"))


def search(index: Index, questions: DataFrame, k: int = 5, min_similarity: float = 0.1,
           id_col: str = "qid", text_col: str = "text", stop_words: tuple[str, ...] | None = None,
           block_bytes: int = QUESTION_BLOCK_BYTES) -> DataFrame:
    """H5: per question the ``k`` best documents by cosine, then ``score > min_similarity``.

    Scores, order and threshold use the score rounded to 9 places with
    ``doc_id`` as tie-break, so results don't depend on summation order.

    Blocks of questions are broadcast one after another, each to all documents: a question's scores are summed where
    the documents are, and at most ``k`` a question and task leave it, never the question-document pairs.  Blocks stay
    within a fixed size, however large the index or the batch, and tasks are as many as the cores need.
    """
    keys = index.keys
    qv = query_vectors(index, questions, id_col, text_col, stop_words)
    # questions and terms get numbers, so that only numbers are dealt out
    qv = written(qv, "question-vectors")
    numbers = written(qv.select(*keys, "qid").distinct().withColumn("qn", F.monotonically_increasing_id()), "question-numbers")
    if index.vectors is None:
        vocab = written(index.vocab.select(*keys, "term").withColumn("tn", F.monotonically_increasing_id()), "term-numbers")
    else:
        vocab = index.vectors.numbers.select("term", F.col("tn").cast("long").alias("tn"))
    asked = written(qv.join(numbers, [*keys, "qid"]).join(vocab if keys else F.broadcast(vocab), [*keys, "term"]).select("qn", "tn", "qw"), "questions")
    table, idf = _by_document(index, vocab, vocab.join(asked.select("tn").distinct(), "tn", "left_semi"))
    spark = table.sparkSession
    n_asked, tasks = blocks_of(asked.count(), block_bytes), 2 * cores_of(spark)
    ids = table.schema["doc_id"].dataType.simpleString()

    def ranked(block: int) -> tuple[DataFrame, object]:
        rows = asked.where(F.pmod("qn", F.lit(n_asked)) == block).toArrow()
        sent = spark.sparkContext.broadcast([rows[c].to_numpy() for c in ("qn", "tn", "qw")])
        # a score that isn't over the threshold ranks after all that are
        found = table.repartition(tasks, "doc_id").mapInArrow(_best_of_documents(k, min_similarity, sent, idf), f"qn long, doc_id {ids}, score double")
        return top_k(found, ["qn"], [F.desc("score"), F.col("doc_id")], k, rank_col="rank"), sent

    if n_asked == 1:
        hits = ranked(0)[0]
    else:
        path = new_path(spark, "ranked")
        for block in range(n_asked):
            some, sent = ranked(block)
            with shuffles_freed(spark):
                some.write.parquet(f"{path}/block={block}")
            sent.destroy()
        hits = spark.read.schema(some.schema).parquet(path)
    return hits.join(numbers, "qn").select(*keys, "qid", "doc_id", "rank", "score")


def _band(score: Column, hi: float, mid: float) -> Column:
    return F.when(score > hi, "high").when(score > mid, "medium").otherwise("low")


def _top_sources(index: Index, hits: DataFrame, n: int = 3, **texts: Column) -> DataFrame:
    """The top ``n`` hits with their documents' metadata and what ``texts`` takes from them (written first: Spark picks the
    join by their size, and the whole texts stay where they are)."""
    keys = index.keys
    meta = index.docs.select(*keys, "doc_id", "source", "type", *[c.alias(name) for name, c in texts.items()])
    top = written(hits.where(F.col("rank") <= n), "top-hits")
    return meta.join(top, [*keys, "doc_id"]).select(*keys, "qid", "rank", "doc_id", "score", "source", "type", *texts)


def _joined(part: Column, separator: str) -> Column:
    """Parts of a group in rank order (three at most)."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", part.alias("p"))))
    return F.array_join(F.transform(ordered, lambda s: s["p"]), separator)


def answers(index: Index, questions: DataFrame, id_col: str = "qid", text_col: str = "text", **kw) -> DataFrame:
    """H6: extractive answer per question from its top 3 sources.

    Questions without a hit get the fixed "not found" answer.  Each answer
    gathers at most three previews, so the per-question group is bounded.
    """
    keys = index.keys
    hits = search(index, questions, id_col=id_col, text_col=text_col, **kw)
    preview = F.when(F.length("text") > 300, F.concat(F.substring("text", 1, 300), F.lit("..."))) \
               .otherwise(F.col("text"))
    part = F.concat(F.lit("**From "), F.col("source"), F.lit("**: "), F.col("preview"))
    per_q = _top_sources(index, hits, preview=preview).groupBy(*keys, "qid").agg(
        _joined(part, "\n\n").alias("body"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"),
        F.count(F.lit(1)).alias("n_sources"))
    qs = questions.select(*keys, F.col(id_col).alias("qid")).distinct()
    out = qs.join(per_q, [*keys, "qid"], "left")
    return out.select(
        *keys, "qid",
        F.when(F.col("body").isNull(), F.lit(NO_ANSWER_TEXT))
         .otherwise(F.concat(F.lit(ANSWER_HEADER), F.col("body"))).alias("answer"),
        F.when(F.col("top_score").isNull(), F.lit("low")).otherwise(_band(F.col("top_score"), 0.4, 0.25))
         .alias("confidence"),
        F.coalesce("n_sources", F.lit(0)).alias("n_sources"))


def answer_sources(index: Index, questions: DataFrame, id_col: str = "qid", text_col: str = "text",
                   **kw) -> DataFrame:
    """H6 sources: ``(qid, rank, doc_id, source, type, confidence)`` for the top 3."""
    hits = search(index, questions, id_col=id_col, text_col=text_col, **kw)
    return _top_sources(index, hits).select(*index.keys, "qid", "rank", "doc_id", "source", "type",
                                            F.col("score").alias("confidence"))


def answer_context(index: Index, questions: DataFrame, id_col: str = "qid", text_col: str = "text",
                   project_context: str | DataFrame = "", **kw) -> DataFrame:
    """H7: the context block handed to a language model, and its confidence.

    ``project_context`` is one text, or for a grouped index a table of the group column and ``context``.
    """
    keys = index.keys
    hits = search(index, questions, id_col=id_col, text_col=text_col, **kw)
    part = F.concat(F.lit("Source: "), F.col("source"), F.lit(" ("), F.col("type"), F.lit(")\n"),
                    F.col("passage"), F.lit("..."))
    per_q = _top_sources(index, hits, passage=F.substring("text", 1, 800)).groupBy(*keys, "qid").agg(
        _joined(part, "\n\n---\n\n").alias("context"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"))
    if isinstance(project_context, DataFrame):
        about = project_context.select(*keys, F.col("context").alias("project_context"))
        per_q = per_q.join(about, keys, "left").withColumn("project_context", F.coalesce("project_context", F.lit("")))
    else:
        per_q = per_q.withColumn("project_context", F.lit(project_context))
    return per_q.select(*keys, "qid", "project_context", "context", _band(F.col("top_score"), 0.5, 0.3).alias("confidence"))


def answer_prompts(index: Index, questions: DataFrame, id_col: str = "qid", text_col: str = "text", **kw) -> DataFrame:
    """H7: the whole prompt of each question with a hit: project context, passages and the question itself."""
    keys = index.keys
    context = answer_context(index, questions, id_col, text_col, **kw)
    asked = questions.select(*keys, F.col(id_col).alias("qid"), F.col(text_col).alias("question"))
    return context.join(asked, [*keys, "qid"]).select(*keys, "qid", render(ANSWER_PROMPT_TEMPLATE, {
        "project_context": F.col("project_context"), "context": F.col("context"), "question": F.col("question")}).alias("prompt"),
        "confidence")
