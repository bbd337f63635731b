"""An index that grows by segments (A7, H3): documents are added and deleted without tokenising the others again.

Under one folder:

  tokens/segment=N      (doc_id, tokens) of the documents added by step N, from which their terms are counted
  docs/segment=N        the documents themselves, with their other columns
  stats/segment=N       (term, df, total, docs) that step N adds to the corpus statistics, below zero where it deletes
  tombstones/segment=N  (doc_id) that step N deletes from the segments before it
  manifest/version=V    the segments that are part of the index, written last

Statistics are additive, so the vocabulary comes from one row a term and step, never from the terms of all documents.
Weights depend on every document through the idf and are worked out on loading, from the stored tokens.  A step that fails leaves no new manifest and so no trace in the index.  ``merge`` rewrites the live documents as one
segment, once deleted ones or small steps make up too large a share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffles_freed, written
from .retrieval import (MAX_DF, MAX_FEATURES, Index, Vectors, joined_tokens, of_candidates, stored_candidates, summed_terms,
                        vocabulary_of)

MERGE_SEGMENTS = 16
# Characters of tokens whose terms are summed at once, and the shares that more of them are dealt to at most: each is
# shuffled and written before the next, and each counts all tokens again.
SHARE_CHARS = 256 << 20
SHARES = 4
MERGE_SHARE = 0.5       # of the stored documents that are deleted


class IndexStore:
    def __init__(self, spark: SparkSession, path: str, stop_words: tuple[str, ...] | None = None):
        self.spark, self.path, self.stop_words = spark, path.rstrip("/"), stop_words

    # -- storage ------------------------------------------------------------

    def _versions(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(root):
            return []
        whole = [s.getPath() for s in fs.listStatus(root) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in whole)

    def segments(self) -> list[int]:
        """The segments of the newest whole version."""
        versions = self._versions()
        if not versions:
            return []
        rows = self.spark.read.schema("segment int").json(f"{self.path}/manifest/version={versions[-1]}").collect()
        return sorted(r["segment"] for r in rows)

    def _commit(self, segments: list[int]) -> None:
        version = (self._versions() or [0])[-1] + 1
        self.spark.createDataFrame([(s,) for s in segments], "segment int").coalesce(1).write.mode("overwrite") \
            .json(f"{self.path}/manifest/version={version}")

    def _new_segment(self) -> int:
        return max(self.segments(), default=0) + 1

    def _write(self, df: DataFrame, table: str, segment: int) -> None:
        # a step that failed before may have left something under this number
        with shuffles_freed(self.spark):
            df.write.mode("overwrite").parquet(f"{self.path}/{table}/segment={segment}", compression="zstd")

    def _append(self, df: DataFrame, table: str, segment: int) -> None:
        with shuffles_freed(self.spark):
            df.write.mode("append").parquet(f"{self.path}/{table}/segment={segment}", compression="zstd")

    def _read(self, table: str, segments: list[int] | None = None) -> DataFrame:
        segments = self.segments() if segments is None else segments
        return self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/segment={s}" for s in segments])

    def _undeleted(self, rows: DataFrame) -> DataFrame:
        """Those of the rows (with doc_id and segment) whose document no later step deleted."""
        gone = self._read("tombstones").groupBy("doc_id").agg(F.max("segment").alias("deleted_by"))
        return rows.join(gone, "doc_id", "left").where(F.col("deleted_by").isNull() | (F.col("segment") >= F.col("deleted_by"))).drop("deleted_by")

    def _live(self, table: str) -> DataFrame:
        """Rows of documents that no later step deleted."""
        return self._undeleted(self._read(table))

    @staticmethod
    def _stats(signed: list[tuple[int, DataFrame]], share: int, shares: int) -> DataFrame:
        """The statistics of tokens that are added (1) or deleted (-1): a share of the terms, and with the first share the
        number of documents, which stands under no term."""
        rows = None
        for sign, tokens in signed:
            one = summed_terms(tokens, share, shares).select("term", *[(sign * F.col(c)).alias(c) for c in ("df", "total")], F.lit(0).cast("long").alias("docs"))
            if share == 0:
                one = one.unionByName(tokens.agg((sign * F.count(F.lit(1))).alias("docs")).select(
                    F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("df"), F.lit(0).cast("long").alias("total"), "docs"))
            rows = one if rows is None else rows.unionByName(one)
        # in order, terms take half the room
        return rows.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "total", "docs")]).sortWithinPartitions("term")

    # -- steps ----------------------------------------------------------------

    def apply(self, added: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """One step: deletes the ids of ``deleted`` (doc_id) and adds the documents of ``added`` (doc_id, text and more
        columns; ids are distinct).  An id that is added again replaces its document."""
        segment, segments = self._new_segment(), self.segments()
        gone = None
        for ids in (deleted, added):
            if ids is not None and segments:
                ids = ids.select("doc_id").distinct()
                gone = ids if gone is None else gone.union(ids).distinct()
        signed = []
        if gone is not None:
            self._write(self._live("docs").join(gone, "doc_id", "left_semi").select("doc_id"), "tombstones", segment)
            dead = self.spark.read.parquet(f"{self.path}/tombstones/segment={segment}")
            signed.append((-1, written(self._live("tokens").join(dead, "doc_id", "left_semi").select("doc_id", "tokens"), "deleted-tokens", "zstd")))
        else:
            self._write(self.spark.createDataFrame([], added.select("doc_id").schema), "tombstones", segment)
        if added is not None:
            self._write(joined_tokens(added, "doc_id", "text", self.stop_words), "tokens", segment)
            self._write(added, "docs", segment)
            signed.append((1, self.spark.read.parquet(f"{self.path}/tokens/segment={segment}")))
        else:
            self._write(self._read("tokens").drop("segment").limit(0), "tokens", segment)
            self._write(self._read("docs").drop("segment").limit(0), "docs", segment)
        chars = sum(tokens.agg(F.sum(F.length("tokens"))).first()[0] or 0 for _, tokens in signed)
        shares = min(SHARES, max(1, -(-chars // SHARE_CHARS)))
        self._write(self._stats(signed, 0, shares), "stats", segment)
        for share in range(1, shares):
            self._append(self._stats(signed, share, shares), "stats", segment)
        self._commit([*segments, segment])

    def merge(self, force: bool = False) -> bool:
        """Rewrites the live documents as one segment, if there are many segments or many deleted documents."""
        segments = self.segments()
        stored, live = self._read("docs").count(), self._read("stats").agg(F.sum("docs")).first()[0] or 0
        if not force and len(segments) < MERGE_SEGMENTS and live >= (1 - MERGE_SHARE) * stored:
            return False
        segment = self._new_segment()
        for table in ("tokens", "docs"):
            self._write(self._live(table).drop("segment"), table, segment)
        self._write(self._read("tombstones").drop("segment").limit(0), "tombstones", segment)
        self._write(self.statistics(), "stats", segment)
        self._commit([segment])
        return True

    # -- reading ----------------------------------------------------------------

    def statistics(self) -> DataFrame:
        """term, df, total of the live documents, and their number (docs) in the row without a term."""
        return self._read("stats").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "total", "docs")]) \
            .where("df > 0 OR term IS NULL")

    def load(self, max_features: int = MAX_FEATURES, max_df: float = MAX_DF) -> Index:
        """The index of the live documents, the same as one built anew from them."""
        stored = self._read("stats")
        n_docs = F.lit(float(stored.where("term IS NULL").agg(F.sum("docs")).first()[0] or 0))
        terms = stored.where("term IS NOT NULL")

        candidates = stored_candidates(terms, max_features)
        some = of_candidates(terms, self.spark.createDataFrame([(int(h),) for h in candidates.hashes], "h long"))
        vocab = written(vocabulary_of(some, n_docs, max_features, max_df), "vocabulary")
        if not candidates.decide(vocab):
            vocab = written(vocabulary_of(terms, n_docs, max_features, max_df), "vocabulary")
        vectors = Vectors(self._read("tokens"), vocab, self._undeleted)
        return Index(vocab, vectors.postings(), vectors.norms(), self._live("docs").drop("segment"), vectors=vectors)
