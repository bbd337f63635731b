"""Snapshots of analysed corpora and change detection.

A snapshot is a Parquet table (rows clustered by ``repo``, no folder per
repository) in a folder the caller gives.  Change detection is a
single full outer join on ``(repo, path)`` comparing content hashes, so an
unchanged file is never re-analysed and an edited file always is — the
content hash replaces a cache key that could collide or go stale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("content_sha", F.sha2(F.col("content"), 256))


def write_snapshot(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist a corpus with content hashes."""
    with_hash(files).sortWithinPartitions("repo").write.mode(mode).parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def changed_files(new: DataFrame, old: DataFrame) -> DataFrame:
    """``(repo, path, change)`` for files added, modified or deleted in ``new``."""
    there = F.lit(True)
    n = new.select("repo", "path", F.sha2(F.col("content"), 256).alias("h_new"), there.alias("in_new"))
    o = (old.select("repo", "path", "content_sha") if "content_sha" in old.columns
         else old.select("repo", "path", F.sha2(F.col("content"), 256).alias("content_sha")))
    o = o.select("repo", "path", F.col("content_sha").alias("h_old"), there.alias("in_old"))
    j = n.join(o, ["repo", "path"], "full_outer")
    # a null hash means unreadable content, not a missing file
    change = (F.when(F.col("in_old").isNull(), "added")
              .when(F.col("in_new").isNull(), "deleted")
              .when(~F.col("h_new").eqNullSafe(F.col("h_old")), "modified"))
    return j.select("repo", "path", change.alias("change")).where(F.col("change").isNotNull())


def refresh(new_files: DataFrame, old_results: DataFrame, old_files: DataFrame, analyze_fn) -> DataFrame:
    """Results for ``new_files`` reusing ``old_results`` for unchanged files.

    ``old_results`` is any per-file table keyed by ``(repo, path)``; only
    added or modified files go through ``analyze_fn``; deleted files drop out.
    """
    changes = changed_files(new_files, old_files)
    touched = changes.where(F.col("change") != "deleted").select("repo", "path")
    gone = changes.select("repo", "path")
    kept = old_results.join(gone, ["repo", "path"], "left_anti")
    fresh = analyze_fn(new_files.join(touched, ["repo", "path"], "left_semi"))
    return kept.unionByName(fresh)


def write_docs(docs: DataFrame, path: str) -> DataFrame:
    """Write rendered documents (one row per document, clustered by
    repository); returns the saved document paths, as the analysed tool
    returns its list of written files."""
    docs.sortWithinPartitions("repo").write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path).select("repo", "doc_path")
