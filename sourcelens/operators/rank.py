"""First-k / top-k per group (G1) and the important-file ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import contains_any
from ..functions.rules import CONFIG_PATH_WORDS, IMPORTANT_PATH_WORDS


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank_col: str | None = None,
          dense: bool = False) -> DataFrame:
    """Keep the first ``k`` rows of each ``by`` group under a total ``order``
    (with ``dense``: all rows of the first ``k`` distinct ``order`` values).

    ``row_number() <= k`` / ``dense_rank() <= k`` lets Spark insert a partial
    WindowGroupLimit before the shuffle, so each map task forwards a bounded
    number of rows per group even when one group holds a large share of the data.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    name = rank_col or "__rn"
    fn = F.dense_rank() if dense else F.row_number()
    out = df.withColumn(name, fn.over(w)).where(F.col(name) <= k)
    return out if rank_col else out.drop(name)


def importance_score(path: Column, n_functions: Column, n_classes: Column) -> Column:
    """+10 key path word, +5 config word, +2 per function, +3 per class,
    -5 for test paths or files without symbols."""
    p = F.lower(path)
    score = (F.when(contains_any(p, IMPORTANT_PATH_WORDS), 10).otherwise(0)
             + F.when(contains_any(p, CONFIG_PATH_WORDS), 5).otherwise(0)
             + n_functions * 2 + n_classes * 3)
    penalty = F.when(F.contains(p, F.lit("test")) | ((n_functions == 0) & (n_classes == 0)), 5).otherwise(0)
    return score - penalty


def important_files(counts: DataFrame, k: int = 5) -> DataFrame:
    """Per repository, files with a positive score, best ``k`` first.

    ``counts`` has ``repo, path, functions, classes`` (see ``file_counts``).
    Ties are broken by path.
    """
    scored = counts.select("repo", "path", "language",
                           importance_score(F.col("path"), F.col("functions"), F.col("classes")).alias("score"))
    ranked = top_k(scored.where(F.col("score") > 0), ["repo"],
                   [F.col("score").desc(), F.col("path")], k, rank_col="rank")
    return ranked.select("repo", "rank", "path", "language", "score")
