"""Dependencies: import frequency (D9), known libraries (D10, E2) and
internal file-to-module edges (E1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import explode_rows
from ..functions.rules import EXTERNAL_LIBRARIES
from ..session import written
from . import extract as E
from .rank import top_k

KNOWN_LIBRARY_PATTERN = "|".join(EXTERNAL_LIBRARIES)


def import_frequency(analyzed: DataFrame) -> DataFrame:
    """Count of each normalised module per repository."""
    return E.imports(analyzed).groupBy("repo", "module").agg(F.count(F.lit(1)).alias("uses"))


def top_imports(analyzed: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most used modules per repository (ties by module)."""
    return top_k(import_frequency(analyzed), ["repo"], [F.col("uses").desc(), F.col("module")], k,
                 rank_col="rank").select("repo", "rank", "module", "uses")


def corpus_top_imports(analyzed: DataFrame, k: int = 10) -> DataFrame:
    """G1 corpus-wide: the ``k`` most used modules over all repositories.

    A global ``orderBy().limit(k)`` plans as TakeOrderedAndProject: each task
    keeps its own top ``k``, so the final merge sees ``k`` rows per task.
    """
    freq = E.imports(analyzed).groupBy("module").agg(F.count(F.lit(1)).alias("uses"))
    return freq.orderBy(F.col("uses").desc(), F.col("module")).limit(k)


def external_deps(analyzed: DataFrame, k: int = 10) -> DataFrame:
    """Distinct lower-cased modules naming a known library, first ``k`` by name.

    The library list is a fixed set of plain words, so "contains any" is one
    alternation regex evaluated in the projection — no join at all.
    """
    mods = (E.imports(analyzed).select("repo", F.lower("module").alias("dependency"))
            .where(F.col("dependency").rlike(KNOWN_LIBRARY_PATTERN)).distinct())
    return top_k(mods, ["repo"], [F.col("dependency")], k)


def _stems(analyzed: DataFrame) -> DataFrame:
    """File name up to its first dot, per repository (distinct)."""
    stem = F.substring_index(F.substring_index(F.col("path"), "/", -1), ".", 1)
    return analyzed.select("repo", stem.alias("stem")).distinct()


GRAM = 3


def _module_grams(mods: DataFrame) -> DataFrame:
    """``repo, module, gram``: the distinct strings of 0 to ``GRAM`` characters inside each module."""
    chars = F.regexp_extract_all("module", F.lit("(?s)."), F.lit(0))
    d = mods.select("repo", "module", chars.alias("c1"))
    for k in range(2, GRAM + 1):
        n = F.size(f"c{k - 1}")
        longer = F.when(n > 1, F.zip_with(F.slice(f"c{k - 1}", F.lit(1), n - 1), F.slice("c1", F.lit(k), n - 1), lambda a, c: F.concat(a, c))) \
            .otherwise(F.array().cast("array<string>"))
        d = d.select("*", longer.alias(f"c{k}"))
    every = F.array_distinct(F.concat(F.array(F.lit("")), *[F.col(f"c{k}") for k in range(1, GRAM + 1)]))
    return explode_rows(d, every, "gram", "repo", "module")


def _stem_grams(stems: DataFrame, grams: DataFrame) -> DataFrame:
    """``repo, stem, gram``: for each stem the string to look it up by, the one of its ``GRAM``-character strings that the
    fewest modules of its repository hold; a shorter stem is looked up whole.  A stem with a string that no module
    holds is in none of them and has no row."""
    n = F.length("stem")
    parts = F.array_distinct(F.when(n <= GRAM, F.array("stem")).otherwise(
        F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.substring(F.col("stem"), i, GRAM))))
    of_stem = explode_rows(stems.select("*", parts.alias("parts")), "parts", "gram", "repo", "stem", F.size("parts").alias("n"))
    holders = grams.join(of_stem.select("repo", "gram").distinct(), ["repo", "gram"], "left_semi") \
        .groupBy("repo", "gram").agg(F.count(F.lit(1)).alias("modules"))
    return (of_stem.join(holders, ["repo", "gram"]).groupBy("repo", "stem")
            .agg(F.min(F.struct("modules", "gram")).alias("rarest"), F.count(F.lit(1)).alias("found"), F.first("n").alias("n"))
            .where("found = n").select("repo", "stem", F.col("rarest.gram").alias("gram")))


def internal_dep_edges(analyzed: DataFrame) -> DataFrame:
    """E1 (uncapped): every import whose module contains the stem of a file of
    the same repository.

    A substring join by rare grams: each distinct module gives its strings of
    up to three characters (in proportion to its length), each distinct stem
    the one of its own that the fewest modules hold; modules and stems meet by
    an equi-join on that string, and ``contains`` decides.
    """
    imps = E.imports(analyzed).select("repo", "path", "ord", "module")
    grams = written(_module_grams(imps.select("repo", "module").distinct()), "module-grams")
    keyed = _stem_grams(_stems(analyzed), grams)
    matched = grams.join(keyed, ["repo", "gram"]).where(F.contains("module", "stem")).select("repo", "module").distinct()
    return imps.join(matched, ["repo", "module"], "left_semi")


def internal_deps(analyzed: DataFrame, per_file: int = 5, files: int = 10) -> DataFrame:
    """E1 as reported: first ``per_file`` matching imports of the first
    ``files`` files (by path) of each repository."""
    edges = internal_dep_edges(analyzed)
    per = top_k(edges, ["repo", "path"], [F.col("ord")], per_file, rank_col="dep_rank")
    first = top_k(per, ["repo"], [F.col("path")], files, dense=True)
    return first.select("repo", "path", (F.col("dep_rank") - 1).alias("ord"), F.col("module").alias("dependency"))
