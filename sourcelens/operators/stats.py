"""Per-repository aggregations.

All inputs are the per-file ``analyzed`` rows (or the scanned ``files``);
every result is one ``groupBy(repo)`` (partial aggregation map-side, so a
repository holding a large share of the files still sends one partial row
per map task).  Collections gathered per repository are bounded by a
constant (languages, fired rules), never by the number of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import contains_any, explode_rows, render
from ..functions.rules import (
    NO_PATTERNS_LINE, SUMMARY_TEMPLATE, ENTRY_POINT_WORDS, LAYERED_INDICATORS, MICROSERVICE_INDICATORS, MONOLITH_MIN_FILES, MVC_INDICATORS,
    RECOMMENDATIONS, TEST_PATH_WORDS,
)
from ..sources.corpus import valid


def language_stats(files: DataFrame) -> DataFrame:
    """Files and lines per (repo, language), per repo, and corpus-wide (rollup)."""
    return (files.rollup("repo", "language")
            .agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("total_lines")))


def file_counts(analyzed: DataFrame) -> DataFrame:
    """Imports, functions and classes per file, every file kept (zeros too)."""
    return analyzed.select("repo", "path", "language", F.col("n_imports").alias("imports"),
                           F.col("n_functions").alias("functions"), F.col("n_classes").alias("classes"))


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def repo_facts(analyzed: DataFrame) -> DataFrame:
    """One pass over the files: every per-repository fact of D2/D3/D4/D7/D8.

    A single ``groupBy(repo)`` with map-side partial aggregation; the
    repository tables below are projections of it.
    """
    ok = F.col("parsing_error").isNull()
    m = F.col("maintainability")
    p = F.lower(F.col("path"))
    is_test = contains_any(p, TEST_PATH_WORDS) | F.coalesce(F.col("has_tests"), F.lit(False))
    is_entry = F.coalesce(F.col("has_main"), F.lit(False)) | contains_any(p, ENTRY_POINT_WORDS)
    agg = analyzed.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_files"),
        _count_if(ok).alias("files"),
        F.sum(F.when(ok, F.col("n_functions")).otherwise(0)).cast("bigint").alias("total_functions"),
        F.sum(F.when(ok, F.col("n_classes")).otherwise(0)).cast("bigint").alias("total_classes"),
        F.sum(F.when(ok, F.col("n_imports")).otherwise(0)).cast("bigint").alias("total_imports"),
        # Bounded by the registered languages, so a set per group is small and
        # avoids the row expansion of a distinct aggregate.
        F.size(F.collect_set(F.when(ok, F.col("language")))).cast("bigint").alias("languages"),
        _count_if(ok & (m == "High")).alias("high"),
        _count_if(ok & (m == "Medium")).alias("medium"),
        _count_if(ok & (m == "Low")).alias("low"),
        _flags(p, MVC_INDICATORS).alias("mvc_n"), _flags(p, LAYERED_INDICATORS).alias("layered_n"),
        _flags(p, MICROSERVICE_INDICATORS).alias("micro_n"),
        _count_if(is_test).alias("test_files"), _count_if(~is_test).alias("regular_files"),
        _count_if(is_entry).alias("entry_points"))
    micro = F.col("micro_n") >= 3
    ratio = F.col("test_files") / F.greatest(F.col("regular_files"), F.lit(1))
    return agg.select(
        "repo", "total_files", "files", "total_functions", "total_classes", "total_imports", "languages",
        "high", "medium", "low",
        (F.col("mvc_n") >= 2).alias("mvc"), (F.col("layered_n") >= 2).alias("layered"),
        micro.alias("microservices"), ((F.col("total_files") > MONOLITH_MIN_FILES) & ~micro).alias("monolithic"),
        "test_files", "regular_files", ratio.alias("coverage_ratio"),
        F.when(ratio > 0.5, "High").when(ratio > 0.2, "Medium").otherwise("Low").alias("coverage_level"),
        "entry_points")


def repo_summary(analyzed: DataFrame) -> DataFrame:
    """Symbol totals and language count over the files that parsed."""
    return repo_facts(analyzed).select("repo", "files", "total_functions", "total_classes", "total_imports",
                                       "languages")


def maintainability_dist(analyzed: DataFrame) -> DataFrame:
    """D3: High / Medium / Low file counts, zero-filled."""
    return repo_facts(analyzed).select("repo", "high", "medium", "low")


def _flags(paths: Column, words: list[str]) -> Column:
    """Number of distinct indicator words found in any path of the group."""
    total = F.lit(0)
    for w in words:
        total = total + F.max(F.when(F.contains(paths, F.lit(w)), 1).otherwise(0))
    return total


def architecture_patterns(analyzed: DataFrame) -> DataFrame:
    """MVC (≥2 of 5), layered (≥2 of 6), microservices (≥3 of 5),
    monolithic (>20 files and not microservices) over all files."""
    return repo_facts(analyzed).select("repo", "mvc", "layered", "microservices", "monolithic")


def test_coverage(analyzed: DataFrame) -> DataFrame:
    """Test files (path says test/spec, or content mentions tests) vs the rest."""
    return repo_facts(analyzed).select("repo", "test_files", "regular_files", "coverage_ratio", "coverage_level")


def directory_stats(analyzed: DataFrame) -> DataFrame:
    """Files per first directory (paths with more than one part)."""
    parts = F.split("path", "/")
    return (analyzed.where(F.size(parts) > 1).groupBy("repo", parts[0].alias("directory"))
            .agg(F.count(F.lit(1)).alias("files")))


def organization(analyzed: DataFrame) -> DataFrame:
    """Depth, number of top directories and the organisation score."""
    parts = F.split("path", "/")
    agg = analyzed.groupBy("repo").agg(
        F.max(F.size(parts)).alias("depth"),
        F.countDistinct(F.when(F.size(parts) > 1, parts[0])).alias("directories"),
        F.count(F.lit(1)).alias("files"))
    return agg.select("repo", "depth", "directories", "files",
                      (F.col("directories") / F.col("files")).alias("organization_score"))


def directory_tree(analyzed: DataFrame) -> DataFrame:
    """Every path prefix as a tree node with its depth, parent and the
    number of files beneath; leaves carry their language."""
    parts = F.split("path", "/")
    nodes = explode_rows(analyzed.select("repo", "language", parts.alias("parts")),
                         F.sequence(F.lit(1), F.size("parts")), "depth", "repo", "language", "parts")
    nodes = nodes.select(
        "repo", "depth",
        F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("node"),
        F.array_join(F.slice("parts", 1, F.col("depth") - 1), "/").alias("parent"),
        (F.col("depth") == F.size("parts")).alias("is_file"),
        F.when(F.col("depth") == F.size("parts"), F.col("language")).alias("language"))
    return nodes.groupBy("repo", "node").agg(
        F.max("depth").alias("depth"), F.max("parent").alias("parent"),
        F.max("is_file").alias("is_file"), F.max("language").alias("language"),
        F.count(F.lit(1)).alias("files"))


def entry_points(analyzed: DataFrame) -> DataFrame:
    """Files that mention 'main' or whose path names an entry point."""
    p = F.lower(F.col("path"))
    return (analyzed.where(F.coalesce(F.col("has_main"), F.lit(False)) | contains_any(p, ENTRY_POINT_WORDS))
            .select("repo", "path").distinct())


def recommendations(facts: DataFrame) -> DataFrame:
    """One row per fired rule, in rule order."""
    rules = [
        F.col("total_functions") == 0,
        F.col("low") > F.col("high") + F.col("medium"),
        F.col("coverage_level") == "Low",
        F.col("entry_points") == 0,
        F.col("languages") > 5,
    ]
    fired = F.array(*[F.when(c, F.struct(F.lit(i).alias("rule"), F.lit(t).alias("recommendation")))
                      for i, (c, t) in enumerate(zip(rules, RECOMMENDATIONS))])
    return (explode_rows(facts, F.filter(fired, lambda x: x.isNotNull()), "r", "repo")
            .select("repo", "r.rule", "r.recommendation"))


def _pattern_list() -> Column:
    names = [("mvc", "MVC"), ("layered", "LAYERED"), ("microservices", "MICROSERVICES"), ("monolithic", "MONOLITHIC")]
    arr = F.filter(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in names]), lambda x: x.isNotNull())
    return F.when(F.size(arr) > 0, F.array_join(arr, ", ")).otherwise(F.lit("No specific patterns detected"))


def language_counts(analyzed: DataFrame) -> DataFrame:
    """Files per language of the parsed files, with the first path seen."""
    return (valid(analyzed).groupBy("repo", "language")
            .agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path")))


def languages_line(analyzed: DataFrame) -> DataFrame:
    """Per repository, ``lang=n`` pairs and the Python-list form of names in
    first-seen (path) order.  Bounded by the number of languages."""
    lc = language_counts(analyzed)
    return lc.groupBy("repo").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_path", "language", "files"))),
                                 lambda s: F.concat(s["language"], F.lit("="), s["files"].cast("string"))),
                     ", ").alias("language_counts"),
        F.concat(F.lit("["), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("first_path", "language"))),
            lambda s: F.concat(F.lit("'"), s["language"], F.lit("'"))), ", "), F.lit("]")).alias("language_list"))


def report_wide(analyzed: DataFrame) -> DataFrame:
    """The summary report values, one column per metric, one row per repository."""
    facts = repo_facts(analyzed)
    recs = recommendations(facts).groupBy("repo").agg(F.count(F.lit(1)).alias("n_recs"))
    wide = (facts.join(languages_line(analyzed), "repo", "left").join(recs, "repo", "left")
            .select("repo",
                    F.col("total_files").cast("string").alias("total_files"),
                    F.coalesce("language_counts", F.lit("")).alias("languages"),
                    F.col("total_functions").cast("string").alias("functions"),
                    F.col("total_classes").cast("string").alias("classes"),
                    _pattern_list().alias("architecture_patterns"),
                    F.coalesce("coverage_level", F.lit("Low")).alias("test_coverage"),
                    F.col("entry_points").cast("string").alias("entry_points"),
                    F.concat(F.lit("High="), F.col("high").cast("string"), F.lit(", Medium="),
                             F.col("medium").cast("string"), F.lit(", Low="), F.col("low").cast("string"))
                    .alias("complexity_distribution"),
                    F.coalesce(F.col("n_recs"), F.lit(0)).cast("string").alias("recommendations")))
    return wide


def summary_report(analyzed: DataFrame) -> DataFrame:
    """The summary report as (repo, metric, value) rows."""
    wide = report_wide(analyzed)
    metrics = [c for c in wide.columns if c != "repo"]
    stack = "stack({n}, {pairs}) as (metric, value)".format(
        n=len(metrics), pairs=", ".join(f"'{m}', `{m}`" for m in metrics))
    return wide.selectExpr("repo", stack)


def project_context(analyzed: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """``Project: … | [Description: … |] Languages: [...] | Total files: n |
    Functions: f | Classes: c`` per repository."""
    facts = repo_facts(analyzed).join(languages_line(analyzed), "repo", "left")
    if repos is not None:
        facts = facts.join(repos.select("repo", "name", "description"), "repo", "left")
        name = F.coalesce(F.col("name"), F.col("repo"))
        desc = F.col("description")
    else:
        name, desc = F.col("repo"), F.lit(None).cast("string")
    parts = F.concat_ws(
        " | ",
        F.concat(F.lit("Project: "), name),
        F.when(F.length(desc) > 0, F.concat(F.lit("Description: "), desc)),
        F.concat(F.lit("Languages: "), F.coalesce("language_list", F.lit("[]"))),
        F.concat(F.lit("Total files: "), F.col("total_files").cast("string")),
        F.concat(F.lit("Functions: "), F.col("total_functions").cast("string")),
        F.concat(F.lit("Classes: "), F.col("total_classes").cast("string")))
    return facts.select("repo", parts.alias("context"))


def summary_markdown(analyzed: DataFrame, generated_on: str = "1970-01-01 00:00:00") -> DataFrame:
    """D13 as the rendered markdown report per repository.

    Languages and the complexity distribution are printed as Python dict
    literals in first-seen order, as the analysed tool prints them; every
    list in it is bounded (languages, four patterns, five rules).
    """
    facts = repo_facts(analyzed)
    lc = language_counts(analyzed).groupBy("repo").agg(F.concat(F.lit("{"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("first_path", "language", "files"))),
        lambda s: F.concat(F.lit("'"), s["language"], F.lit("': "), s["files"].cast("string"))), ", "),
        F.lit("}")).alias("language_dict"))
    recs = recommendations(facts).groupBy("repo").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rule", "recommendation"))),
        lambda s: F.concat(F.lit("- "), s["recommendation"])), "\n").alias("recommendations"))
    names = [("mvc", "MVC"), ("layered", "LAYERED"), ("microservices", "MICROSERVICES"), ("monolithic", "MONOLITHIC")]
    lines = F.filter(F.array(*[F.when(F.col(c), F.lit(f"- **{n}**: Detected")) for c, n in names]),
                     lambda x: x.isNotNull())
    j = facts.join(lc, "repo", "left").join(recs, "repo", "left")
    text = render(SUMMARY_TEMPLATE, {
        "total_files": F.col("total_files"), "languages": F.coalesce("language_dict", F.lit("{}")),
        "functions": F.col("total_functions"), "classes": F.col("total_classes"),
        "patterns": F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit(NO_PATTERNS_LINE)),
        "coverage": F.col("coverage_level"), "entry_points": F.col("entry_points"),
        "distribution": F.concat(F.lit("{'High': "), F.col("high").cast("string"), F.lit(", 'Medium': "),
                                 F.col("medium").cast("string"), F.lit(", 'Low': "), F.col("low").cast("string"),
                                 F.lit("}")),
        "recommendations": F.coalesce("recommendations", F.lit("")), "generated_on": F.lit(generated_on)})
    return j.select("repo", text.alias("text"))
