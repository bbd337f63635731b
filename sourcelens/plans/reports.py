"""Batch job: analyse a corpus once and write every report table.

The per-file analysis (nested arrays, no content) is written once to a
Parquet table in the output folder (or the shared checkpoint folder); every
report is then derived from that written table.  Writing it cuts the
lineage: a lost executor later in the job re-reads the table instead of
re-running the regex pass, and each report job stays small.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.rules import DEFAULT_RULES, LanguageRules
from ..operators import deps as DEP
from ..operators import docs as DOC
from ..operators import extract as E
from ..operators import retrieval as RT
from ..operators import stats as S
from ..session import checkpoint_dir

REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "functions": E.functions,
    "classes": E.classes,
    "methods": E.methods,
    "imports": E.imports,
    "comments": E.comments,
    "variables": E.variables,
    "docstrings": E.docstrings,
    "file_metrics": E.file_metrics,
    "file_counts": S.file_counts,
    "repo_facts": S.repo_facts,
    "summary_report": S.summary_report,
    "project_context": S.project_context,
    "directory_tree": S.directory_tree,
    "directory_stats": S.directory_stats,
    "organization": S.organization,
    "entry_points": S.entry_points,
    "top_imports": DEP.top_imports,
    "external_deps": DEP.external_deps,
    "internal_deps": DEP.internal_deps,
    "api_surface": DOC.api_surface,
    "file_digest": DOC.file_digest,
    "file_docs": DOC.file_docs,
    "doc_index": DOC.doc_index,
    "file_prompts": DOC.file_prompts,
    "api_prompts": DOC.api_prompts,
    "repo_prompts": DOC.repo_prompts,
    "summary_markdown": S.summary_markdown,
    "directory_tree_text": DOC.tree_text,
    "repo_readme": DOC.repo_readme,
    "doc_suite": DOC.doc_suite,
    "kb_docs": DOC.kb_docs,
}


def write_analysis(files: DataFrame, path: str, rules: LanguageRules = DEFAULT_RULES) -> DataFrame:
    """Analyse ``files`` and write the nested per-file table.

    Not partitioned by directory per repository (a corpus of millions of
    repositories would become millions of tiny folders); rows are clustered
    by repository inside each file so per-repository reads skip row groups.
    """
    E.analyze(files, rules).sortWithinPartitions("repo").write.mode("overwrite").parquet(path)
    return files.sparkSession.read.parquet(path)


def write_reports(spark: SparkSession, files: DataFrame, out_dir: str | None = None,
                  reports: list[str] | None = None, rules: LanguageRules = DEFAULT_RULES,
                  index: bool = False) -> dict[str, str]:
    """Write the analysis and each requested report under ``out_dir``; with
    ``index`` also the per-repository knowledge-base index (four tables).

    ``out_dir`` defaults to a folder inside the cluster's shared checkpoint
    folder.  Returns report name → written path.
    """
    out_dir = out_dir or os.path.join(checkpoint_dir(spark), "reports")
    analyzed = write_analysis(files, os.path.join(out_dir, "analysis"), rules)
    written: dict[str, str] = {}
    for name in reports or list(REPORTS):
        path = os.path.join(out_dir, name)
        REPORTS[name](analyzed).write.mode("overwrite").parquet(path)
        written[name] = path
    if index:
        path = os.path.join(out_dir, "index")
        kb = spark.read.parquet(written["kb_docs"]) if "kb_docs" in written else DOC.kb_docs(analyzed)
        RT.build_index(kb, group="repo").save(path)
        written["index"] = path
    return written
