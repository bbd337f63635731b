"""Documentation tables (D15–D18) and the knowledge base (F1).

Every document is one row built from the per-file arrays of ``analyze`` or
from bounded per-repository groups (at most ``k`` important files, at most 30
API entries, a fixed number of report lines), so no group grows with the
number of files in a repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import explode_rows, py_strip, render
from ..functions.rules import (
    API_PAGE_TEMPLATE, ARCHITECTURE_PAGE_TEMPLATE, FILE_PAGE_TEMPLATE, SETUP_PAGE_TEMPLATE, SETUP_TEXT_TEMPLATE,
    API_CLASS_BLOCK, API_FUNCTION_BLOCK, API_PREVIEW_CHARS, API_PROMPT_TEMPLATE, NO_DESCRIPTION,
    OVERVIEW_PROMPT_TEMPLATE, PROMPT_ENTRY_POINTS_CAP, README_DESCRIPTION, README_OVERVIEW_CHARS, README_TEMPLATE,
    SETUP_PROMPT_TEMPLATE, TREE_BRANCH, TREE_FILES_CAP, TREE_LAST, TREE_PIPE, TREE_SPACE,
    API_CLASSES_CAP, API_FUNCTIONS_CAP, DIGEST_CLASSES_CAP, DIGEST_FUNCTIONS_CAP, DIGEST_IMPORTS_CAP,
    FILE_DOC_FUNCTION_LINE, FILE_DOC_FUNCTIONS_CAP, FILE_DOC_IMPORTS_CAP, FILE_DOC_TEMPLATE, FILE_INDEX_ENTRY,
    FILE_INDEX_TEMPLATE, FILE_PROMPT_TEMPLATE, NO_API_TEXT, NO_CLASSES_LINE, NO_FUNCTIONS_LINE,
    PROMPT_CLASSES_CAP, PROMPT_FUNCTIONS_CAP, PROMPT_IMPORTS_CAP, PROMPT_SIGNATURE_CHARS,
)
from ..sources.corpus import valid
from . import deps as DEP
from . import extract as E
from . import stats as S
from ..session import written
from .rank import importance_score, top_k

DEFAULT_GENERATED_ON = "1970-01-01 00:00:00"


def _more(n: Column, cap: int, noun: str) -> Column:
    return F.when(n > cap, F.concat(F.lit("... and "), (n - cap).cast("string"), F.lit(f" more {noun}")))


def file_digest(analyzed: DataFrame) -> DataFrame:
    """One summary line per parsed file (the knowledge-base file entry)."""
    nf, nc, ni = F.size("functions"), F.size("classes"), F.size("imports")
    parts = [
        F.concat(F.lit("File: "), F.col("path"), F.lit(" (Language: "), F.col("language"), F.lit(")")),
        F.concat(F.lit("Lines of code: "), F.col("code_lines").cast("string")),
        F.concat(F.lit("Complexity: "), F.col("maintainability")),
        F.when(nf > 0, F.concat(F.lit("Functions: "), F.array_join(
            F.transform(F.slice("functions", 1, DIGEST_FUNCTIONS_CAP), lambda f: f["name"]), ", "))),
        _more(nf, DIGEST_FUNCTIONS_CAP, "functions"),
        F.when(nc > 0, F.concat(F.lit("Classes: "), F.array_join(
            F.transform(F.slice("classes", 1, DIGEST_CLASSES_CAP), lambda c: c["name"]), ", "))),
        _more(nc, DIGEST_CLASSES_CAP, "classes"),
        F.when(ni > 0, F.concat(F.lit("Key imports: "), F.array_join(
            F.transform(F.slice("imports", 1, DIGEST_IMPORTS_CAP), lambda i: i["stmt"]), ", "))),
    ]
    return valid(analyzed).select("repo", "path", "language", F.concat_ws(" | ", *parts).alias("digest"))


def api_surface(analyzed: DataFrame) -> DataFrame:
    """First 20 functions and first 10 classes per repository in file
    order, or one explicit "none found" row."""
    fns = top_k(E.functions(analyzed), ["repo"], [F.col("path"), F.col("ord")], API_FUNCTIONS_CAP,
                rank_col="r").select("repo", F.lit("function").alias("kind"), (F.col("r") - 1).alias("ord"),
                                     "path", "name", "signature")
    cls = top_k(E.classes(analyzed), ["repo"], [F.col("path"), F.col("ord")], API_CLASSES_CAP,
                rank_col="r").select("repo", F.lit("class").alias("kind"), (F.col("r") - 1).alias("ord"),
                                     "path", "name", "signature")
    found = fns.unionByName(cls)
    # Repositories without any function or class, from the one facts aggregation
    # (files that failed to parse contribute no symbols).
    none = (S.repo_facts(analyzed).where((F.col("total_functions") == 0) & (F.col("total_classes") == 0))
            .select("repo", F.lit("none").alias("kind"), F.lit(0).alias("ord"),
                    F.lit(None).cast("string").alias("path"), F.lit(NO_API_TEXT).alias("name"),
                    F.lit(None).cast("string").alias("signature")))
    return found.unionByName(none)


def important_analyzed(analyzed: DataFrame, k: int = 5) -> DataFrame:
    """Per-file rows of the ``k`` most important files of each repository.

    Ranked on the analysed rows themselves: the partial group limit keeps at
    most ``k`` rows per repository in each task before the shuffle, so no
    join back to the full table is needed.
    """
    scored = analyzed.withColumn("score", importance_score(F.col("path"), F.col("n_functions"),
                                                           F.col("n_classes")))
    return top_k(scored.where(F.col("score") > 0), ["repo"], [F.col("score").desc(), F.col("path")], k,
                 rank_col="rank")


def safe_name(path: Column) -> Column:
    return F.translate(path, "/.", "__")


def file_doc_text(df: DataFrame) -> Column:
    """The per-file documentation page (analysis-only form)."""
    nf, nc, ni = F.size("functions"), F.size("classes"), F.size("imports")
    fn_lines = F.when(nf > 0, F.array_join(F.transform(
        F.slice("functions", 1, FILE_DOC_FUNCTIONS_CAP),
        lambda f: render(FILE_DOC_FUNCTION_LINE, {"name": f["name"], "line": f["line"]})), "")) \
        .otherwise(F.lit(NO_FUNCTIONS_LINE))
    cls_lines = F.when(nc > 0, F.array_join(F.transform(
        "classes", lambda c: render(FILE_DOC_FUNCTION_LINE, {"name": c["name"], "line": c["line"]})), "")) \
        .otherwise(F.lit(NO_CLASSES_LINE))
    deps = F.when(ni > 0, F.concat(F.lit("\n## Dependencies\n"), F.array_join(F.transform(
        F.slice("imports", 1, FILE_DOC_IMPORTS_CAP), lambda i: F.concat(F.lit("- "), i["stmt"], F.lit("\n"))), ""))) \
        .otherwise(F.lit(""))
    return render(FILE_DOC_TEMPLATE, {
        "path": F.col("path"), "language": F.col("language"), "n_functions": nf, "n_classes": nc,
        "function_lines": fn_lines, "class_lines": cls_lines, "dependencies": deps,
        "total_lines": F.col("total_lines"), "code_lines": F.col("code_lines"),
        "maintainability": F.col("maintainability")})


def file_docs(analyzed: DataFrame, k: int = 5) -> DataFrame:
    """Documentation pages of the ``k`` most important files per repository."""
    imp = important_analyzed(analyzed, k)
    return imp.select("repo", "path",
                      F.concat(F.lit("docs/files/"), safe_name(F.col("path")), F.lit(".md")).alias("doc_path"),
                      file_doc_text(imp).alias("text"))


def doc_index(analyzed: DataFrame, k: int = 5, generated_on: str = DEFAULT_GENERATED_ON) -> DataFrame:
    """The per-repository index of documented files, sorted by path."""
    imp = important_analyzed(analyzed, k).select("repo", "path")
    entry = render(FILE_INDEX_ENTRY, {"path": F.col("path"), "safe_name": safe_name(F.col("path"))})
    per_repo = imp.groupBy("repo").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", entry.alias("e")))),
                                 lambda s: s["e"]), "").alias("entries"),
        F.count(F.lit(1)).alias("n_files"))
    return per_repo.select("repo", F.lit("docs/FILES.md").alias("doc_path"), render(FILE_INDEX_TEMPLATE, {
        "entries": F.col("entries"), "n_files": F.col("n_files"), "generated_on": F.lit(generated_on)})
        .alias("text"))


def file_prompts(analyzed: DataFrame, k: int = 5) -> DataFrame:
    """The file-documentation prompt for each important file, for users
    who feed these rows to a model of their own."""
    imp = important_analyzed(analyzed, k)
    nf, nc, ni = F.size("functions"), F.size("classes"), F.size("imports")
    fn_sum = F.when(nf == 0, F.lit("None")).otherwise(F.concat_ws(
        "\n",
        F.array_join(F.transform(F.slice("functions", 1, PROMPT_FUNCTIONS_CAP), lambda f: F.concat(
            F.lit("- "), f["name"], F.lit(": "),
            F.substring(F.replace(f["signature"], F.lit("\n"), F.lit(" ")), 1, PROMPT_SIGNATURE_CHARS),
            F.lit("... ("), f["estimated_lines"].cast("string"), F.lit(" lines)"))), "\n"),
        _more(nf, PROMPT_FUNCTIONS_CAP, "functions")))
    cls_sum = F.when(nc == 0, F.lit("None")).otherwise(F.concat_ws(
        "\n",
        F.array_join(F.transform(F.slice("classes", 1, PROMPT_CLASSES_CAP), lambda c: F.concat(
            F.lit("- "), c["name"], F.lit(": "), c["method_count"].cast("string"), F.lit(" methods"))), "\n"),
        _more(nc, PROMPT_CLASSES_CAP, "classes")))
    imps = F.when(ni == 0, F.lit("None")).otherwise(F.array_join(
        F.transform(F.slice("imports", 1, PROMPT_IMPORTS_CAP), lambda i: i["stmt"]), "\n"))
    return imp.select("repo", "path", render(FILE_PROMPT_TEMPLATE, {
        "path": F.col("path"), "language": F.col("language"), "n_functions": nf, "n_classes": nc,
        "functions_summary": fn_sum, "classes_summary": cls_sum, "imports": imps,
        "code_lines": F.col("code_lines"), "complexity": F.col("complexity"),
        "maintainability": F.col("maintainability")}).alias("prompt"))


REPORT_LABELS = [
    ("total_files", "Total Files"), ("languages", "Languages"), ("functions", "Functions"),
    ("classes", "Classes"), ("architecture_patterns", "Architecture Patterns"), ("test_coverage", "Test Coverage"),
    ("entry_points", "Entry Points"), ("complexity_distribution", "Complexity Distribution"),
    ("recommendations", "Recommendations"),
]


def overview_text(analyzed: DataFrame) -> DataFrame:
    """Per repository, the summary report as one markdown block."""
    wide = S.report_wide(analyzed)
    lines = [F.concat(F.lit(f"- **{label}**: "), F.col(c)) for c, label in REPORT_LABELS]
    return wide.select("repo", F.concat_ws("\n", F.lit("# Project Analysis Summary"), *lines).alias("text"))


def api_text(analyzed: DataFrame) -> DataFrame:
    """Per repository, the API surface as one block (at most 30 entries)."""
    api = api_surface(analyzed)
    kind_order = F.when(F.col("kind") == "function", 0).when(F.col("kind") == "class", 1).otherwise(2)
    line = F.when(F.col("kind") == "none", F.col("name")).otherwise(
        F.concat(F.lit("- "), F.col("kind"), F.lit(" "), F.col("name"), F.lit(": `"), F.col("signature"), F.lit("`")))
    return api.groupBy("repo").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(kind_order.alias("k"), F.col("ord").alias("o"), line.alias("l")))),
        lambda s: s["l"]), "\n").alias("text"))


def kb_docs(analyzed: DataFrame, k: int = 5) -> DataFrame:
    """the knowledge base — overview, API block and setup facts per repository, one
    digest per parsed file, and the documentation page of each important
    file — with typed metadata and a deterministic string ``doc_id``."""
    def shape(df: DataFrame, type_: str, source: Column, category: str, language: Column) -> DataFrame:
        return df.select(
            F.concat_ws(":", F.col("repo"), F.lit(type_), source).alias("doc_id"), "repo",
            F.lit(type_).alias("type"), source.alias("source"), F.lit(category).alias("category"),
            language.alias("language"), "text")

    null_s = F.lit(None).cast("string")
    overview = shape(overview_text(analyzed), "overview", F.lit("project_overview"), "documentation", null_s)
    api = shape(api_text(analyzed), "api", F.lit("api_documentation"), "documentation", null_s)
    digests = shape(file_digest(analyzed).withColumnRenamed("digest", "text"), "file_analysis", F.col("path"),
                    "code", F.col("language"))
    setup = shape(setup_text(analyzed), "setup", F.lit("setup_guide"), "documentation", null_s)
    docs = shape(file_docs(analyzed, k), "file_documentation", F.col("path"), "documentation", null_s)
    return overview.unionByName(api).unionByName(setup).unionByName(digests).unionByName(docs)


def api_prompts(analyzed: DataFrame) -> DataFrame:
    """The API-documentation prompt per repository (first 20 functions and
    10 classes in file order), or the fixed "none found" text."""
    fns = top_k(E.functions(analyzed), ["repo"], [F.col("path"), F.col("ord")], API_FUNCTIONS_CAP, rank_col="r")
    fn_block = py_strip(render(API_FUNCTION_BLOCK, {
        "name": F.col("name"), "signature": F.col("signature"),
        "preview": F.substring("body_preview", 1, API_PREVIEW_CHARS)}))
    f_agg = fns.groupBy("repo").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", fn_block.alias("b")))),
                                 lambda s: s["b"]), "\n\n").alias("functions_detail"),
        F.count(F.lit(1)).alias("n_functions"))
    cls = explode_rows(analyzed, "classes", "c", "repo", "path").select(
        "repo", "path", "c.ord", "c.name", "c.signature", "c.methods")
    cls = top_k(cls, ["repo"], [F.col("path"), F.col("ord")], API_CLASSES_CAP, rank_col="r")
    methods = F.when(F.size("methods") > 0, F.array_join(F.slice("methods", 1, 5), ", ")).otherwise(F.lit("None"))
    c_block = py_strip(render(API_CLASS_BLOCK, {"name": F.col("name"), "signature": F.col("signature"),
                                                "methods": methods}))
    c_agg = cls.groupBy("repo").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", c_block.alias("b")))),
                                 lambda s: s["b"]), "\n\n").alias("classes_detail"),
        F.count(F.lit(1)).alias("n_classes"))
    repos = analyzed.select("repo").distinct()
    j = repos.join(f_agg, "repo", "left").join(c_agg, "repo", "left")
    prompt = render(API_PROMPT_TEMPLATE, {
        "n_functions": F.coalesce("n_functions", F.lit(0)), "n_classes": F.coalesce("n_classes", F.lit(0)),
        "functions_detail": F.coalesce("functions_detail", F.lit("None")),
        "classes_detail": F.coalesce("classes_detail", F.lit("None"))})
    none = F.col("n_functions").isNull() & F.col("n_classes").isNull()
    return j.select("repo", F.when(none, F.lit(NO_API_TEXT)).otherwise(prompt).alias("prompt"))


def _py_list(items: Column) -> Column:
    """A Python-style list literal of strings: ``['a', 'b']``."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))),
                                              ", "), F.lit("]"))


def _repo_lists(analyzed: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Repository facts with their language, entry-point and dependency lists, and the rendered last two."""
    facts = S.repo_facts(analyzed)
    langs = S.language_counts(analyzed).groupBy("repo").agg(
        F.array_sort(F.collect_list(F.struct("first_path", "language", "files"))).alias("l"))
    langs = langs.select(
        "repo",
        F.concat(F.lit("{"), F.array_join(F.transform("l", lambda s: F.concat(
            F.lit("'"), s["language"], F.lit("': "), s["files"].cast("string"))), ", "), F.lit("}")).alias("lang_dict"),
        _py_list(F.transform("l", lambda s: s["language"])).alias("lang_list"))
    eps = top_k(S.entry_points(analyzed), ["repo"], [F.col("path")], PROMPT_ENTRY_POINTS_CAP)
    eps = eps.groupBy("repo").agg(F.array_sort(F.collect_list("path")).alias("ep"))
    deps = DEP.external_deps(analyzed).groupBy("repo").agg(F.array_sort(F.collect_list("dependency")).alias("dp"))
    j = facts.join(langs, "repo", "left").join(eps, "repo", "left").join(deps, "repo", "left")
    ep_text = F.concat(_py_list(F.coalesce("ep", F.array().cast("array<string>"))),
                       F.when(F.col("entry_points") > PROMPT_ENTRY_POINTS_CAP, F.concat(
                           F.lit(" (+"), (F.col("entry_points") - PROMPT_ENTRY_POINTS_CAP).cast("string"),
                           F.lit(" more)"))).otherwise(F.lit("")))
    return j, ep_text, F.coalesce("dp", F.array().cast("array<string>"))


def setup_text(analyzed: DataFrame) -> DataFrame:
    """Per repository what a setup guide needs: languages, known dependencies, entry points."""
    j, ep_text, dep_list = _repo_lists(analyzed)
    return j.select("repo", render(SETUP_TEXT_TEMPLATE, {
        "languages": F.coalesce("lang_list", F.lit("[]")), "dependencies": _py_list(dep_list),
        "entry_points": ep_text}).alias("text"))


def doc_suite(analyzed: DataFrame, k: int = 5, generated_on: str = DEFAULT_GENERATED_ON,
              repos: DataFrame | None = None) -> DataFrame:
    """Every page of each repository's documentation, by its path: README, the API, setup and architecture
    pages, the file index and one page for each of the ``k`` most important files."""
    def page(texts: DataFrame, doc_path: Column, template: str, **fields: Column) -> DataFrame:
        return texts.select("repo", doc_path.alias("doc_path"), render(template, {
            "text": F.col("text"), "generated_on": F.lit(generated_on), **fields}).alias("text"))

    files = file_docs(analyzed, k)
    return (repo_readme(analyzed, generated_on, repos)
            .unionByName(page(api_text(analyzed), F.lit("docs/API.md"), API_PAGE_TEMPLATE))
            .unionByName(page(setup_text(analyzed), F.lit("docs/SETUP.md"), SETUP_PAGE_TEMPLATE))
            .unionByName(page(overview_text(analyzed), F.lit("docs/ARCHITECTURE.md"), ARCHITECTURE_PAGE_TEMPLATE))
            .unionByName(doc_index(analyzed, k, generated_on))
            .unionByName(page(files, F.col("doc_path"), FILE_PAGE_TEMPLATE, path=F.col("path"))))


def repo_prompts(analyzed: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Overview and setup prompts per repository (``repos``: names and descriptions, E5).

    Entry points are listed sorted by path, at most 20, followed by
    ``(+N more)`` when there are more; every other list is bounded already
    (languages, four patterns, ten dependencies, five rules).
    """
    j, ep_text, dep_list = _repo_lists(analyzed)
    facts = S.repo_facts(analyzed)
    recs = S.recommendations(facts).groupBy("repo").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rule", "recommendation"))),
        lambda s: F.concat(F.lit("- "), s["recommendation"])), "\n").alias("recs"))
    j, name, description = _named(j.join(recs, "repo", "left"), repos, NO_DESCRIPTION)
    patterns = F.concat(F.lit("{'mvc': "), _py_bool(F.col("mvc")), F.lit(", 'layered': "), _py_bool(F.col("layered")),
                        F.lit(", 'microservices': "), _py_bool(F.col("microservices")),
                        F.lit(", 'monolithic': "), _py_bool(F.col("monolithic")), F.lit("}"))
    overview = render(OVERVIEW_PROMPT_TEMPLATE, {
        "name": name, "description": description, "total_files": F.col("total_files"),
        "languages": F.coalesce("lang_dict", F.lit("{}")), "functions": F.col("total_functions"),
        "classes": F.col("total_classes"), "n_dependencies": F.size(dep_list), "patterns": patterns,
        "entry_points": ep_text, "coverage": F.col("coverage_level"), "recommendations": F.coalesce("recs", F.lit(""))})
    setup = render(SETUP_PROMPT_TEMPLATE, {
        "languages": F.coalesce("lang_list", F.lit("[]")), "dependencies": _py_list(dep_list),
        "entry_points": ep_text})
    return j.select("repo", overview.alias("overview_prompt"), setup.alias("setup_prompt"))


def _py_bool(c: Column) -> Column:
    return F.when(c, F.lit("True")).otherwise(F.lit("False"))


def tree_text(analyzed: DataFrame, files: int = 20) -> DataFrame:
    """The directory tree of the first ``files`` files (by path) of
    each repository, drawn as text.

    Children keep the order in which they first appear; a node is last among
    its siblings when no sibling appears later.  The drawing order is the
    array of first-appearance ranks along the node's path.  Everything per
    repository is bounded by ``files`` × depth nodes.
    """
    first = top_k(analyzed.select("repo", "path", "language"), ["repo"], [F.col("path")], files, rank_col="r")
    parts = first.select("repo", "r", "language", F.split("path", "/").alias("parts"))
    nodes = explode_rows(parts, F.sequence(F.lit(1), F.size("parts")), "d", "repo", "r", "language", "parts")
    nodes = nodes.select(
        "repo", "r", "d", F.slice("parts", 1, F.col("d")).alias("key_parts"),
        F.array_join(F.slice("parts", 1, F.col("d") - 1), "/").alias("parent"),
        (F.col("d") == F.size("parts")).alias("is_file"),
        F.when(F.col("d") == F.size("parts"), F.col("language")).alias("language"))
    info = nodes.groupBy("repo", F.array_join("key_parts", "/").alias("key")).agg(
        F.min("r").alias("first"), F.max("d").alias("d"), F.max("parent").alias("parent"),
        F.max("is_file").alias("is_file"), F.max("language").alias("language"),
        F.max("key_parts").alias("key_parts"))
    last = F.col("first") == F.max("first").over(Window.partitionBy("repo", "parent"))
    info = info.withColumn("is_last", last)
    per_repo = info.groupBy("repo").agg(F.collect_list(F.struct(
        "key", "key_parts", "d", "first", "is_last", "is_file", "language")).alias("nodes"))
    per_repo = per_repo.select("repo", "nodes", F.map_from_entries(F.transform(
        "nodes", lambda n: F.struct(n["key"], F.struct(n["first"].alias("first"), n["is_last"].alias("is_last")))))
        .alias("m"))

    def line(n: Column) -> Column:
        prefix_key = lambda k: F.array_join(F.slice(n["key_parts"], 1, k), "/")
        ancestors = F.when(n["d"] > 1, F.sequence(F.lit(1), n["d"] - 1)).otherwise(F.array().cast("array<int>"))
        indent = F.array_join(F.transform(ancestors, lambda k: F.when(
            F.col("m")[prefix_key(k)]["is_last"], F.lit(TREE_SPACE)).otherwise(F.lit(TREE_PIPE))), "")
        connector = F.when(n["is_last"], F.lit(TREE_LAST)).otherwise(F.lit(TREE_BRANCH))
        tail = F.when(n["is_file"], F.concat(F.lit(" ("), F.coalesce(n["language"], F.lit("")), F.lit(")\n"))) \
                .otherwise(F.lit("/\n"))
        order = F.transform(F.sequence(F.lit(1), n["d"]), lambda k: F.col("m")[prefix_key(k)]["first"])
        return F.struct(order.alias("o"), F.concat(indent, connector, F.element_at(n["key_parts"], -1), tail).alias("t"))

    drawn = per_repo.select("repo", F.transform("nodes", line).alias("lines"))
    return drawn.select("repo", F.array_join(F.transform(F.array_sort("lines"), lambda x: x["t"]), "").alias("tree"))


def tree_lines(analyzed: DataFrame) -> DataFrame:
    """The drawn directory tree of whole repositories, one row a line: ``repo, first_path, depth, line``.

    A node's ``first_path`` is the smallest path under it.  Paths under one directory are neighbours in path order, so
    sorting by (first_path, depth) gives the lines in drawing order, on any number of range partitions.  A node is the
    last of its directory if its first path is the largest among its siblings; directories get the indent of what
    stands in them from the directories above (one row for each level), and nodes take it from their directory.
    Nothing is gathered for a repository or a directory.
    """
    parts = analyzed.select("repo", "path", "language", F.split("path", "/").alias("parts"))
    nodes = explode_rows(parts, F.sequence(F.lit(1), F.size("parts")), "d", "repo", "path", "language", "parts")
    is_file = F.col("d") == F.size("parts")
    nodes = nodes.select("repo", "path", "d", F.array_join(F.slice("parts", 1, F.col("d")), "/").alias("key"),
                         F.array_join(F.slice("parts", 1, F.col("d") - 1), "/").alias("parent"),
                         F.element_at("parts", F.col("d")).alias("name"), is_file.alias("is_file"),
                         F.when(is_file, F.col("language")).alias("language"))
    nodes = nodes.groupBy("repo", "key").agg(
        F.min("path").alias("first_path"), F.min("d").alias("depth"), F.min("parent").alias("parent"), F.min("name").alias("name"),
        F.max("is_file").alias("is_file"), F.min("is_file").alias("only_file"), F.max("language").alias("language"))
    nodes = written(nodes, "tree-nodes")
    ends = written(nodes.groupBy("repo", "parent").agg(F.max("first_path").alias("last")), "tree-ends")
    nodes = written(nodes.join(ends, ["repo", "parent"]).withColumn("is_last", F.col("first_path") == F.col("last")), "tree-placed")
    folders = nodes.where(~F.col("only_file"))
    levels = explode_rows(folders.select("repo", "key", F.split("key", "/").alias("parts")), F.sequence(F.lit(1), F.size("parts")), "d",
                          "repo", "key", "parts").select("repo", "key", "d", F.array_join(F.slice("parts", 1, F.col("d")), "/").alias("above"))
    pieces = levels.join(folders.select("repo", F.col("key").alias("above"), F.when(F.col("is_last"), TREE_SPACE).otherwise(TREE_PIPE).alias("piece")),
                         ["repo", "above"])
    indents = pieces.groupBy("repo", F.col("key").alias("parent")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("d", "piece"))), lambda x: x["piece"]), "").alias("indent"))
    line = F.concat(F.coalesce("indent", F.lit("")), F.when(F.col("is_last"), TREE_LAST).otherwise(TREE_BRANCH), F.col("name"),
                    F.when(F.col("is_file"), F.concat(F.lit(" ("), F.coalesce("language", F.lit("")), F.lit(")"))).otherwise(F.lit("/")))
    return nodes.join(written(indents, "tree-indents"), ["repo", "parent"], "left").select("repo", "first_path", "depth", line.alias("line")) \
        .orderBy("repo", "first_path", "depth")


def _named(facts: DataFrame, repos: DataFrame | None, no_description: str) -> tuple[DataFrame, Column, Column]:
    """E5: facts with each repository's name and description from its metadata (``repo, name, description``), where
    there is any; else the repository's key and a fixed text."""
    if repos is None:
        return facts, F.col("repo"), F.lit(no_description)
    about = repos.select("repo", F.col("name").alias("repo_name"), F.col("description").alias("repo_description"))
    return facts.join(about, "repo", "left"), F.coalesce("repo_name", "repo"), F.coalesce("repo_description", F.lit(no_description))


def repo_readme(analyzed: DataFrame, generated_on: str = DEFAULT_GENERATED_ON, repos: DataFrame | None = None) -> DataFrame:
    """The README page per repository: stats, documentation links and
    the drawn tree of the first 20 files; the overview is the start of the
    rendered summary report (the analysed tool puts a model-written text
    there).  ``repos`` gives names and descriptions (E5)."""
    facts = S.repo_facts(analyzed)
    langs = S.language_counts(analyzed).groupBy("repo").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("first_path", "language"))), lambda s: s["language"]), ", ")
        .alias("language_names"))
    overview = S.summary_markdown(analyzed, generated_on).select(
        "repo", F.substring("text", 1, README_OVERVIEW_CHARS).alias("overview"))
    j = (facts.join(langs, "repo", "left").join(overview, "repo", "left")
         .join(tree_text(analyzed, TREE_FILES_CAP), "repo", "left"))
    j, name, description = _named(j, repos, README_DESCRIPTION)
    return j.select("repo", F.lit("README.md").alias("doc_path"), render(README_TEMPLATE, {
        "name": name, "description": description, "overview": F.col("overview"),
        "languages": F.coalesce("language_names", F.lit("")), "files": F.col("total_files"),
        "functions": F.col("total_functions"), "classes": F.col("total_classes"),
        "tree": F.col("tree"), "generated_on": F.lit(generated_on)}).alias("text"))
