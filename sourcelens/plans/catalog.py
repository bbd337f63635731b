"""Named queries over the shared tables, each with its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` builds the Spark plan;
``ORACLE[name]`` is the independent SQL formulation (absent for operators
that have no SQL form).  Computed columns carry the same aliases on both
sides; doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deps as DEP
from ..operators import docs as DOC
from ..operators import extract as E
from ..operators import rank as RK
from ..operators import retrieval as RT
from ..operators import stats as S
from ..operators.index_store import IndexStore
from ..functions.rules import LanguageRules
from ..session import new_path, release_written, written
from ..sources import corpus as SRC
from ..sources import snapshot as SNAP
from ..sources.corpus import corpus_from_table, documents_corpus, language_of, spread
from ..sources.fixtures import api_responses, code_files, document_tree
from ..streaming.incremental import ingest_stream, read_output
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_SHARED: dict[tuple, object] = {}


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    """One instance per (session, state of the input files, name): reports of one
    session share written tables, and rewritten inputs are read anew."""
    key = (spark.sparkContext.applicationId, _state(spark, sf_dir), name)
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the tables' files (a listing, no read)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def listed(path) -> list:
        out = []
        for s in fs.listStatus(path):
            out += listed(s.getPath()) if s.isDirectory() else [(s.getPath().toString(), s.getLen(), s.getModificationTime())]
        return out
    return tuple(sorted(listed(root)))


def forget(spark: SparkSession | None = None) -> None:
    """Drops what the session's reports share; the next report builds it again.  With the session given, its written
    tables are deleted from the shared folder too."""
    _SHARED.clear()
    if spark is not None:
        release_written(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "corpus",
                  lambda: code_files(spark, spread(table(spark, sf_dir, "part"), "p_partkey")))


def analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-file analysis of the code corpus, computed once per session.

    Every report reads it, so it is written to the shared folder: the regex
    pass runs once, a lost executor's part is read again instead of re-run,
    and each report scans only its own columns.
    """
    return shared(spark, sf_dir, "analyzed", lambda: written(E.analyze(corpus(spark, sf_dir)), "analysis"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "documents", lambda: spread(table(spark, sf_dir, "documents"), "doc_id"))


def doc_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_corpus(documents(spark, sf_dir))


# ---------------------------------------------------------------------------
# Sources and projections
# ---------------------------------------------------------------------------

@register("corpus_table", O.with_ctes(
    "SELECT repo, path, full_path, language, size, lines FROM files", ["files"]))
def q_corpus_table(spark, sf):
    return corpus(spark, sf).drop("content")


_EXTS = [".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".cpp", ".c", ".go", ".rs", ".php", ".rb",
         ".swift", ".kt", ".md", ".txt", "", ".PY"]


@register("language_map", O.with_ctes(f"""
SELECT p AS path, {O.case_suffix('p')} AS language FROM
 (SELECT concat(path_stem, ext) AS p FROM
   (SELECT path_stem, unnest([{', '.join(O.sql_str(e) for e in _EXTS)}]) AS ext FROM
     (SELECT regexp_replace(path, '[.][^.]*$', '') AS path_stem FROM files)))""", ["files"]))
def q_language_map(spark, sf):
    """B1 over every code path under each candidate suffix (known, unknown, none)."""
    stems = corpus(spark, sf).select(F.regexp_replace("path", "[.][^.]*$", "").alias("path_stem"))
    paths = (stems.select("path_stem", F.explode(F.array(*[F.lit(e) for e in _EXTS])).alias("ext"))
             .select(F.concat("path_stem", "ext").alias("path")))
    return paths.select("path", language_of(F.col("path")).alias("language"))


# ---------------------------------------------------------------------------
# Extraction
# ---------------------------------------------------------------------------

@register("functions", O.with_ctes(
    "SELECT repo, path, language, ord, name, line, signature FROM fn_t", ["fn_t"]))
def q_functions(spark, sf):
    return E.functions(analyzed(spark, sf)).select("repo", "path", "language", "ord", "name", "line", "signature")


@register("function_bodies", O.with_ctes(f"""
SELECT repo, path, ord,
  CASE WHEN length(body) > {O.PREVIEW} THEN concat(substr(body, 1, {O.PREVIEW}), '...') ELSE body END AS body_preview,
  CAST(CASE WHEN length(body) > 0 THEN {O.nl('body')} + 1 ELSE 1 END AS INTEGER) AS estimated_lines
FROM fn_body""", ["fn_body"]))
def q_function_bodies(spark, sf):
    return E.functions(analyzed(spark, sf)).select("repo", "path", "ord", "body_preview", "estimated_lines")


@register("classes", O.with_ctes(
    "SELECT repo, path, language, ord, name, line, signature, CAST(len(methods) AS INTEGER) AS method_count FROM cls_t",
    ["cls_t"]))
def q_classes(spark, sf):
    return E.classes(analyzed(spark, sf))


@register("class_methods", O.with_ctes("""
SELECT repo, path, class_ord, CAST(ord AS INTEGER) AS ord, name FROM
 (SELECT repo, path, ord AS class_ord, unnest(methods) AS name, unnest(range(len(methods))) AS ord
  FROM cls_t WHERE len(methods) > 0)""", ["cls_t"]))
def q_class_methods(spark, sf):
    return E.methods(analyzed(spark, sf))


@register("imports", O.with_ctes("SELECT repo, path, language, ord, stmt FROM imp_t", ["imp_t"]))
def q_imports(spark, sf):
    return E.imports(analyzed(spark, sf)).drop("module")


@register("import_modules", O.with_ctes("SELECT repo, path, ord, module FROM imp_t", ["imp_t"]))
def q_import_modules(spark, sf):
    return E.imports(analyzed(spark, sf)).select("repo", "path", "ord", "module")


@register("comments", O.with_ctes("SELECT repo, path, language, ord, text, line, kind FROM cmt_t", ["cmt_t"]))
def q_comments(spark, sf):
    return E.comments(analyzed(spark, sf))


@register("first_imports", O.with_ctes("SELECT repo, path, language, ord, stmt FROM imp_t WHERE ord < 20", ["imp_t"]))
def q_first_imports(spark, sf):
    """The view with the analysed tool's limit of 20 per file."""
    return E.imports(E.first_symbols(analyzed(spark, sf))).drop("module")


@register("first_comments", O.with_ctes("SELECT repo, path, ord, text FROM cmt_t WHERE ord < 10", ["cmt_t"]))
def q_first_comments(spark, sf):
    return E.comments(E.first_symbols(analyzed(spark, sf))).select("repo", "path", "ord", "text")


@register("first_variables", O.with_ctes("""
SELECT repo, path, name FROM var_t QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY name) <= 15""", ["var_t"]))
def q_first_variables(spark, sf):
    return E.variables(E.first_symbols(analyzed(spark, sf))).select("repo", "path", "name")


@register("first_methods", O.with_ctes("""
SELECT repo, path, class_ord, CAST(ord AS INTEGER) AS ord, name FROM
 (SELECT repo, path, ord AS class_ord, unnest(methods[1:5]) AS name, unnest(range(least(len(methods), 5))) AS ord
  FROM cls_t WHERE len(methods) > 0)""", ["cls_t"]))
def q_first_methods(spark, sf):
    return E.methods(E.first_symbols(analyzed(spark, sf)))


@register("variables", O.with_ctes("SELECT repo, path, language, name FROM var_t", ["var_t"]))
def q_variables(spark, sf):
    return E.variables(analyzed(spark, sf))


@register("docstrings", O.with_ctes("SELECT repo, path, ord, text, line, length FROM doc_t", ["doc_t"]))
def q_docstrings(spark, sf):
    return E.docstrings(analyzed(spark, sf))


@register("line_metrics", O.with_ctes(
    "SELECT repo, path, language, total_lines, code_lines, blank_lines, complexity FROM doc_metrics",
    ["doc_metrics"]))
def q_line_metrics(spark, sf):
    """C10 over every document (whole texts)."""
    return E.metrics_only(doc_corpus(spark, sf)).select(
        "repo", "path", "language", "total_lines", "code_lines", "blank_lines", "complexity")


@register("maintainability", O.with_ctes(
    "SELECT repo, path, code_lines, complexity, maintainability_score, maintainability FROM doc_metrics",
    ["doc_metrics"]))
def q_maintainability(spark, sf):
    return E.metrics_only(doc_corpus(spark, sf)).select(
        "repo", "path", "code_lines", "complexity", "maintainability_score", "maintainability")


@register("structure_flags", O.with_ctes("""
SELECT repo, path, has_main, has_tests, has_documentation, indentation_style,
  round(avg_line_length, 6) AS avg_line_length FROM doc_metrics""", ["doc_metrics"]))
def q_structure_flags(spark, sf):
    m = E.metrics_only(doc_corpus(spark, sf))
    return m.select("repo", "path", "has_main", "has_tests", "has_documentation", "indentation_style",
                    F.round("avg_line_length", 6).alias("avg_line_length"))


@register("file_metrics", O.with_ctes("""
SELECT repo, path, language, total_lines, code_lines, blank_lines, complexity, maintainability_score,
  maintainability, has_main, has_tests, has_documentation, indentation_style,
  round(avg_line_length, 6) AS avg_line_length FROM metrics""", ["metrics"]))
def q_file_metrics(spark, sf):
    m = E.file_metrics(analyzed(spark, sf))
    return m.withColumn("avg_line_length", F.round("avg_line_length", 6))


# ---------------------------------------------------------------------------
# Aggregations (D1–D14), joins (E1), rankings
# ---------------------------------------------------------------------------


@register("language_stats", O.with_ctes("""
SELECT repo, language, count(*) AS files, CAST(sum(lines) AS BIGINT) AS total_lines
FROM files GROUP BY ROLLUP (repo, language)""", ["files"]))
def q_language_stats(spark, sf):
    return S.language_stats(corpus(spark, sf))


@register("file_counts", O.with_ctes("SELECT repo, path, language, imports, functions, classes FROM file_counts",
                                     ["file_counts"]))
def q_file_counts(spark, sf):
    return S.file_counts(analyzed(spark, sf))


@register("repo_summary", O.with_ctes(
    "SELECT repo, files, total_functions, total_classes, total_imports, languages FROM facts", ["facts"]))
def q_repo_summary(spark, sf):
    return S.repo_summary(analyzed(spark, sf))


@register("maintainability_dist", O.with_ctes("SELECT repo, high, medium, low FROM facts", ["facts"]))
def q_maintainability_dist(spark, sf):
    return S.maintainability_dist(analyzed(spark, sf))


@register("architecture_patterns", O.with_ctes(
    "SELECT repo, mvc, layered, microservices, monolithic FROM facts", ["facts"]))
def q_architecture_patterns(spark, sf):
    return S.architecture_patterns(analyzed(spark, sf))


@register("test_coverage", O.with_ctes("""
SELECT repo, test_files, regular_files, round(coverage_ratio, 6) AS coverage_ratio, coverage_level FROM facts""",
                                       ["facts"]))
def q_test_coverage(spark, sf):
    return S.test_coverage(analyzed(spark, sf)).withColumn("coverage_ratio", F.round("coverage_ratio", 6))


@register("directory_stats", O.with_ctes("""
SELECT repo, split_part(path, '/', 1) AS directory, count(*) AS files
FROM files WHERE len(string_split(path, '/')) > 1 GROUP BY ALL""", ["files"]))
def q_directory_stats(spark, sf):
    return S.directory_stats(analyzed(spark, sf))


@register("organization", O.with_ctes("""
SELECT repo, depth, directories, files, round(directories / files, 6) AS organization_score FROM
 (SELECT repo, CAST(max(len(string_split(path, '/'))) AS INTEGER) AS depth,
    count(DISTINCT CASE WHEN len(string_split(path, '/')) > 1 THEN split_part(path, '/', 1) END) AS directories,
    count(*) AS files FROM files GROUP BY repo)""", ["files"]))
def q_organization(spark, sf):
    return S.organization(analyzed(spark, sf)).withColumn("organization_score", F.round("organization_score", 6))


@register("directory_tree", O.with_ctes("""
SELECT repo, node, max(depth) AS depth, max(parent) AS parent, bool_or(is_file) AS is_file,
  max(language) AS language, count(*) AS files FROM
 (SELECT repo, CAST(depth AS INTEGER) AS depth, array_to_string(parts[1:depth], '/') AS node,
    array_to_string(parts[1:depth - 1], '/') AS parent, depth = len(parts) AS is_file,
    CASE WHEN depth = len(parts) THEN language END AS language
  FROM (SELECT repo, language, parts, unnest(range(1, len(parts) + 1)) AS depth
        FROM (SELECT repo, language, string_split(path, '/') AS parts FROM files)))
GROUP BY repo, node""", ["files"]))
def q_directory_tree(spark, sf):
    return S.directory_tree(analyzed(spark, sf))


@register("entry_points", O.with_ctes(f"""
SELECT DISTINCT repo, path FROM an WHERE {O._is_entry}""", ["an"]))
def q_entry_points(spark, sf):
    return S.entry_points(analyzed(spark, sf))


@register("recommendations", O.with_ctes("SELECT repo, rule, recommendation FROM recs", ["recs"]))
def q_recommendations(spark, sf):
    return S.recommendations(S.repo_facts(analyzed(spark, sf)))


@register("summary_report", O.with_ctes("""
SELECT repo, metric, value FROM report_wide
UNPIVOT (value FOR metric IN (total_files, languages, functions, classes, architecture_patterns, test_coverage,
                              entry_points, complexity_distribution, recommendations))""", ["report_wide"]))
def q_summary_report(spark, sf):
    return S.summary_report(analyzed(spark, sf))


@register("project_context", O.with_ctes("""
SELECT f.repo, concat_ws(' | ', concat('Project: ', f.repo), concat('Languages: ', coalesce(l.language_list, '[]')),
  concat('Total files: ', total_files), concat('Functions: ', total_functions), concat('Classes: ', total_classes))
  AS context
FROM facts f LEFT JOIN lang_line l USING (repo)""", ["facts", "lang_line"]))
def q_project_context(spark, sf):
    return S.project_context(analyzed(spark, sf))


@register("top_imports", O.with_ctes("""
SELECT repo, CAST(rank AS INTEGER) AS rank, module, uses FROM
 (SELECT repo, module, count(*) AS uses, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, module) AS rank
  FROM imp_t GROUP BY repo, module) WHERE rank <= 10""", ["imp_t"]))
def q_top_imports(spark, sf):
    return DEP.top_imports(analyzed(spark, sf))


@register("topk_imports", O.with_ctes("""
SELECT module, count(*) AS uses FROM imp_t GROUP BY module ORDER BY uses DESC, module LIMIT 10""", ["imp_t"]))
def q_topk_imports(spark, sf):
    return DEP.corpus_top_imports(analyzed(spark, sf))


@register("external_deps", O.with_ctes(f"""
SELECT repo, dependency FROM (SELECT DISTINCT repo, lower(module) AS dependency FROM imp_t
  WHERE regexp_matches(lower(module), {O.sql_str(O.KNOWN_LIBS)}))
QUALIFY row_number() OVER (PARTITION BY repo ORDER BY dependency) <= 10""", ["imp_t"]))
def q_external_deps(spark, sf):
    return DEP.external_deps(analyzed(spark, sf))


@register("internal_deps", O.with_ctes("""
SELECT repo, path, CAST(dep_rank - 1 AS INTEGER) AS ord, module AS dependency FROM
 (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY ord) AS dep_rank FROM dep_edges)
  WHERE dep_rank <= 5) p
WHERE (repo, path) IN (SELECT repo, path FROM (SELECT DISTINCT repo, path FROM dep_edges)
                       QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path) <= 10)""", ["dep_edges"]))
def q_internal_deps(spark, sf):
    return DEP.internal_deps(analyzed(spark, sf))


@register("important_files", O.with_ctes("SELECT repo, rank, path, language, score FROM important", ["important"]))
def q_important_files(spark, sf):
    return RK.important_files(S.file_counts(analyzed(spark, sf)), k=5)


@register("cap_files", O.with_ctes("""
SELECT repo, path FROM files QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path) <= 100""", ["files"]))
def q_cap_files(spark, sf):
    return SRC.cap_files(corpus(spark, sf).select("repo", "path"), 100)


@register("quarantine", """
SELECT source AS repo, concat('doc_', CAST(doc_id AS VARCHAR), '.txt') AS path, strlen(text) AS size_bytes,
  strlen(text) <= 50000 AS kept, CASE WHEN strlen(text) > 50000 THEN 'too_large' END AS skip_reason
FROM documents""")
def q_quarantine(spark, sf):
    docs = doc_corpus(spark, sf).select("repo", "path", "content",
                                        F.octet_length("content").cast("bigint").alias("size_bytes"))
    return SRC.quarantine(docs).select("repo", "path", "size_bytes", "kept", "skip_reason")


_URLS_SQL = """SELECT CASE s_suppkey % 4
    WHEN 0 THEN concat('https://github.com/', lower(n_name), '/', replace(lower(s_name), '#', '-'))
    WHEN 1 THEN concat('git@github.com:', lower(n_name), '/', replace(lower(s_name), '#', '-'), '.git')
    WHEN 2 THEN concat('https://github.com/', lower(n_name), '/', replace(lower(s_name), '#', '-'), '.git')
    ELSE concat('https://gitlab.com/', lower(n_name), '/', replace(lower(s_name), '#', '-')) END AS url
  FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""


@register("repo_registry", """
SELECT DISTINCT url, concat(split_part(s, '/', 1), '/', split_part(s, '/', 2)) AS repo FROM
 (SELECT url, replace(replace(replace(url, 'https://github.com/', ''), 'git@github.com:', ''), '.git', '') AS s
  FROM (""" + _URLS_SQL.replace("{supplier}", "supplier").replace("{nation}", "nation") + """)
  WHERE starts_with(url, 'https://github.com/') OR starts_with(url, 'git@github.com:'))""")
def q_repo_registry(spark, sf):
    """A4 over URLs derived from every supplier (nation is the fixed 25-row TPC-H dimension)."""
    sup = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nat = F.broadcast(table(spark, sf, "nation").select("n_nationkey", "n_name"))
    urls = spark.sql(_URLS_SQL, supplier=sup, nation=nat)
    return SRC.repo_registry(urls)


# ---------------------------------------------------------------------------
# Retrieval (H1–H7): corpus = documents; questions = benchmark items and
# user turns of conversations.
# ---------------------------------------------------------------------------


def kb_documents(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", "source", F.lit("document").alias("type"), "text")


def doc_index(spark, sf) -> RT.Index:
    return shared(spark, sf, "doc_index", lambda: RT.build_index(kb_documents(spark, sf)))


def bench_questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def conv_questions(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role") == "user")
    return c.select((F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("qid"), "text")


@register("ngrams", O.with_ctes("""
SELECT id AS doc_id, CAST(len(k) AS INTEGER) AS tokens, CAST(greatest(len(k) - 1, 0) AS INTEGER) AS bigrams,
  CAST(len(list_distinct(list_concat(k, list_transform(range(1, len(k)), lambda i: concat(k[i], ' ', k[i + 1])))))
       AS INTEGER) AS distinct_terms
FROM d_tok""", ["d_tok"]))
def q_ngrams(spark, sf):
    return RT.token_stats(documents(spark, sf))


@register("vocabulary", O.with_ctes("SELECT term, df, total, round(idf, 6) AS idf FROM vocab", ["vocab"]))
def q_vocabulary(spark, sf):
    return doc_index(spark, sf).vocab.withColumn("idf", F.round("idf", 6))


@register("doc_norms", O.with_ctes("SELECT doc_id, round(norm, 6) AS norm FROM d_norm", ["d_norm"]))
def q_doc_norms(spark, sf):
    return doc_index(spark, sf).norms.select("doc_id", F.round("norm", 6).alias("norm"))


@register("search", O.with_ctes("SELECT qid, doc_id, rank, round(score, 6) AS score FROM bq_hits", ["bq_hits"]))
def q_search(spark, sf):
    hits = RT.search(doc_index(spark, sf), bench_questions(spark, sf))
    return hits.withColumn("score", F.round("score", 6))


@register("answers", O.answers_sql("cq", "SELECT concat_ws(':', conv_id, turn) AS qid FROM conversations WHERE role = 'user'"))
def q_answers(spark, sf):
    return RT.answers(doc_index(spark, sf), conv_questions(spark, sf))


@register("answer_sources", O.with_ctes(
    "SELECT qid, rank, doc_id, source, type, round(score, 6) AS confidence FROM cq_top3", ["cq_top3"]))
def q_answer_sources(spark, sf):
    s = RT.answer_sources(doc_index(spark, sf), conv_questions(spark, sf))
    return s.withColumn("confidence", F.round("confidence", 6))


@register("answer_context", O.context_sql("bq"))
def q_answer_context(spark, sf):
    return RT.answer_context(doc_index(spark, sf), bench_questions(spark, sf))


@register("answer_prompts", O.prompts_sql("bq", "SELECT item_id AS qid, text AS question FROM benchmark"))
def q_answer_prompts(spark, sf):
    return RT.answer_prompts(doc_index(spark, sf), bench_questions(spark, sf))


# ---------------------------------------------------------------------------
# Documentation tables (D15–D18) and knowledge base (F1)
# ---------------------------------------------------------------------------


@register("api_surface", O.with_ctes("SELECT repo, kind, ord, path, name, signature FROM api", ["api"]))
def q_api_surface(spark, sf):
    return DOC.api_surface(analyzed(spark, sf))


@register("file_digest", O.with_ctes("SELECT repo, path, language, digest FROM digest", ["digest"]))
def q_file_digest(spark, sf):
    return DOC.file_digest(analyzed(spark, sf))


@register("file_docs", O.with_ctes("SELECT repo, path, doc_path, text FROM file_docs", ["file_docs"]))
def q_file_docs(spark, sf):
    return DOC.file_docs(analyzed(spark, sf))


@register("doc_index", O.with_ctes("SELECT repo, doc_path, text FROM doc_index", ["doc_index"]))
def q_doc_index(spark, sf):
    return DOC.doc_index(analyzed(spark, sf))


@register("file_prompts", O.with_ctes("SELECT repo, path, prompt FROM file_prompts", ["file_prompts"]))
def q_file_prompts(spark, sf):
    return DOC.file_prompts(analyzed(spark, sf))


def knowledge_base(spark, sf) -> DataFrame:
    """The code corpus's knowledge base, written once per session (it feeds
    both the kb_docs report and the per-repository index)."""
    return shared(spark, sf, "kb_docs", lambda: written(DOC.kb_docs(analyzed(spark, sf)), "kb-docs"))


@register("kb_docs", O.with_ctes("SELECT doc_id, repo, type, source, category, language, text FROM kb_docs",
                                 ["kb_docs"]))
def q_kb_docs(spark, sf):
    return knowledge_base(spark, sf)


# ---------------------------------------------------------------------------
# Snapshots and change detection
# ---------------------------------------------------------------------------


_NEXT_CORPUS_SQL = """
SELECT repo, path, CASE WHEN starts_with(path, 'api/') THEN concat(content, chr(10), '// touched') ELSE content END
  AS content FROM files WHERE NOT starts_with(path, 'tests/')
UNION ALL
SELECT repo, replace(path, 'core/util/', 'core/v2/') AS path, content FROM files WHERE starts_with(path, 'core/util/')"""


def next_corpus(files: DataFrame) -> DataFrame:
    """A later version of the corpus: tests removed, api files edited, core
    utilities copied to a new folder (derived from the corpus itself)."""
    kept = files.where(~F.startswith("path", F.lit("tests/"))).select(
        "repo", "path", "language", F.when(F.startswith("path", F.lit("api/")), F.concat(
            "content", F.lit("\n// touched"))).otherwise(F.col("content")).alias("content"))
    added = files.where(F.startswith("path", F.lit("core/util/"))).select(
        "repo", F.replace("path", F.lit("core/util/"), F.lit("core/v2/")).alias("path"), "language", "content")
    return corpus_from_table(kept.unionByName(added))


@register("changed_files", O.with_ctes(f"""
SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.path, o.path) AS path,
  CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM (SELECT repo, path, sha256(content) AS h FROM ({_NEXT_CORPUS_SQL})) n
FULL OUTER JOIN (SELECT repo, path, sha256(content) AS h FROM files) o ON n.repo = o.repo AND n.path = o.path
WHERE o.h IS NULL OR n.h IS NULL OR n.h <> o.h""", ["files"]))
def q_changed_files(spark, sf):
    old = corpus(spark, sf)
    return SNAP.changed_files(next_corpus(old), old)


def kb_index(spark, sf) -> RT.Index:
    """One knowledge base per repository, built once per session."""
    return shared(spark, sf, "kb_index", lambda: RT.build_index(knowledge_base(spark, sf), group="repo"))


def kb_questions(analyzed_df: DataFrame) -> DataFrame:
    """Questions about each repository's own API, derived from its API surface."""
    api = DOC.api_surface(analyzed_df).where(F.col("kind") != "none")
    return api.select("repo", F.concat_ws(":", "repo", "kind", F.col("ord").cast("string")).alias("qid"),
                      F.concat(F.lit("What does the "), F.col("kind"), F.lit(" "), F.col("name"), F.lit(" do?"))
                      .alias("text"))


@register("kb_search", O.with_ctes("SELECT repo, qid, doc_id, rank, round(score, 6) AS score FROM kb_hits",
                                   ["kb_hits"]))
def q_kb_search(spark, sf):
    """H5 over one knowledge base per repository (the analysed tool's own use)."""
    hits = RT.search(kb_index(spark, sf), kb_questions(analyzed(spark, sf)))
    return hits.withColumn("score", F.round("score", 6))


@register("api_prompts", O.with_ctes("SELECT repo, prompt FROM api_prompts", ["api_prompts"]))
def q_api_prompts(spark, sf):
    return DOC.api_prompts(analyzed(spark, sf))


@register("summary_markdown", O.with_ctes("SELECT repo, text FROM summary_md", ["summary_md"]))
def q_summary_markdown(spark, sf):
    return S.summary_markdown(analyzed(spark, sf))


@register("repo_prompts", O.with_ctes("SELECT repo, overview_prompt, setup_prompt FROM repo_prompts",
                                      ["repo_prompts"]))
def q_repo_prompts(spark, sf):
    return DOC.repo_prompts(analyzed(spark, sf))


@register("directory_tree_text", O.with_ctes("SELECT repo, tree FROM tree", ["tree"]))
def q_directory_tree_text(spark, sf):
    return DOC.tree_text(analyzed(spark, sf))


@register("repo_readme", O.with_ctes("SELECT repo, doc_path, text FROM readme", ["readme"]))
def q_repo_readme(spark, sf):
    return DOC.repo_readme(analyzed(spark, sf))


def documented_functions(spark, sf) -> DataFrame:
    """A Python corpus derived from ``documents``: one function per document
    whose docstring is the whole document text."""
    d = documents(spark, sf)
    content = F.concat(F.lit("def doc_"), F.col("doc_id").cast("string"), F.lit('():\n    """'), F.col("text"),
                       F.lit('"""\n    return None\n'))
    return corpus_from_table(d.select(F.col("source").alias("repo"),
                                      F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
                                      F.lit("python").alias("language"), content.alias("content")))


@register("doc_docstrings", O.with_ctes("SELECT repo, path, ord, text, line, length FROM pydoc_t", ["pydoc_t"]))
def q_doc_docstrings(spark, sf):
    """C9 over whole real texts (up to ~128K characters each)."""
    return E.docstrings(E.analyze(documented_functions(spark, sf)))


@register("doc_suite", O.with_ctes("SELECT repo, doc_path, text FROM doc_suite", ["doc_suite"]))
def q_doc_suite(spark, sf):
    return DOC.doc_suite(analyzed(spark, sf))


# ---------------------------------------------------------------------------
# Rules of all twelve languages, unreadable files, refresh, uncapped edges, index tables
# ---------------------------------------------------------------------------


@register("language_symbols", O.snippet_symbols_sql())
def q_language_symbols(spark, sf):
    """C1/C3 on one snippet per language, dealt over the rows of ``part``."""
    text = F.array(*[F.lit(s[1]) for s in O.SNIPPETS])
    lang = F.array(*[F.lit(s[0]) for s in O.SNIPPETS])
    at = (F.col("p_partkey") % len(O.SNIPPETS)).cast("int")
    files = table(spark, sf, "part").select(
        F.lit("parts").alias("repo"), F.col("p_partkey").cast("string").alias("path"),
        F.get(lang, at).alias("language"), F.get(text, at).alias("content"))
    done = E.analyze(corpus_from_table(files))
    shape = lambda view, kind: view.select("path", "language", F.lit(kind).alias("kind"), "ord", "name", "line")
    return shape(E.functions(done), "function").unionByName(shape(E.classes(done), "class"))


def partly_unreadable(files: DataFrame, folder: str) -> DataFrame:
    return files.withColumn("content", F.when(~F.startswith("path", F.lit(folder)), F.col("content")))


@register("valid_files", O.with_ctes("SELECT repo, path FROM files WHERE NOT starts_with(path, 'api/')", ["files"]))
def q_valid_files(spark, sf):
    """B3 on a corpus whose api files can't be read."""
    return SRC.valid(E.analyze(partly_unreadable(corpus(spark, sf), "api/"))).select("repo", "path")


@register("refresh", O.with_ctes(f"""
SELECT repo, path, CASE WHEN starts_with(path, 'web/') THEN NULL ELSE CAST(length(content) AS BIGINT) END AS size
FROM ({_NEXT_CORPUS_SQL})""", ["files"]))
def q_refresh(spark, sf):
    """The later corpus, with folders that can't be read before or after, from the earlier results."""
    sizes = lambda files: files.select("repo", "path", F.length("content").cast("bigint").alias("size"))
    old = partly_unreadable(corpus(spark, sf), "core/")
    new = partly_unreadable(next_corpus(corpus(spark, sf)), "web/")
    return SNAP.refresh(new, sizes(old), old, sizes)


@register("internal_dep_edges", O.with_ctes("SELECT repo, path, ord, module FROM dep_edges", ["dep_edges"]))
def q_internal_dep_edges(spark, sf):
    return DEP.internal_dep_edges(analyzed(spark, sf)).select("repo", "path", "ord", "module")


@register("postings", O.with_ctes("SELECT doc_id, term, round(weight, 6) AS weight FROM postings", ["postings"]))
def q_postings(spark, sf):
    return doc_index(spark, sf).postings.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@register("ngram_terms", O.with_ctes("""
SELECT id AS doc_id, count(*) AS terms, md5(string_agg(concat(term, '=', tf), chr(10) ORDER BY term)) AS terms_md5
FROM d_tf GROUP BY id""", ["d_tf"]))
def q_ngram_terms(spark, sf):
    """H1: every term of a document with its count, as one digest.

    The texts are dealt by document, not the terms, which take several times their room: the terms of a document are
    counted where its text is, and one row a text is grouped there.
    """
    texts = documents(spark, sf).repartition("doc_id")
    each = F.transform("t", lambda t: F.struct(t["term"].alias("term"), F.concat(t["term"], F.lit("="), t["tf"].cast("string")).alias("e")))
    whole = RT.document_terms(texts).groupBy("doc_id").agg(F.flatten(F.collect_list(each)).alias("t"))
    whole = whole.where(F.size("t") > 0).select("doc_id", F.sort_array("t").alias("t"))
    return whole.select("doc_id", F.size("t").cast("bigint").alias("terms"), F.md5(F.array_join(F.transform(
        "t", lambda s: s["e"]), "\n").cast("binary")).alias("terms_md5"))


# ---------------------------------------------------------------------------
# Files on storage: scan, skipped files, stream, a registered language; repository metadata; saved outputs
# ---------------------------------------------------------------------------

#: The documents' language as files: "names" are words on -ing or -er before a space, "comments" runs of digits.
PROSE = LanguageRules().register("prose", [".txt"], function=r"([A-Za-z]+(?:ing|er)) ", comment=r"[0-9]{4,}[^\n]*")
TREE_MAX_BYTES = 20_000


def file_tree(spark, sf) -> str:
    """The documents as text files under one folder, written once a session."""
    return shared(spark, sf, "file_tree", lambda: document_tree(documents(spark, sf), new_path(spark, "file-tree")))


def tree_files(spark, sf) -> DataFrame:
    return shared(spark, sf, "tree_files", lambda: SRC.scan_with_skipped(spark, file_tree(spark, sf), repo_depth=1, rules=PROSE))[0]


def _folder(path: str = "path"):
    """A file's folder; the name that Spark's writer gave it is left out."""
    return F.substring_index(path, "/", 1).alias("path")


@register("scan_corpus", O.with_ctes("""
SELECT repo, path, language, CAST(length(content) AS BIGINT) AS size,
  CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS BIGINT) AS lines, md5(content) AS content_md5
FROM tree_files""", ["tree_files"]))
def q_scan_corpus(spark, sf):
    """A1: a recursive scan of files on storage."""
    return tree_files(spark, sf).select("repo", _folder(), "language", "size", "lines", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@register("skipped_files", O.with_ctes(f"""
SELECT repo, path, CAST(strlen(raw) AS BIGINT) AS size_bytes, 'too_large' AS skip_reason FROM tree_raw WHERE strlen(raw) > {TREE_MAX_BYTES}""", ["tree_raw"]))
def q_skipped_files(spark, sf):
    """B2 of a scan with a size limit (nothing in this tree is unreadable)."""
    skipped = SRC.skipped_files(spark, file_tree(spark, sf), repo_depth=1, rules=PROSE, max_bytes=TREE_MAX_BYTES)
    return skipped.select("repo", _folder(), "size_bytes", "skip_reason")


@register("language_subset", O.with_ctes(
    "SELECT repo, path, language, size FROM files WHERE language IN ('python', 'go')", ["files"]))
def q_language_subset(spark, sf):
    """B4."""
    return SRC.select_languages(corpus(spark, sf), ["python", "go"]).select("repo", "path", "language", "size")


@register("registered_language", O.with_ctes(
    "SELECT repo, path, ord, name, line FROM prose_t", ["prose_t"]))
def q_registered_language(spark, sf):
    """The functions of a language registered with patterns of its own."""
    found = E.functions(E.analyze(tree_files(spark, sf), PROSE))
    return found.select("repo", _folder(), "ord", "name", "line")


@register("stream_metrics", O.with_ctes("""
SELECT repo, path, language, total_lines, code_lines, blank_lines, complexity, maintainability FROM tree_metrics""", ["tree_metrics"]))
def q_stream_metrics(spark, sf):
    """The file stream over the same tree, in micro-batches, all of it available now."""
    out = new_path(spark, "stream")
    ingest_stream(spark, file_tree(spark, sf), f"{out}/out", f"{out}/state", repo_depth=1, rules=PROSE,
                  max_files_per_trigger=2_000).awaitTermination()
    return read_output(spark, f"{out}/out", "file_metrics").select(
        "repo", _folder(), "language", "total_lines", "code_lines", "blank_lines", "complexity", "maintainability")


def repo_infos(spark, sf) -> DataFrame:
    return SRC.load_repo_info(api_responses(spark, spread(table(spark, sf, "part"), "p_partkey")))


@register("repo_info", """
SELECT concat('repo', k) AS repo, name, description, language, stars, forks, size FROM (
  SELECT p_partkey % 23 AS k, concat('Name ', p_partkey % 23) AS name,
    CASE WHEN p_partkey % 23 % 3 = 0 THEN NULL ELSE concat('About ', max(p_name)) END AS description, 'go' AS language,
    count(*) AS stars, CAST(sum(p_size) AS BIGINT) AS forks, CAST(0 AS BIGINT) AS size
  FROM part GROUP BY p_partkey % 23) WHERE k % 5 <> 4""")
def q_repo_info(spark, sf):
    """A3: metadata from API responses; those that aren't 200 have none."""
    return repo_infos(spark, sf).select("repo", "name", "description", "language", "stars", "forks", "size")


@register("project_context_info", O.with_ctes("SELECT repo, context FROM context_info", ["context_info"]))
def q_project_context_info(spark, sf):
    """E5: the analysis joined with repository metadata."""
    return S.project_context(analyzed(spark, sf), repo_infos(spark, sf))


@register("search_reloaded", O.with_ctes("SELECT qid, doc_id, rank, round(score, 6) AS score FROM bq_hits", ["bq_hits"]))
def q_search_reloaded(spark, sf):
    """The index saved and loaded again."""
    path = new_path(spark, "saved-index")
    doc_index(spark, sf).save(path)
    hits = RT.search(RT.Index.load(spark, path), bench_questions(spark, sf))
    return hits.withColumn("score", F.round("score", 6))


@register("saved_docs", O.with_ctes("SELECT repo, doc_path FROM doc_suite", ["doc_suite"]))
def q_saved_docs(spark, sf):
    """The paths of the documents written."""
    return SNAP.write_docs(DOC.doc_suite(analyzed(spark, sf)), new_path(spark, "docs"))


@register("repo_readme_info", O.with_ctes("SELECT repo, doc_path, text FROM readme_info", ["readme_info"]))
def q_repo_readme_info(spark, sf):
    """D17 with names and descriptions from the repositories' metadata (E5)."""
    return DOC.repo_readme(analyzed(spark, sf), repos=repo_infos(spark, sf))


@register("repo_prompts_info", O.with_ctes("SELECT repo, overview_prompt, setup_prompt FROM repo_prompts_info", ["repo_prompts_info"]))
def q_repo_prompts_info(spark, sf):
    """D18 with names and descriptions from the repositories' metadata (E5)."""
    return DOC.repo_prompts(analyzed(spark, sf), repo_infos(spark, sf))


@register("directory_tree_lines", O.with_ctes("SELECT repo, first_path, depth, line FROM whole_lines", ["whole_lines"]))
def q_directory_tree_lines(spark, sf):
    """The drawn tree of whole repositories."""
    return DOC.tree_lines(analyzed(spark, sf))


@register("kb_answer_prompts", O.with_ctes("SELECT repo, qid, prompt, confidence FROM kb_answer_prompts", ["kb_answer_prompts"]))
def q_kb_answer_prompts(spark, sf):
    """The whole prompt of each question about a repository, with that repository's context."""
    context = S.project_context(analyzed(spark, sf), repo_infos(spark, sf))
    return RT.answer_prompts(kb_index(spark, sf), kb_questions(analyzed(spark, sf)), project_context=context)


@register("index_by_steps", O.with_ctes("SELECT doc_id, term, round(weight, 6) AS weight FROM left_post", ["left_post"]))
def q_index_by_steps(spark, sf):
    """Documents added in two steps, some replaced, some deleted; the postings are those of an index built anew."""
    docs, store = kb_documents(spark, sf), IndexStore(spark, new_path(spark, "index-store"))
    store.apply(added=docs.where("doc_id % 3 <> 0"))
    store.apply(added=docs.where("doc_id % 3 = 0 OR doc_id % 5 = 0"))
    store.apply(deleted=docs.where("doc_id % 7 = 3"))
    return store.load().postings.select("doc_id", "term", F.round("weight", 6).alias("weight"))
