"""Independent DuckDB formulations of the registered queries.

The SQL is generated from the same rule tables as the Spark jobs, but it
computes positions with window running sums over unnested matches (the Spark
side uses in-row array folds), so the two are separate derivations of the
same contract.  Each query is a chain of named CTEs; ``with_ctes`` pulls in
only the CTEs a final SELECT needs.
"""

from __future__ import annotations

import re

from ..functions.exprs import render_sql, sql_str, NON_WS
from ..functions.rules import (
    API_PAGE_TEMPLATE, ARCHITECTURE_PAGE_TEMPLATE, FILE_PAGE_TEMPLATE, SETUP_PAGE_TEMPLATE, SETUP_TEXT_TEMPLATE,
    ANSWER_HEADER, ANSWER_PROMPT_TEMPLATE, API_CLASS_BLOCK, API_FUNCTION_BLOCK, API_PROMPT_TEMPLATE, BODY_PREVIEW_CHARS,
    CONFIG_PATH_WORDS, CONTROL_KEYWORDS, CONTROL_NAME_LANGUAGES, DEFAULT_RULES,
    DOCSTRING_PATTERN, DOC_BLOCK_PATTERN, ENTRY_POINT_WORDS, EXTERNAL_LIBRARIES, FILE_DOC_TEMPLATE,
    FILE_INDEX_ENTRY, FILE_INDEX_TEMPLATE, FILE_PROMPT_TEMPLATE, IMPORTANT_PATH_WORDS,
    LAYERED_INDICATORS, MICROSERVICE_INDICATORS, MONOLITH_MIN_FILES,
    MVC_INDICATORS, NOT_FUNCTION_NAMES, NO_ANSWER_TEXT, NO_API_TEXT, NO_CLASSES_LINE, NO_DESCRIPTION,
    NO_FUNCTIONS_LINE, NO_PATTERNS_LINE, OVERVIEW_PROMPT_TEMPLATE, PROMPT_ENTRY_POINTS_CAP,
    PY_WHITESPACE, README_DESCRIPTION, README_TEMPLATE, RECOMMENDATIONS, SETUP_PROMPT_TEMPLATE, SUMMARY_TEMPLATE, TREE_BRANCH, TREE_LAST, TREE_PIPE, TREE_SPACE,
    TEST_CONTENT_WORDS, TEST_PATH_WORDS,
)
from ..operators.docs import DEFAULT_GENERATED_ON, REPORT_LABELS
from ..functions.stopwords import ENGLISH_STOP_WORDS
from ..operators.retrieval import MAX_DF, MAX_FEATURES, TOKEN_PATTERN
from ..sources.fixtures import CODE_FILES_SELECT

R = DEFAULT_RULES
NL = "chr(10)"


def _groups(p: str) -> int:
    return re.compile(p).groups


def nl(x: str) -> str:
    return f"(length({x}) - length(replace({x}, {NL}, '')))"


def strip(x: str) -> str:
    return (f"regexp_replace(regexp_replace({x}, {sql_str('^' + PY_WHITESPACE + '+')}, ''), "
            f"{sql_str(PY_WHITESPACE + '+$')}, '')")


def has_text(x: str) -> str:
    return f"regexp_matches({x}, {sql_str(NON_WS)})"


def in_list(x: str, words: list[str]) -> str:
    return f"{x} IN ({', '.join(sql_str(w) for w in words)})"


def contains_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {sql_str(w)})" for w in words) + ")"


def case_lang(table: dict[str, str], fmt, default: str) -> str:
    parts = [f"WHEN {sql_str(l)} THEN {fmt(p)}" for l, p in table.items()]
    return f"CASE language {' '.join(parts)} ELSE {default} END"


def case_suffix(path: str) -> str:
    name = f"regexp_extract({path}, '([^/]*)$', 1)"
    suf = f"regexp_extract({name}, '^.+?([.][^.]+)$', 1)"
    return "CASE " + " ".join(f"WHEN {suf} = {sql_str(s)} THEN {sql_str(l)}"
                              for s, l in R.suffixes.items()) + " END"


CTES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, sql: str, deps: list[str]) -> None:
    CTES[name] = (sql, deps)


def with_ctes(final: str, needed: list[str]) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in needed:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order) + "\n" + final


# ---------------------------------------------------------------------------
# Corpus
# ---------------------------------------------------------------------------

cte("code_files_raw", CODE_FILES_SELECT.replace("{part}", "part"), [])
cte("files", f"""SELECT repo, path, path AS full_path, language, content,
  CAST(length(content) AS BIGINT) AS size, CAST({nl('content')} + 1 AS BIGINT) AS lines
  FROM code_files_raw""", ["code_files_raw"])


def _positioned(job: str, table: dict[str, str], src: str = "files") -> None:
    """``{job}_pos``: one row per match with i (0-based), m, g1, g2, start, line."""
    empty = "CAST([] AS VARCHAR[])"
    ms = case_lang(table, lambda p: f"regexp_extract_all(content, {sql_str(p)}, 0)", empty)
    segs = case_lang(table, lambda p: f"regexp_split_to_array(content, {sql_str(p)})", empty)
    g1 = case_lang(table, lambda p: f"regexp_extract_all(content, {sql_str(p)}, {min(_groups(p), 1)})", empty)
    g2 = case_lang(table, lambda p: f"regexp_extract_all(content, {sql_str(p)}, {min(_groups(p), 2)})", empty)
    cte(f"{job}_arr", f"SELECT repo, path, language, content, {ms} AS ms, {segs} AS segs, "
                      f"{g1} AS g1s, {g2} AS g2s FROM {src}", [src])
    cte(f"{job}_u", f"""SELECT repo, path, language, content, unnest(ms) AS m, unnest(segs[1:len(ms)]) AS seg,
      unnest(g1s) AS g1, unnest(g2s) AS g2, unnest(range(len(ms))) AS i
      FROM {job}_arr WHERE len(ms) > 0""", [f"{job}_arr"])
    cte(f"{job}_pos", f"""SELECT repo, path, language, content, m, g1, g2, i,
      CAST(sum(length(seg)) OVER wi + coalesce(sum(length(m)) OVER wx, 0) AS INTEGER) AS start,
      CAST(1 + sum({nl('seg')}) OVER wi + coalesce(sum({nl('m')}) OVER wx, 0) AS INTEGER) AS line
      FROM {job}_u
      WINDOW wi AS (PARTITION BY repo, path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             wx AS (PARTITION BY repo, path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        [f"{job}_u"])


_positioned("fn", R.functions)
_positioned("cls", R.classes)
_positioned("cmt", R.comments)
_positioned("doc", {"python": DOCSTRING_PATTERN})

_kw = ", ".join(sql_str(k) for k in NOT_FUNCTION_NAMES)
_cl = ", ".join(sql_str(k) for k in CONTROL_NAME_LANGUAGES)
cte("fn_named", f"""SELECT *, coalesce(nullif(g1, ''), nullif(g2, '')) AS name FROM fn_pos""", ["fn_pos"])
cte("fn_t", f"""SELECT repo, path, language, content, name, line, {strip('m')} AS signature,
  start + length(m) AS end0, line + {nl('m')} AS end_line, suffix(m, '{{') AS opens,
  CAST(row_number() OVER (PARTITION BY repo, path ORDER BY i) - 1 AS INTEGER) AS ord
  FROM fn_named WHERE name IS NOT NULL AND NOT starts_with(name, '_') AND NOT (language IN ({_cl}) AND name IN ({_kw}))""",
    ["fn_named"])

# Function bodies: Python by indentation, other languages by brace depth.
_ws_star = sql_str("^" + PY_WHITESPACE + "*")
cte("fn_body_py", f"""SELECT repo, path, ord, cand,
  list_filter(range(1, len(cand) + 1), lambda j: {has_text('cand[j]')}) AS nb
  FROM (SELECT repo, path, ord,
     list_concat([split_part(substr(content, end0 + 1, length(string_split(content, {NL})[end_line]) + 1), {NL}, 1)],
                 string_split(content, {NL})[end_line + 1:]) AS cand
     FROM fn_t WHERE language = 'python')""", ["fn_t"])
cte("fn_body_py2", f"""SELECT repo, path, ord, cand, nb,
  list_filter(nb, lambda j: j > nb[1] AND length(regexp_extract(cand[j], {_ws_star}))
                              < length(regexp_extract(cand[nb[1]], {_ws_star}))) AS stops
  FROM fn_body_py""", ["fn_body_py"])
cte("fn_body", f"""SELECT repo, path, ord,
  array_to_string(cand[1:CASE WHEN len(stops) > 0 THEN stops[1] - 1 ELSE len(cand) END], {NL}) AS body
  FROM fn_body_py2
  UNION ALL
  SELECT repo, path, ord,
    CASE WHEN cut IS NULL THEN w ELSE substr(w, 1, cut) END AS body
  FROM (SELECT repo, path, ord, w,
          list_filter(range(1, length(w) + 1), lambda j: substr(w, j, 1) = '}}'
             AND d0 + (j - length(replace(substr(w, 1, j), '{{', ''))) - (j - length(replace(substr(w, 1, j), '}}', ''))) = 0)[1] AS cut
        FROM (SELECT repo, path, ord, substr(content, end0 + 1) AS w,
                CASE WHEN opens THEN 1 ELSE 0 END AS d0
              FROM fn_t WHERE language <> 'python'))""", ["fn_body_py2", "fn_t"])

# Classes and their methods.
_mt = {l: R.method_pattern(l) for l in R.classes if R.method_pattern(l)}
_m1 = case_lang(_mt, lambda p: f"regexp_extract_all(w, {sql_str(p)}, 1)", "CAST([] AS VARCHAR[])")
_m2 = case_lang(_mt, lambda p: (f"regexp_extract_all(w, {sql_str(p)}, 2)" if _groups(p) >= 2
                                else f"regexp_extract_all(w, {sql_str(p)}, 1)"), "CAST([] AS VARCHAR[])")
cte("cls_t", f"""SELECT repo, path, language, CAST(i AS INTEGER) AS ord, g1 AS name, line,
  {strip('m')} AS signature,
  list_filter(list_transform(range(1, len(m1) + 1), lambda j: coalesce(nullif(m1[j], ''), nullif(m2[j], ''))),
              lambda n: n IS NOT NULL AND NOT (language IN ({_cl}) AND n IN ({_kw}))) AS methods
  FROM (SELECT *, {_m1} AS m1, {_m2} AS m2
        FROM (SELECT *, substr(content, start + length(m) + 1, coalesce(
                lead(start) OVER (PARTITION BY repo, path ORDER BY i), length(content)) - start - length(m)) AS w FROM cls_pos))""",
    ["cls_pos"])

# Imports: stripped, non-empty.
_imp = case_lang(R.imports, lambda p: f"regexp_extract_all(content, {sql_str(p)}, 0)", "CAST([] AS VARCHAR[])")
cte("imp_arr", f"""SELECT repo, path, language,
  list_filter(list_transform({_imp}, lambda s: {strip('s')}), lambda s: length(s) > 0) AS stmts
  FROM files""", ["files"])


def module_sql(x: str) -> str:
    s = strip(x)
    parts = f"regexp_split_to_array({s}, {sql_str(PY_WHITESPACE + '+')})"
    return f"""(CASE WHEN length({s}) = 0 THEN {s}
      WHEN starts_with({s}, 'from') AND len({parts}) >= 2 THEN {parts}[2]
      WHEN starts_with({s}, 'import') AND len({parts}) >= 2 THEN split_part({parts}[2], '.', 1)
      WHEN starts_with({s}, 'from') OR starts_with({s}, 'import') THEN {parts}[1]
      WHEN starts_with({s}, '#include') THEN
        CASE WHEN contains({s}, '<') THEN split_part(split_part({s}, '<', 2), '>', 1)
             WHEN contains({s}, '"') THEN split_part({s}, '"', 2) ELSE {s} END
      ELSE {parts}[1] END)"""


cte("imp_t", f"""SELECT repo, path, language, CAST(ord AS INTEGER) AS ord, stmt, {module_sql('stmt')} AS module
  FROM (SELECT repo, path, language, unnest(stmts) AS stmt, unnest(range(len(stmts))) AS ord
        FROM imp_arr WHERE len(stmts) > 0)""", ["imp_arr"])

# Comments: stripped text longer than 3.
cte("cmt_t", f"""SELECT repo, path, language, CAST(row_number() OVER (PARTITION BY repo, path ORDER BY i) - 1 AS INTEGER) AS ord,
  text, line, CASE WHEN starts_with(text, '/*') THEN 'multi' ELSE 'single' END AS kind
  FROM (SELECT repo, path, language, i, line, {strip('m')} AS text FROM cmt_pos)
  WHERE length(text) > 3""", ["cmt_pos"])

# Variables: distinct, not '_'-prefixed, sorted.
_v1 = case_lang(R.variables, lambda p: f"regexp_extract_all(content, {sql_str(p)}, 1)", "CAST([] AS VARCHAR[])")
_v2 = case_lang(R.variables, lambda p: (f"regexp_extract_all(content, {sql_str(p)}, 2)" if _groups(p) >= 2
                                        else f"regexp_extract_all(content, {sql_str(p)}, 1)"), "CAST([] AS VARCHAR[])")
cte("var_t", f"""SELECT repo, path, language, unnest(names) AS name FROM (
  SELECT repo, path, language,
    list_sort(list_distinct(list_filter(
      list_transform(range(1, len(v1) + 1), lambda j: coalesce(nullif(v1[j], ''), nullif(v2[j], ''))),
      lambda n: n IS NOT NULL AND NOT starts_with(n, '_')))) AS names
  FROM (SELECT *, {_v1} AS v1, {_v2} AS v2 FROM files))""", ["files"])

# Docstrings (Python).
cte("doc_t", f"""SELECT repo, path, CAST(row_number() OVER (PARTITION BY repo, path ORDER BY i) - 1 AS INTEGER) AS ord,
  text, line, CAST(length(text) AS INTEGER) AS length
  FROM (SELECT repo, path, i, line, {strip("coalesce(nullif(g1, ''), nullif(g2, ''))")} AS text FROM doc_pos)
  WHERE coalesce(length(text), 0) > 10""", ["doc_pos"])

# Metrics (C10–C12).
_tokens = "regexp_extract_all(content, '[\\p{L}\\p{N}_]+')"
cte("metrics_base", f"""SELECT repo, path, language,
  CAST(len(string_split(content, {NL})) AS INTEGER) AS total_lines,
  CAST(len(list_filter(string_split(content, {NL}), lambda l: {has_text('l')})) AS INTEGER) AS code_lines,
  CAST(len(list_filter({_tokens}, lambda t: {in_list('t', CONTROL_KEYWORDS)})) AS INTEGER) AS complexity,
  contains(lower(content), 'main') AS has_main,
  {contains_any('lower(content)', TEST_CONTENT_WORDS)} AS has_tests,
  regexp_matches(content, {sql_str(DOC_BLOCK_PATTERN)}) AS has_documentation,
  CASE WHEN contains(content, chr(9)) THEN 'tabs' ELSE 'spaces' END AS indentation_style,
  length(content) AS n_chars
  FROM {{src}}""", [])


def metrics_cte(name: str, src: str) -> None:
    sql, _ = CTES["metrics_base"]
    cte(name + "_0", sql.replace("{src}", src), [src])
    cte(name, f"""SELECT repo, path, language, total_lines, code_lines,
      total_lines - code_lines AS blank_lines, complexity,
      CAST(greatest(0, 100 - code_lines // 10 - 3 * complexity) AS INTEGER) AS maintainability_score,
      CASE WHEN greatest(0, 100 - code_lines // 10 - 3 * complexity) >= 80 THEN 'High'
           WHEN greatest(0, 100 - code_lines // 10 - 3 * complexity) >= 60 THEN 'Medium' ELSE 'Low' END AS maintainability,
      has_main, has_tests, has_documentation, indentation_style,
      (n_chars - (total_lines - 1)) / total_lines AS avg_line_length
      FROM {name}_0""", [name + "_0"])


metrics_cte("metrics", "files")
cte("doc_files", """SELECT source AS repo, concat('doc_', CAST(doc_id AS VARCHAR), '.txt') AS path,
  lang AS language, text AS content FROM documents""", [])
metrics_cte("doc_metrics", "doc_files")

# Per-file counts (D11), kept for every file including zero counts.
cte("file_counts", """SELECT f.repo, f.path, f.language,
  CAST(coalesce(i.n, 0) AS INTEGER) AS imports, CAST(coalesce(fn.n, 0) AS INTEGER) AS functions,
  CAST(coalesce(c.n, 0) AS INTEGER) AS classes
  FROM files f
  LEFT JOIN (SELECT repo, path, count(*) AS n FROM imp_t GROUP BY ALL) i USING (repo, path)
  LEFT JOIN (SELECT repo, path, count(*) AS n FROM fn_t GROUP BY ALL) fn USING (repo, path)
  LEFT JOIN (SELECT repo, path, count(*) AS n FROM cls_t GROUP BY ALL) c USING (repo, path)""",
    ["files", "imp_t", "fn_t", "cls_t"])

PREVIEW = BODY_PREVIEW_CHARS

# ---------------------------------------------------------------------------
# Per-repository aggregations, dependencies, rankings
# ---------------------------------------------------------------------------


cte("an", """SELECT c.repo, c.path, c.language, c.imports, c.functions, c.classes, m.maintainability,
  m.has_main, m.has_tests, m.code_lines, m.complexity, m.total_lines
  FROM file_counts c JOIN metrics m USING (repo, path)""", ["file_counts", "metrics"])


def _flag_count(words: list[str]) -> str:
    return " + ".join(f"max(CASE WHEN contains(lower(path), {sql_str(w)}) THEN 1 ELSE 0 END)" for w in words)


_is_test = f"({contains_any('lower(path)', TEST_PATH_WORDS)} OR has_tests)"
_is_entry = f"(has_main OR {contains_any('lower(path)', ENTRY_POINT_WORDS)})"
cte("facts0", f"""SELECT repo, count(*) AS total_files, count(*) AS files,
  CAST(sum(functions) AS BIGINT) AS total_functions, CAST(sum(classes) AS BIGINT) AS total_classes,
  CAST(sum(imports) AS BIGINT) AS total_imports, count(DISTINCT language) AS languages,
  count(*) FILTER (WHERE maintainability = 'High') AS high,
  count(*) FILTER (WHERE maintainability = 'Medium') AS medium,
  count(*) FILTER (WHERE maintainability = 'Low') AS low,
  {_flag_count(MVC_INDICATORS)} AS mvc_n, {_flag_count(LAYERED_INDICATORS)} AS layered_n,
  {_flag_count(MICROSERVICE_INDICATORS)} AS micro_n,
  count(*) FILTER (WHERE {_is_test}) AS test_files, count(*) FILTER (WHERE NOT {_is_test}) AS regular_files,
  count(*) FILTER (WHERE {_is_entry}) AS entry_points
  FROM an GROUP BY repo""", ["an"])
cte("facts", f"""SELECT repo, total_files, files, total_functions, total_classes, total_imports, languages,
  high, medium, low, mvc_n >= 2 AS mvc, layered_n >= 2 AS layered, micro_n >= 3 AS microservices,
  total_files > {MONOLITH_MIN_FILES} AND NOT micro_n >= 3 AS monolithic,
  test_files, regular_files, test_files / greatest(regular_files, 1) AS coverage_ratio,
  CASE WHEN test_files / greatest(regular_files, 1) > 0.5 THEN 'High'
       WHEN test_files / greatest(regular_files, 1) > 0.2 THEN 'Medium' ELSE 'Low' END AS coverage_level,
  entry_points FROM facts0""", ["facts0"])

cte("recs", " UNION ALL ".join(
    f"SELECT repo, {i} AS rule, {sql_str(t)} AS recommendation FROM facts WHERE {cond}"
    for i, (cond, t) in enumerate(zip(
        ["total_functions = 0", "low > high + medium", "coverage_level = 'Low'", "entry_points = 0",
         "languages > 5"], RECOMMENDATIONS))), ["facts"])

cte("lang_counts", """SELECT repo, language, count(*) AS files, min(path) AS first_path FROM an GROUP BY ALL""", ["an"])
cte("lang_line", """SELECT repo,
  string_agg(concat(language, '=', CAST(files AS VARCHAR)), ', ' ORDER BY first_path, language, files) AS language_counts,
  concat('[', string_agg(concat('''', language, ''''), ', ' ORDER BY first_path, language), ']') AS language_list
  FROM lang_counts GROUP BY repo""", ["lang_counts"])

_patterns = ("coalesce(nullif(concat_ws(', ', CASE WHEN mvc THEN 'MVC' END, CASE WHEN layered THEN 'LAYERED' END, "
             "CASE WHEN microservices THEN 'MICROSERVICES' END, CASE WHEN monolithic THEN 'MONOLITHIC' END), ''), "
             "'No specific patterns detected')")
cte("report_wide", f"""SELECT f.repo, CAST(total_files AS VARCHAR) AS total_files,
  coalesce(l.language_counts, '') AS languages, CAST(total_functions AS VARCHAR) AS functions,
  CAST(total_classes AS VARCHAR) AS classes, {_patterns} AS architecture_patterns,
  coverage_level AS test_coverage, CAST(entry_points AS VARCHAR) AS entry_points,
  concat('High=', high, ', Medium=', medium, ', Low=', low) AS complexity_distribution,
  CAST(coalesce(r.n, 0) AS VARCHAR) AS recommendations
  FROM facts f LEFT JOIN lang_line l USING (repo)
  LEFT JOIN (SELECT repo, count(*) AS n FROM recs GROUP BY repo) r USING (repo)""",
    ["facts", "lang_line", "recs"])

cte("stems", """SELECT DISTINCT repo, split_part(regexp_extract(path, '([^/]*)$', 1), '.', 1) AS stem FROM files""",
    ["files"])
cte("dep_edges", """SELECT i.repo, i.path, i.ord, i.module FROM imp_t i
  WHERE EXISTS (SELECT 1 FROM stems s WHERE s.repo = i.repo AND contains(i.module, s.stem))""",
    ["imp_t", "stems"])

_score = (f"(CASE WHEN {contains_any('lower(path)', IMPORTANT_PATH_WORDS)} THEN 10 ELSE 0 END"
          f" + CASE WHEN {contains_any('lower(path)', CONFIG_PATH_WORDS)} THEN 5 ELSE 0 END"
          " + functions * 2 + classes * 3"
          " - CASE WHEN contains(lower(path), 'test') OR (functions = 0 AND classes = 0) THEN 5 ELSE 0 END)")
cte("important", f"""SELECT repo, CAST(row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) AS INTEGER) AS rank,
  path, language, score
  FROM (SELECT repo, path, language, CAST({_score} AS INTEGER) AS score FROM file_counts) WHERE score > 0
  QUALIFY rank <= 5""", ["file_counts"])
KNOWN_LIBS = "|".join(EXTERNAL_LIBRARIES)

# ---------------------------------------------------------------------------
# Retrieval: TF-IDF over documents, questions from benchmark / conversations
# ---------------------------------------------------------------------------


STOP_LIST = "[" + ", ".join(sql_str(w) for w in ENGLISH_STOP_WORDS) + "]"


def _terms_ctes(name: str, src_sql: str) -> None:
    """``{name}_tf(id, term, tf)`` for a source with columns (id, text)."""
    cte(f"{name}_src", src_sql, [])
    cte(f"{name}_tok", f"""SELECT id, list_filter(regexp_extract_all(lower(text), {sql_str(TOKEN_PATTERN)}),
      lambda t: NOT list_contains({STOP_LIST}, t)) AS k FROM {name}_src""", [f"{name}_src"])
    cte(f"{name}_tf", f"""SELECT id, term, count(*) AS tf FROM
      (SELECT id, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: concat(k[i], ' ', k[i + 1]))))
         AS term FROM {name}_tok) GROUP BY ALL""", [f"{name}_tok"])


_terms_ctes("d", "SELECT doc_id AS id, text FROM documents")
cte("vocab", f"""SELECT term, df, total, ln((1 + n) / (1 + df)) + 1 AS idf FROM
  (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total,
          (SELECT CAST(count(*) AS DOUBLE) FROM documents) AS n FROM d_tf GROUP BY term)
  WHERE df <= {MAX_DF} * n ORDER BY total DESC, term LIMIT {MAX_FEATURES}""", ["d_tf"])
cte("d_w", "SELECT id AS doc_id, term, tf * idf AS w FROM d_tf JOIN vocab USING (term)", ["d_tf", "vocab"])
cte("d_norm", "SELECT doc_id, sqrt(sum(w * w)) AS norm FROM d_w GROUP BY doc_id", ["d_w"])
cte("postings", "SELECT doc_id, term, w / norm AS weight FROM d_w JOIN d_norm USING (doc_id)", ["d_w", "d_norm"])
cte("kb", "SELECT doc_id, source, 'document' AS type, text FROM documents", [])


def _search_ctes(name: str, src_sql: str, k: int = 5, min_sim: float = 0.1) -> None:
    _terms_ctes(name, src_sql)
    cte(f"{name}_w", f"SELECT id AS qid, term, tf * idf AS w FROM {name}_tf JOIN vocab USING (term)",
        [f"{name}_tf", "vocab"])
    cte(f"{name}_v", f"""SELECT qid, term, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS qw FROM {name}_w""",
        [f"{name}_w"])
    cte(f"{name}_hits", f"""SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank, score FROM
      (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank
       FROM (SELECT qid, doc_id, round(sum(qw * weight), 9) AS score FROM {name}_v JOIN postings USING (term) GROUP BY ALL))
      WHERE rank <= {k} AND score > {min_sim}""", [f"{name}_v", "postings"])
    cte(f"{name}_top3", f"""SELECT h.qid, h.rank, h.doc_id, h.score, kb.source, kb.type, kb.text
      FROM {name}_hits h JOIN kb USING (doc_id) WHERE h.rank <= 3""", [f"{name}_hits", "kb"])


_search_ctes("bq", f"SELECT item_id AS id, text FROM benchmark WHERE {has_text('text')}")
_search_ctes("cq", f"""SELECT concat_ws(':', conv_id, turn) AS id, text FROM conversations
  WHERE role = 'user' AND {has_text('text')}""")


def answers_sql(name: str, questions_sql: str) -> str:
    preview = "CASE WHEN length(text) > 300 THEN concat(substr(text, 1, 300), '...') ELSE text END"
    return with_ctes(f"""
SELECT q.qid,
  CASE WHEN a.body IS NULL THEN {sql_str(NO_ANSWER_TEXT)}
       ELSE concat({sql_str(ANSWER_HEADER.replace(chr(10), '<NL>'))}, a.body) END AS answer,
  CASE WHEN a.top_score IS NULL THEN 'low' WHEN a.top_score > 0.4 THEN 'high'
       WHEN a.top_score > 0.25 THEN 'medium' ELSE 'low' END AS confidence,
  coalesce(a.n_sources, 0) AS n_sources
FROM (SELECT DISTINCT qid FROM ({questions_sql})) q
LEFT JOIN (SELECT qid, string_agg(concat('**From ', source, '**: ', {preview}), chr(10) || chr(10) ORDER BY rank) AS body,
             max(CASE WHEN rank = 1 THEN score END) AS top_score, count(*) AS n_sources
           FROM {name}_top3 GROUP BY qid) a USING (qid)""", [f"{name}_top3"]).replace("'<NL>", "").replace(
        "<NL><NL>'", "' || chr(10) || chr(10)")


def context_sql(name: str) -> str:
    part = "concat('Source: ', source, ' (', type, ')', chr(10), substr(text, 1, 800), '...')"
    sep = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
    return with_ctes(f"""
SELECT qid, '' AS project_context, string_agg({part}, {sep} ORDER BY rank) AS context,
  CASE WHEN max(CASE WHEN rank = 1 THEN score END) > 0.5 THEN 'high'
       WHEN max(CASE WHEN rank = 1 THEN score END) > 0.3 THEN 'medium' ELSE 'low' END AS confidence
FROM {name}_top3 GROUP BY qid""", [f"{name}_top3"])



def prompts_sql(name: str, questions_sql: str) -> str:
    """The whole prompt of each question that has a source; the context is built from the ranked sources."""
    part = "concat('Source: ', source, ' (', type, ')', chr(10), substr(text, 1, 800), '...')"
    sep = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
    prompt = render_sql(ANSWER_PROMPT_TEMPLATE, {"project_context": "''", "context": "c.context", "question": "q.question"})
    return with_ctes(f"""
SELECT qid, {prompt} AS prompt,
  CASE WHEN c.top > 0.5 THEN 'high' WHEN c.top > 0.3 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT qid, string_agg({part}, {sep} ORDER BY rank) AS context, max(CASE WHEN rank = 1 THEN score END) AS top
      FROM {name}_top3 GROUP BY qid) c JOIN ({questions_sql}) q USING (qid)""", [f"{name}_top3"])


# ---------------------------------------------------------------------------
# Documentation tables and knowledge base
# ---------------------------------------------------------------------------


cte("fn_full", f"""SELECT t.repo, t.path, t.ord, t.name, t.line, t.signature,
  CASE WHEN length(b.body) > 0 THEN {nl('b.body')} + 1 ELSE 1 END AS estimated_lines
  FROM fn_t t JOIN fn_body b USING (repo, path, ord)""", ["fn_t", "fn_body"])
cte("fn_agg", """SELECT repo, path, count(*) AS n_f,
  string_agg(name, ', ' ORDER BY ord) FILTER (WHERE ord < 5) AS digest_names,
  string_agg(concat('- `', name, '` (line ', line, ')', chr(10)), '' ORDER BY ord) FILTER (WHERE ord < 10) AS doc_lines,
  string_agg(concat('- ', name, ': ', substr(replace(signature, chr(10), ' '), 1, 100), '... (', estimated_lines,
             ' lines)'), chr(10) ORDER BY ord) FILTER (WHERE ord < 10) AS prompt_lines
  FROM fn_full GROUP BY repo, path""", ["fn_full"])
cte("cls_agg", """SELECT repo, path, count(*) AS n_c,
  string_agg(name, ', ' ORDER BY ord) FILTER (WHERE ord < 3) AS digest_names,
  string_agg(concat('- `', name, '` (line ', line, ')', chr(10)), '' ORDER BY ord) AS doc_lines,
  string_agg(concat('- ', name, ': ', len(methods), ' methods'), chr(10) ORDER BY ord) FILTER (WHERE ord < 5)
    AS prompt_lines
  FROM cls_t GROUP BY repo, path""", ["cls_t"])
cte("imp_agg", """SELECT repo, path, count(*) AS n_i,
  string_agg(stmt, ', ' ORDER BY ord) FILTER (WHERE ord < 5) AS digest_stmts,
  string_agg(concat('- ', stmt, chr(10)), '' ORDER BY ord) FILTER (WHERE ord < 10) AS doc_deps,
  string_agg(stmt, chr(10) ORDER BY ord) FILTER (WHERE ord < 10) AS prompt_imports
  FROM imp_t GROUP BY repo, path""", ["imp_t"])
cte("file_all", """SELECT f.repo, f.path, f.language, m.total_lines, m.code_lines, m.complexity, m.maintainability,
  coalesce(fa.n_f, 0) AS n_f, fa.digest_names AS f_digest, fa.doc_lines AS f_doc, fa.prompt_lines AS f_prompt,
  coalesce(ca.n_c, 0) AS n_c, ca.digest_names AS c_digest, ca.doc_lines AS c_doc, ca.prompt_lines AS c_prompt,
  coalesce(ia.n_i, 0) AS n_i, ia.digest_stmts AS i_digest, ia.doc_deps AS i_doc, ia.prompt_imports AS i_prompt
  FROM files f JOIN metrics m USING (repo, path) LEFT JOIN fn_agg fa USING (repo, path)
  LEFT JOIN cls_agg ca USING (repo, path) LEFT JOIN imp_agg ia USING (repo, path)""",
    ["files", "metrics", "fn_agg", "cls_agg", "imp_agg"])


def _more_sql(n: str, cap: int, noun: str) -> str:
    return f"CASE WHEN {n} > {cap} THEN concat('... and ', {n} - {cap}, ' more {noun}') END"


cte("digest", f"""SELECT repo, path, language, concat_ws(' | ',
  concat('File: ', path, ' (Language: ', language, ')'), concat('Lines of code: ', code_lines),
  concat('Complexity: ', maintainability),
  CASE WHEN n_f > 0 THEN concat('Functions: ', f_digest) END, {_more_sql('n_f', 5, 'functions')},
  CASE WHEN n_c > 0 THEN concat('Classes: ', c_digest) END, {_more_sql('n_c', 3, 'classes')},
  CASE WHEN n_i > 0 THEN concat('Key imports: ', i_digest) END) AS digest FROM file_all""", ["file_all"])

_doc_text = render_sql(FILE_DOC_TEMPLATE, {
    "path": "a.path", "language": "a.language", "n_functions": "a.n_f", "n_classes": "a.n_c",
    "function_lines": f"CASE WHEN a.n_f > 0 THEN a.f_doc ELSE {sql_str(NO_FUNCTIONS_LINE)} END",
    "class_lines": f"CASE WHEN a.n_c > 0 THEN a.c_doc ELSE {sql_str(NO_CLASSES_LINE)} END",
    "dependencies": f"CASE WHEN a.n_i > 0 THEN concat({sql_str(chr(10) + '## Dependencies' + chr(10))}, a.i_doc) ELSE '' END",
    "total_lines": "a.total_lines", "code_lines": "a.code_lines", "maintainability": "a.maintainability"})
cte("file_docs", f"""SELECT a.repo, a.path, concat('docs/files/', translate(a.path, '/.', '__'), '.md') AS doc_path,
  {_doc_text} AS text FROM important i JOIN file_all a USING (repo, path)""", ["important", "file_all"])

_entry = render_sql(FILE_INDEX_ENTRY, {"path": "path", "safe_name": "translate(path, '/.', '__')"})
cte("doc_index", f"""SELECT repo, 'docs/FILES.md' AS doc_path, {render_sql(FILE_INDEX_TEMPLATE, {
    "entries": "entries", "n_files": "n_files", "generated_on": sql_str(DEFAULT_GENERATED_ON)})} AS text
  FROM (SELECT repo, string_agg({_entry}, '' ORDER BY path) AS entries, count(*) AS n_files
        FROM important GROUP BY repo)""", ["important"])

_prompt = render_sql(FILE_PROMPT_TEMPLATE, {
    "path": "a.path", "language": "a.language", "n_functions": "a.n_f", "n_classes": "a.n_c",
    "functions_summary": f"CASE WHEN a.n_f = 0 THEN 'None' ELSE concat_ws(chr(10), a.f_prompt, {_more_sql('a.n_f', 10, 'functions')}) END",
    "classes_summary": f"CASE WHEN a.n_c = 0 THEN 'None' ELSE concat_ws(chr(10), a.c_prompt, {_more_sql('a.n_c', 5, 'classes')}) END",
    "imports": "CASE WHEN a.n_i = 0 THEN 'None' ELSE a.i_prompt END",
    "code_lines": "a.code_lines", "complexity": "a.complexity", "maintainability": "a.maintainability"})
cte("file_prompts", f"""SELECT a.repo, a.path, {_prompt} AS prompt FROM important i JOIN file_all a USING (repo, path)""",
    ["important", "file_all"])

cte("api", f"""SELECT repo, 'function' AS kind, CAST(r - 1 AS INTEGER) AS ord, path, name, signature FROM
   (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, ord) AS r FROM fn_t) WHERE r <= 20
  UNION ALL
  SELECT repo, 'class', CAST(r - 1 AS INTEGER), path, name, signature FROM
   (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, ord) AS r FROM cls_t) WHERE r <= 10
  UNION ALL
  SELECT DISTINCT repo, 'none', 0, NULL, {sql_str(NO_API_TEXT)}, NULL FROM files
  WHERE repo NOT IN (SELECT repo FROM fn_t UNION SELECT repo FROM cls_t)""", ["fn_t", "cls_t", "files"])

_overview = "concat_ws(chr(10), '# Project Analysis Summary', " + ", ".join(
    f"concat({sql_str(f'- **{label}**: ')}, {c})" for c, label in REPORT_LABELS) + ")"
cte("kb_docs", f"""
  SELECT concat_ws(':', repo, 'overview', 'project_overview') AS doc_id, repo, 'overview' AS type,
    'project_overview' AS source, 'documentation' AS category, CAST(NULL AS VARCHAR) AS language,
    {_overview} AS text FROM report_wide
  UNION ALL
  SELECT concat_ws(':', repo, 'api', 'api_documentation'), repo, 'api', 'api_documentation', 'documentation', NULL,
    string_agg(CASE WHEN kind = 'none' THEN name ELSE concat('- ', kind, ' ', name, ': `', signature, '`') END,
               chr(10) ORDER BY CASE kind WHEN 'function' THEN 0 WHEN 'class' THEN 1 ELSE 2 END, ord)
    FROM api GROUP BY repo
  UNION ALL
  SELECT concat_ws(':', repo, 'setup', 'setup_guide'), repo, 'setup', 'setup_guide', 'documentation', NULL, text FROM setup_text
  UNION ALL
  SELECT concat_ws(':', repo, 'file_analysis', path), repo, 'file_analysis', path, 'code', language, digest FROM digest
  UNION ALL
  SELECT concat_ws(':', repo, 'file_documentation', path), repo, 'file_documentation', path, 'documentation', NULL, text
    FROM file_docs""", ["report_wide", "api", "setup_text", "digest", "file_docs"])

# ---------------------------------------------------------------------------
# Per-repository knowledge-base search (grouped TF-IDF)
# ---------------------------------------------------------------------------


def _group_terms_ctes(name: str, src_sql: str, deps: list[str]) -> None:
    """``{name}_tf(g, id, term, tf)`` for a source with columns (g, id, text)."""
    cte(f"{name}_src", src_sql, deps)
    cte(f"{name}_tok", f"""SELECT g, id, list_filter(regexp_extract_all(lower(text), {sql_str(TOKEN_PATTERN)}),
      lambda t: NOT list_contains({STOP_LIST}, t)) AS k FROM {name}_src""", [f"{name}_src"])
    cte(f"{name}_tf", f"""SELECT g, id, term, count(*) AS tf FROM
      (SELECT g, id, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: concat(k[i], ' ', k[i + 1]))))
         AS term FROM {name}_tok) GROUP BY ALL""", [f"{name}_tok"])


_group_terms_ctes("kbt", "SELECT repo AS g, doc_id AS id, text FROM kb_docs", ["kb_docs"])
cte("kb_vocab", f"""SELECT g, term, df, total, ln((1 + n) / (1 + df)) + 1 AS idf FROM
  (SELECT s.g, s.term, s.df, s.total, c.n,
          row_number() OVER (PARTITION BY s.g ORDER BY s.total DESC, s.term) AS r
   FROM (SELECT g, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM kbt_tf GROUP BY g, term) s
   JOIN (SELECT repo AS g, CAST(count(*) AS DOUBLE) AS n FROM kb_docs GROUP BY repo) c USING (g)
   WHERE s.df <= {MAX_DF} * c.n)
  WHERE r <= {MAX_FEATURES}""", ["kbt_tf", "kb_docs"])
cte("kb_w", "SELECT g, id AS doc_id, term, tf * idf AS w FROM kbt_tf JOIN kb_vocab USING (g, term)",
    ["kbt_tf", "kb_vocab"])
cte("kb_post", """SELECT g, doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY g, doc_id)) AS weight FROM kb_w""",
    ["kb_w"])
_group_terms_ctes("kbq", f"""SELECT repo AS g, concat_ws(':', repo, kind, CAST(ord AS VARCHAR)) AS id,
  concat('What does the ', kind, ' ', name, ' do?') AS text FROM api WHERE kind <> 'none'""", ["api"])
cte("kbq_v", """SELECT g, qid, term, w / sqrt(sum(w * w) OVER (PARTITION BY g, qid)) AS qw FROM
  (SELECT g, id AS qid, term, tf * idf AS w FROM kbq_tf JOIN kb_vocab USING (g, term))""", ["kbq_tf", "kb_vocab"])
cte("kb_hits", """SELECT g AS repo, qid, doc_id, CAST(rank AS INTEGER) AS rank, score FROM
  (SELECT g, qid, doc_id, score, row_number() OVER (PARTITION BY g, qid ORDER BY round(score, 9) DESC, doc_id) AS rank
   FROM (SELECT g, qid, doc_id, round(sum(qw * weight), 9) AS score FROM kbq_v JOIN kb_post USING (g, term) GROUP BY ALL))
  WHERE rank <= 5 AND score > 0.1""", ["kbq_v", "kb_post"])


_fblock = strip(render_sql(API_FUNCTION_BLOCK, {"name": "name", "signature": "signature",
                                                "preview": "substr(body_preview, 1, 150)"}))
_cblock = strip(render_sql(API_CLASS_BLOCK, {"name": "name", "signature": "signature",
                                             "methods": "CASE WHEN len(methods) > 0 THEN array_to_string(methods[1:5], ', ') ELSE 'None' END"}))
cte("api_prompts", f"""SELECT r.repo, CASE WHEN f.n IS NULL AND c.n IS NULL THEN {sql_str(NO_API_TEXT)} ELSE {render_sql(
    API_PROMPT_TEMPLATE, {"n_functions": "coalesce(f.n, 0)", "n_classes": "coalesce(c.n, 0)",
                          "functions_detail": "coalesce(f.d, 'None')", "classes_detail": "coalesce(c.d, 'None')"})} END AS prompt
  FROM (SELECT DISTINCT repo FROM files) r
  LEFT JOIN (SELECT repo, count(*) AS n, string_agg({_fblock}, chr(10) || chr(10) ORDER BY rr) AS d FROM
     (SELECT t.repo, t.name, t.signature,
        CASE WHEN length(b.body) > {BODY_PREVIEW_CHARS} THEN concat(substr(b.body, 1, {BODY_PREVIEW_CHARS}), '...') ELSE b.body END AS body_preview,
        row_number() OVER (PARTITION BY t.repo ORDER BY t.path, t.ord) AS rr
      FROM fn_t t JOIN fn_body b USING (repo, path, ord)) WHERE rr <= 20 GROUP BY repo) f USING (repo)
  LEFT JOIN (SELECT repo, count(*) AS n, string_agg({_cblock}, chr(10) || chr(10) ORDER BY rr) AS d FROM
     (SELECT repo, name, signature, methods, row_number() OVER (PARTITION BY repo ORDER BY path, ord) AS rr FROM cls_t)
     WHERE rr <= 10 GROUP BY repo) c USING (repo)""", ["files", "fn_t", "fn_body", "cls_t"])


_pattern_lines = ("coalesce(nullif(concat_ws(chr(10), CASE WHEN f.mvc THEN '- **MVC**: Detected' END, "
                  "CASE WHEN f.layered THEN '- **LAYERED**: Detected' END, "
                  "CASE WHEN f.microservices THEN '- **MICROSERVICES**: Detected' END, "
                  "CASE WHEN f.monolithic THEN '- **MONOLITHIC**: Detected' END), ''), "
                  f"{sql_str(NO_PATTERNS_LINE)})")
cte("summary_md", f"""SELECT f.repo, {render_sql(SUMMARY_TEMPLATE, {
    "total_files": "f.total_files", "languages": "coalesce(l.d, '{}')", "functions": "f.total_functions",
    "classes": "f.total_classes", "patterns": _pattern_lines, "coverage": "f.coverage_level",
    "entry_points": "f.entry_points",
    "distribution": "concat('{''High'': ', f.high, ', ''Medium'': ', f.medium, ', ''Low'': ', f.low, '}')",
    "recommendations": "coalesce(r.d, '')", "generated_on": sql_str("1970-01-01 00:00:00")})} AS text
  FROM facts f
  LEFT JOIN (SELECT repo, concat('{{', string_agg(concat('''', language, ''': ', files), ', '
             ORDER BY first_path, language, files), '}}') AS d FROM lang_counts GROUP BY repo) l USING (repo)
  LEFT JOIN (SELECT repo, string_agg(concat('- ', recommendation), chr(10) ORDER BY rule) AS d
             FROM recs GROUP BY repo) r USING (repo)""", ["facts", "lang_counts", "recs"])


def _pybool(x: str) -> str:
    return f"CASE WHEN {x} THEN 'True' ELSE 'False' END"


_ep_text = (f"concat('[', coalesce(e.d, ''), ']', CASE WHEN f.entry_points > {PROMPT_ENTRY_POINTS_CAP} "
            f"THEN concat(' (+', f.entry_points - {PROMPT_ENTRY_POINTS_CAP}, ' more)') ELSE '' END)")
_patterns_dict = ("concat('{''mvc'': ', " + _pybool("f.mvc") + ", ', ''layered'': ', " + _pybool("f.layered")
                  + ", ', ''microservices'': ', " + _pybool("f.microservices") + ", ', ''monolithic'': ', "
                  + _pybool("f.monolithic") + ", '}')")
_setup_joins = f"""  FROM facts f
  LEFT JOIN (SELECT repo,
       concat('{{', string_agg(concat('''', language, ''': ', files), ', ' ORDER BY first_path, language, files), '}}') AS dct,
       concat('[', string_agg(concat('''', language, ''''), ', ' ORDER BY first_path, language, files), ']') AS lst
     FROM lang_counts GROUP BY repo) l USING (repo)
  LEFT JOIN (SELECT repo, string_agg(concat('''', path, ''''), ', ' ORDER BY path) AS d FROM
     (SELECT * FROM (SELECT DISTINCT repo, path FROM an WHERE {_is_entry}) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path) <= {PROMPT_ENTRY_POINTS_CAP})
     GROUP BY repo) e USING (repo)
  LEFT JOIN (SELECT repo, count(*) AS n, string_agg(concat('''', dependency, ''''), ', ' ORDER BY dependency) AS d FROM
     (SELECT * FROM (SELECT DISTINCT repo, lower(module) AS dependency FROM imp_t WHERE regexp_matches(lower(module), {sql_str(KNOWN_LIBS)}))
     QUALIFY row_number() OVER (PARTITION BY repo ORDER BY dependency) <= 10) GROUP BY repo) dp USING (repo)"""
cte("setup_text", f"""SELECT f.repo, {render_sql(SETUP_TEXT_TEMPLATE, {
    "languages": "coalesce(l.lst, '[]')", "dependencies": "concat('[', coalesce(dp.d, ''), ']')",
    "entry_points": _ep_text})} AS text {_setup_joins}""", ["facts", "lang_counts", "an", "imp_t"])
_prompts = lambda name, description, info: f"""SELECT f.repo, {render_sql(OVERVIEW_PROMPT_TEMPLATE, {
    "name": name, "description": description, "total_files": "f.total_files",
    "languages": "coalesce(l.dct, '{}')", "functions": "f.total_functions", "classes": "f.total_classes",
    "n_dependencies": "coalesce(dp.n, 0)", "patterns": _patterns_dict, "entry_points": _ep_text,
    "coverage": "f.coverage_level", "recommendations": "coalesce(r.d, '')"})} AS overview_prompt,
  {render_sql(SETUP_PROMPT_TEMPLATE, {"languages": "coalesce(l.lst, '[]')",
                                      "dependencies": "concat('[', coalesce(dp.d, ''), ']')",
                                      "entry_points": _ep_text})} AS setup_prompt
{_setup_joins}
  LEFT JOIN (SELECT repo, string_agg(concat('- ', recommendation), chr(10) ORDER BY rule) AS d FROM recs GROUP BY repo) r
     USING (repo) {info}"""  # noqa: E731
cte("repo_prompts", _prompts("f.repo", sql_str(NO_DESCRIPTION), ""), ["facts", "lang_counts", "an", "imp_t", "recs"])
cte("repo_prompts_info", _prompts("coalesce(i.name, f.repo)", f"coalesce(i.description, {sql_str(NO_DESCRIPTION)})",
                                  "LEFT JOIN repo_info i USING (repo)"), ["facts", "lang_counts", "an", "imp_t", "recs", "repo_info"])

# ---------------------------------------------------------------------------
# Directory tree drawing and README page
# ---------------------------------------------------------------------------

cte("tree_first", """SELECT repo, path, language, r FROM
  (SELECT repo, path, language, row_number() OVER (PARTITION BY repo ORDER BY path) AS r FROM files) WHERE r <= 20""",
    ["files"])
cte("tree_nodes", """SELECT repo, r, d, parts[1:d] AS kp, array_to_string(parts[1:d - 1], '/') AS parent,
  d = len(parts) AS is_file, CASE WHEN d = len(parts) THEN language END AS language
  FROM (SELECT repo, r, language, parts, unnest(range(1, len(parts) + 1)) AS d
        FROM (SELECT repo, r, language, string_split(path, '/') AS parts FROM tree_first))""", ["tree_first"])
cte("tree_last", """SELECT *, first = max(first) OVER (PARTITION BY repo, parent) AS is_last FROM
  (SELECT repo, array_to_string(kp, '/') AS key, min(r) AS first, max(d) AS d, max(parent) AS parent,
          bool_or(is_file) AS is_file, max(language) AS language, max(kp) AS kp
   FROM tree_nodes GROUP BY repo, array_to_string(kp, '/'))""", ["tree_nodes"])
cte("tree_anc", """SELECT n.repo, n.key, n.a_d, a.first AS a_first, a.is_last AS a_last
  FROM (SELECT repo, key, kp, unnest(range(1, d + 1)) AS a_d FROM tree_last) n
  JOIN tree_last a ON a.repo = n.repo AND a.key = array_to_string(n.kp[1:n.a_d], '/')""", ["tree_last"])
cte("tree_lines", """SELECT t.repo, t.key, list(x.a_first ORDER BY x.a_d) AS o,
  concat(coalesce(string_agg(CASE WHEN x.a_last THEN '    ' ELSE '│   ' END, '' ORDER BY x.a_d)
                  FILTER (WHERE x.a_d < t.d), ''),
         CASE WHEN t.is_last THEN '└── ' ELSE '├── ' END, t.kp[len(t.kp)],
         CASE WHEN t.is_file THEN concat(' (', coalesce(t.language, ''), ')', chr(10)) ELSE '/' || chr(10) END) AS line
  FROM tree_last t JOIN tree_anc x ON x.repo = t.repo AND x.key = t.key
  GROUP BY t.repo, t.key, t.d, t.is_last, t.kp, t.is_file, t.language""", ["tree_last", "tree_anc"])
cte("tree", "SELECT repo, string_agg(line, '' ORDER BY o) AS tree FROM tree_lines GROUP BY repo", ["tree_lines"])
_readme = lambda name, description, info: f"""SELECT f.repo, 'README.md' AS doc_path, {render_sql(README_TEMPLATE, {
    "name": name, "description": description, "overview": "substr(s.text, 1, 500)",
    "languages": "coalesce(l.d, '')", "files": "f.total_files", "functions": "f.total_functions",
    "classes": "f.total_classes", "tree": "t.tree", "generated_on": sql_str(DEFAULT_GENERATED_ON)})} AS text
  FROM facts f
  LEFT JOIN (SELECT repo, string_agg(language, ', ' ORDER BY first_path, language) AS d FROM lang_counts GROUP BY repo) l
    USING (repo)
  LEFT JOIN summary_md s USING (repo) LEFT JOIN tree t USING (repo) {info}"""  # noqa: E731
cte("readme", _readme("f.repo", sql_str(README_DESCRIPTION), ""), ["facts", "lang_counts", "summary_md", "tree"])
cte("readme_info", _readme("coalesce(i.name, f.repo)", f"coalesce(i.description, {sql_str(README_DESCRIPTION)})",
                           "LEFT JOIN repo_info i USING (repo)"), ["facts", "lang_counts", "summary_md", "tree", "repo_info"])


# ---------------------------------------------------------------------------
# Docstrings over real text: each document becomes a Python function whose
# docstring is the whole document.
# ---------------------------------------------------------------------------

cte("doc_py_files", """SELECT source AS repo, concat('doc_', CAST(doc_id AS VARCHAR), '.py') AS path,
  'python' AS language, concat('def doc_', CAST(doc_id AS VARCHAR), '():', chr(10), '    ', repeat(chr(34), 3), text,
  repeat(chr(34), 3), chr(10), '    return None', chr(10)) AS content FROM documents""", [])
_positioned("pydoc", {"python": DOCSTRING_PATTERN}, src="doc_py_files")
cte("pydoc_t", f"""SELECT repo, path, CAST(row_number() OVER (PARTITION BY repo, path ORDER BY i) - 1 AS INTEGER) AS ord,
  text, line, CAST(length(text) AS INTEGER) AS length
  FROM (SELECT repo, path, i, line, {strip("coalesce(nullif(g1, ''), nullif(g2, ''))")} AS text FROM pydoc_pos)
  WHERE coalesce(length(text), 0) > 10""", ["pydoc_pos"])


# ---------------------------------------------------------------------------
# The documentation suite: every page by its path
# ---------------------------------------------------------------------------


def _page(template: str, **fields: str) -> str:
    return render_sql(template, {"text": "text", "generated_on": sql_str(DEFAULT_GENERATED_ON), **fields})


cte("api_block", """SELECT repo, string_agg(CASE WHEN kind = 'none' THEN name ELSE concat('- ', kind, ' ', name, ': `', signature, '`') END,
    chr(10) ORDER BY CASE kind WHEN 'function' THEN 0 WHEN 'class' THEN 1 ELSE 2 END, ord) AS text FROM api GROUP BY repo""", ["api"])
cte("doc_suite", f"""SELECT repo, doc_path, text FROM readme
  UNION ALL SELECT repo, 'docs/API.md', {_page(API_PAGE_TEMPLATE)} FROM api_block
  UNION ALL SELECT repo, 'docs/SETUP.md', {_page(SETUP_PAGE_TEMPLATE)} FROM setup_text
  UNION ALL SELECT repo, 'docs/ARCHITECTURE.md', {_page(ARCHITECTURE_PAGE_TEMPLATE)} FROM kb_docs WHERE type = 'overview'
  UNION ALL SELECT repo, doc_path, text FROM doc_index
  UNION ALL SELECT repo, doc_path, {_page(FILE_PAGE_TEMPLATE, path="path")} FROM file_docs""",
    ["readme", "api_block", "setup_text", "kb_docs", "doc_index", "file_docs"])

# Twelve languages: one snippet each, with the symbols a reader finds in it.
SNIPPETS = [
    ("python", "import os\ndef new(a):\n    return a\nclass Box:\n    def case(self):\n        pass\n", [("new", 2), ("case", 5)], [("Box", 4)]),
    ("javascript", "function load(x) { return x; }\nconst run = (a) => a;\nclass Box {}\n", [("load", 1), ("run", 2)], [("Box", 3)]),
    ("typescript", "function load(x) { return x; }\nclass Box {}\n", [("load", 1)], [("Box", 2)]),
    ("java", "public class Box {\n  public int size(int a) {\n    if (a) {\n    }\n  }\n}\n", [("size", 2)], [("Box", 1)]),
    ("cpp", "class Box {\n};\nint size(int a) {\n  while (a) {\n  }\n}\n", [("size", 3)], [("Box", 1)]),
    ("c", "int size(int a) {\n  return a;\n}\n", [("size", 1)], []),
    ("go", "type Box struct {\n}\nfunc new(a int) int {\n}\n", [("new", 3)], [("Box", 1)]),
    ("rust", "struct Box {\n}\nfn new(a: i32) -> i32 {\n}\n", [("new", 3)], [("Box", 1)]),
    ("php", "<?php\nclass Box {\n  public function load($a) {\n  }\n}\n", [("load", 3)], [("Box", 2)]),
    ("ruby", "class Box\n  def try(a)\n  end\nend\n", [("try", 2)], [("Box", 1)]),
    ("swift", "class Box {\n  func load(a: Int) {\n  }\n}\n", [("load", 2)], [("Box", 1)]),
    ("kotlin", "class Box {\n  public fun catch(a: Int) {\n  }\n}\n", [("catch", 2)], [("Box", 1)]),
]


def _snippet_rows(place: int) -> str:
    rows = [f"({i}, {k}, {sql_str(name)}, {line})" for i, s in enumerate(SNIPPETS) for k, (name, line) in enumerate(s[place])]
    return ", ".join(rows)


def snippet_symbols_sql() -> str:
    """Hand-derived symbols of the snippet that each part carries."""
    langs = ", ".join(f"({i}, {sql_str(s[0])})" for i, s in enumerate(SNIPPETS))
    one = "SELECT CAST(p_partkey AS VARCHAR) AS path, language, '{kind}' AS kind, CAST(ord AS INTEGER) AS ord, name, CAST(line AS INTEGER) AS line FROM part JOIN (VALUES " + langs + \
        ") l(i, language) ON p_partkey % 12 = l.i JOIN (VALUES {rows}) s(i, ord, name, line) ON s.i = l.i"
    return one.format(kind="function", rows=_snippet_rows(2)) + " UNION ALL " + one.format(kind="class", rows=_snippet_rows(3))


# ---------------------------------------------------------------------------
# The documents as files on storage, a language registered for them, repository metadata
# ---------------------------------------------------------------------------

cte("tree_raw", """SELECT concat('source=', source) AS repo, concat('part=', CAST(doc_id // 200 AS VARCHAR)) AS path,
  concat(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id), chr(10)) AS raw
  FROM documents GROUP BY source, doc_id // 200""", [])
cte("tree_files", """SELECT repo, path, 'prose' AS language,
  regexp_replace(replace(raw, chr(65533), ''), '\r\n?', chr(10), 'g') AS content FROM tree_raw""", ["tree_raw"])
_positioned("prose", {"prose": r"([A-Za-z]+(?:ing|er)) "}, "tree_files")
cte("prose_t", """SELECT repo, path, g1 AS name, line, CAST(row_number() OVER (PARTITION BY repo, path ORDER BY i) - 1 AS INTEGER) AS ord
  FROM prose_pos""", ["prose_pos"])
metrics_cte("tree_metrics", "tree_files")
cte("repo_info", """SELECT concat('repo', p_partkey % 23) AS repo, concat('Name ', p_partkey % 23) AS name,
  CASE WHEN p_partkey % 23 % 3 = 0 THEN NULL ELSE concat('About ', max(p_name)) END AS description
  FROM part WHERE p_partkey % 23 % 5 <> 4 GROUP BY p_partkey % 23""", [])

# The drawn tree of whole repositories, a row a line.
cte("whole_nodes", """SELECT *, first_path = max(first_path) OVER (PARTITION BY repo, parent) AS is_last FROM
  (SELECT repo, array_to_string(parts[1:d], '/') AS key, array_to_string(parts[1:d - 1], '/') AS parent, parts[d] AS name,
          CAST(d AS INTEGER) AS depth, min(path) AS first_path, bool_or(d = len(parts)) AS is_file,
          max(CASE WHEN d = len(parts) THEN language END) AS language
   FROM (SELECT repo, path, language, parts, unnest(range(1, len(parts) + 1)) AS d
         FROM (SELECT repo, path, language, string_split(path, '/') AS parts FROM files)) GROUP BY ALL)""", ["files"])
cte("whole_lines", f"""SELECT n.repo, n.first_path, n.depth, concat(
    coalesce(string_agg(CASE WHEN a.is_last THEN {sql_str(TREE_SPACE)} ELSE {sql_str(TREE_PIPE)} END, '' ORDER BY a.depth) FILTER (WHERE a.key IS NOT NULL), ''),
    CASE WHEN n.is_last THEN {sql_str(TREE_LAST)} ELSE {sql_str(TREE_BRANCH)} END, n.name,
    CASE WHEN n.is_file THEN concat(' (', coalesce(n.language, ''), ')') ELSE '/' END) AS line
  FROM whole_nodes n LEFT JOIN whole_nodes a ON a.repo = n.repo AND a.depth < n.depth AND starts_with(n.key, concat(a.key, '/'))
  GROUP BY n.repo, n.key, n.first_path, n.depth, n.is_last, n.name, n.is_file, n.language""", ["whole_nodes"])

# Answer prompts of the knowledge bases, each with its repository's context (metadata included).
cte("context_info", """SELECT f.repo, concat_ws(' | ', concat('Project: ', coalesce(i.name, f.repo)),
  CASE WHEN length(i.description) > 0 THEN concat('Description: ', i.description) END,
  concat('Languages: ', coalesce(l.language_list, '[]')),
  concat('Total files: ', total_files), concat('Functions: ', total_functions), concat('Classes: ', total_classes)) AS context
FROM facts f LEFT JOIN lang_line l USING (repo) LEFT JOIN repo_info i USING (repo)""", ["facts", "lang_line", "repo_info"])
_kb_prompt = render_sql(ANSWER_PROMPT_TEMPLATE, {"project_context": "p.context", "context": "c.passages", "question": "q.question"})
cte("kb_answer_prompts", f"""SELECT c.repo, c.qid, {_kb_prompt} AS prompt,
  CASE WHEN c.top > 0.5 THEN 'high' WHEN c.top > 0.3 THEN 'medium' ELSE 'low' END AS confidence
  FROM (SELECT h.repo, h.qid, max(CASE WHEN rank = 1 THEN score END) AS top,
               string_agg(concat('Source: ', d.source, ' (', d.type, ')', chr(10), substr(d.text, 1, 800), '...'),
                          chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS passages
        FROM kb_hits h JOIN kb_docs d ON d.repo = h.repo AND d.doc_id = h.doc_id WHERE rank <= 3 GROUP BY h.repo, h.qid) c
  JOIN (SELECT repo, concat_ws(':', repo, kind, CAST(ord AS VARCHAR)) AS qid, concat('What does the ', kind, ' ', name, ' do?') AS question
        FROM api WHERE kind <> 'none') q USING (repo, qid)
  JOIN context_info p ON p.repo = c.repo""", ["kb_hits", "kb_docs", "api", "context_info"])

# The index of the documents that are left after some were deleted.
_group_terms_ctes("left", "SELECT 'all' AS g, doc_id AS id, text FROM documents WHERE doc_id % 7 <> 3", [])
cte("left_n", "SELECT CAST(count(*) AS DOUBLE) AS n FROM documents WHERE doc_id % 7 <> 3", [])
cte("left_vocab", f"""SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM
  (SELECT term, df, n, row_number() OVER (ORDER BY total DESC, term) AS r
   FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM left_tf GROUP BY term), left_n
   WHERE df <= {MAX_DF} * n) WHERE r <= {MAX_FEATURES}""", ["left_tf", "left_n"])
cte("left_post", """SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM
  (SELECT id AS doc_id, term, tf * idf AS w FROM left_tf JOIN left_vocab USING (term))""", ["left_tf", "left_vocab"])
