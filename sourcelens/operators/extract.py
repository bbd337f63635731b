"""Corpus-wide extraction.

``analyze(files)`` is one narrow projection over the corpus: every file is
scanned by each per-language pattern once (a ``split`` for the text between
matches and a ``regexp_extract_all`` for the matches), and all per-file
results are nested arrays on the same row.  The long tables (``functions``,
``classes`` …) are ``explode`` views of it, so nothing here shuffles and the
content column can be dropped right after this step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.rules import (
    BODY_PREVIEW_CHARS, COMMENT_CAP, CONTROL_KEYWORDS, CONTROL_NAME_LANGUAGES, DEFAULT_RULES,
    DOC_BLOCK_PATTERN, DOCSTRING_CAP, DOCSTRING_SCAN, IMPORT_CAP, METHOD_CAP, NOT_FUNCTION_NAMES,
    TEST_CONTENT_WORDS, UNICODE_WORD, VARIABLE_CAP, LanguageRules,
)

KEYWORD_PATTERN = ("(?<!" + UNICODE_WORD + ")(?:" + "|".join(CONTROL_KEYWORDS) + ")(?!" + UNICODE_WORD + ")")

_POSITIONED = ("fn", "cls", "cmt", "doc")   # need offsets / line numbers
_PLAIN = ("imp", "var")                     # need match texts only


def _tables(rules: LanguageRules) -> dict[str, dict[str, str]]:
    return {"fn": rules.functions, "cls": rules.classes, "imp": rules.imports,
            "cmt": rules.comments, "var": rules.variables, "doc": {"python": DOCSTRING_SCAN}}


_AROUND = 128      # pieces of text after a header that hold more than a preview, however short


def _tails(matches: Column, heads: Column) -> Column:
    """For each match the first characters of the text after it, one more than a preview has.

    Put together from the text between matches (``heads``, cut to that length) and the next matches, so no copy of
    the file is searched from its start.
    """
    most = BODY_PREVIEW_CHARS + 1
    pieces = F.flatten(F.zip_with(matches, F.slice(heads, F.lit(2), F.size(matches)), lambda m, h: F.array(F.substring(m, 1, most), h)))
    return X.let(pieces, lambda ps: F.transform(matches, lambda _, i: F.substring(
        F.array_join(F.slice(ps, i * 2 + 2, _AROUND - 1), ""), 1, most)))


def _brace_ends(fns: Column, brc: Column) -> Column:
    """For each function the brace that closes its body (position, line), by the depths of all braces of the file.

    A body that is open after its header (depth 1) or not (0) ends with the first brace that brings the depth back
    to that before it.  Functions stand in order, so one sort with the braces gives the depth before each, and a
    second one, by depth and position, the closing brace.
    """
    merged = F.sort_array(F.concat(
        F.transform(brc, lambda b: F.struct(b["pos"].alias("at"), F.lit(1).alias("kind"))),
        F.transform(fns, lambda f: F.struct(f["end0"].alias("at"), F.lit(0).alias("kind")))))
    place = F.filter(F.transform(merged, lambda e, k: F.struct(e["kind"].alias("kind"), k.alias("k"))), lambda e: e["kind"] == 0)
    queries = X.let(place, lambda at: F.transform(fns, lambda f, i: F.struct(
        (F.coalesce(F.get(brc, F.get(at, i)["k"] - i - 1)["depth"], F.lit(0)) - F.when(f["opens"], 1).otherwise(0)).alias("g"),
        (f["end0"] - 1).alias("at"))))
    closing = F.transform(F.filter(brc, lambda b: b["step"] < 0), lambda b: F.struct(
        b["depth"].alias("g"), b["pos"].alias("at"), b["line"].alias("line")))
    return X.let(queries, lambda q: X.let(closing, lambda c: X.next_in_order(c, q, lambda found: found)))


def _indent_ends(fns: Column, lines: Column) -> Column:
    """For each function the line before which its indented block ends (null: it goes on to the end of the file): the
    first non-blank line indented less than the first non-blank one.

    ``fns`` carry the rest of their header line.  Every indentation that a body starts with is a group of the lines
    indented less; a file has few (k different ones take k * k / 2 characters).
    """
    full = F.filter(F.transform(lines, lambda l, i: F.struct(
        (i + 1).alias("at"), X.has_text(l).alias("t"), X.leading_ws_len(l).alias("ind"))), lambda l: l["t"])

    def block(full: Column) -> Column:
        points = F.transform(full, lambda l: F.struct(F.lit(0).alias("g"), l["at"].alias("at"), l["ind"].alias("ind")))
        after = F.transform(fns, lambda f: F.struct(F.lit(0).alias("g"), f["end_line"].alias("at")))

        def ends(first: Column) -> Column:
            queries = F.transform(fns, lambda f, i: F.struct(
                F.when(X.has_text(f["rest"]), X.leading_ws_len(f["rest"])).otherwise(F.coalesce(F.get(first, i)["ind"], F.lit(0))).alias("g"),
                f["end_line"].alias("at")))

            def by_level(q: Column) -> Column:
                less = F.flatten(F.transform(F.array_distinct(F.transform(q, lambda x: x["g"])), lambda level: F.transform(
                    F.filter(full, lambda l: l["ind"] < level), lambda l: F.struct(level.alias("g"), l["at"].alias("at")))))
                return X.let(less, lambda p: X.next_in_order(p, q, lambda found: F.transform(found, lambda x: x["at"])))
            return X.let(queries, by_level)
        return X.let(points, lambda p: X.let(after, lambda q: X.next_in_order(p, q, ends)))
    return X.let(full, block)


def analyze(files: DataFrame, rules: LanguageRules = DEFAULT_RULES) -> DataFrame:
    """All per-file extraction results in one row per file.

    Output columns: ``repo, path, language, parsing_error`` plus nested
    ``functions, classes, imports, comments, variables, docstrings`` and the
    flat metric columns of ``file_metrics``.  ``content`` is not kept.
    """
    tables = _tables(rules)
    lang = F.col("language")
    content = F.col("content")

    # Stage 1: one pass per pattern over the content.
    stage1 = [F.col(c) for c in ("repo", "path", "language", "content")]
    # Unreadable (null) content yields empty symbol lists, as a failed file
    # does in the analysed tool; its metrics stay null (excluded by ``valid``).
    empty_s = F.array().cast("array<string>")
    for job in _POSITIONED:
        m, s = X.match_spans(content, lang, tables[job], BODY_PREVIEW_CHARS + 1 if job == "fn" else None)
        stage1 += [F.coalesce(m, empty_s).alias(f"{job}_m"),
                   F.coalesce(s, F.array().cast(X.SEGMENTS if job == "fn" else "array<struct<l:int,n:int>>")).alias(f"{job}_s")]
    # the text from each class header to the next
    cls_w = X.by_language(lang, tables["cls"], lambda p: F.split(content, p, -1), empty_s)
    stage1.append(F.coalesce(cls_w, empty_s).alias("cls_w"))
    is_py = lang == "python"
    has_braces = ~is_py & F.contains(content, F.lit("{"))
    for name, part in zip(("brc_m", "brc_s"), X.braces(content)):
        stage1.append(F.when(has_braces, part).alias(name))
    for job in _PLAIN:
        m = X.by_language(lang, tables[job], lambda p: F.regexp_extract_all(content, F.lit(p), 0), empty_s)
        stage1.append(F.coalesce(m, empty_s).alias(f"{job}_m"))
    stage1.append(F.split(content, "\n", -1).alias("lines"))
    df = files.select(*stage1)

    # Stage 2: positions of every match.
    stage2 = [F.col(c) for c in ("repo", "path", "language", "content", "lines", "imp_m", "var_m", "cls_w")]
    stage2.append(F.when(F.size("fn_m") > 0, _tails(F.col("fn_m"), F.col("fn_s.head"))).alias("tails"))
    stage2.append(F.coalesce(X.brace_depths(F.col("brc_m"), F.col("brc_s")), F.array().cast("array<struct<pos:int,line:int,step:int,depth:int>>")).alias("brc"))
    stage2 += [X.positioned(F.col(f"{j}_m"), F.col(f"{j}_s")).alias(f"{j}_p") for j in _POSITIONED]
    df = df.select(*stage2)

    # Stage 3: the functions, then where each body ends.
    fn_name = lambda r: X.first_group(r["text"], lang, rules.functions)
    fns = F.filter(
        F.transform(F.col("fn_p"), lambda r, i: F.struct(
            fn_name(r).alias("name"), r["line"].alias("line"), X.py_strip(r["text"]).alias("signature"),
            (r["start"] + F.length(r["text"])).alias("end0"),
            (r["line"] + X.newlines(r["text"])).alias("end_line"),
            F.endswith(r["text"], F.lit("{")).alias("opens"),
            F.get("tails", i).alias("tail"), F.substring_index(F.get("tails", i), "\n", 1).alias("rest"))),
        lambda f: f["name"].isNotNull() & ~F.startswith(f["name"], F.lit("_"))
        & ~(lang.isin(*CONTROL_NAME_LANGUAGES) & f["name"].isin(*NOT_FUNCTION_NAMES)))
    df = df.select("*", fns.alias("fns")).drop("fn_p", "tails")
    df = df.select("*", F.when(~is_py & (F.size("fns") > 0), _brace_ends(F.col("fns"), F.col("brc"))).alias("closes"),
                   F.when(is_py & (F.size("fns") > 0), _indent_ends(F.col("fns"), F.col("lines"))).alias("stops"))

    def function_of(f: Column, i: Column) -> Column:
        close, stop, n = F.get("closes", i), F.get("stops", i), F.size("lines")
        taken = F.coalesce(stop, n + 1) - f["end_line"]
        body = F.when(is_py, F.call_function("substring_index", f["tail"], F.lit("\n"), taken)) \
            .otherwise(F.when(close.isNull(), f["tail"]).otherwise(F.substring(f["tail"], F.lit(1), close["at"] - f["end0"] + 1)))
        whole = F.when(is_py, taken).otherwise(F.coalesce(close["line"], n) - f["end_line"] + 1)
        return X.let(F.struct(body.alias("t"), whole.alias("n")), lambda b: F.struct(
            i.alias("ord"), f["name"].alias("name"), f["line"].alias("line"), f["signature"].alias("signature"),
            F.when(F.length(b["t"]) > BODY_PREVIEW_CHARS, F.concat(F.substring(b["t"], 1, BODY_PREVIEW_CHARS), F.lit("...")))
             .otherwise(b["t"]).alias("body_preview"),
            F.when(F.length(b["t"]) > 0, b["n"]).otherwise(1).alias("estimated_lines")))

    functions = F.transform(F.col("fns"), function_of)

    method_table = {l: rules.method_pattern(l) for l in rules.classes if rules.method_pattern(l)}

    def methods_of(window: Column) -> Column:
        found = X.by_language(lang, method_table, lambda p: F.regexp_extract_all(window, F.lit(p), 0),
                              F.array().cast("array<string>"))
        names = F.transform(found, lambda m: X.first_group(m, lang, method_table))
        return F.filter(names, lambda n: n.isNotNull()
                        & ~(lang.isin(*CONTROL_NAME_LANGUAGES) & n.isin(*NOT_FUNCTION_NAMES)))

    # each class reads only its own piece of the file
    classes = F.transform(F.col("cls_p"), lambda r, i: F.struct(
        i.alias("ord"), X.first_group(r["text"], lang, rules.classes, 1).alias("name"),
        r["line"].alias("line"), X.py_strip(r["text"]).alias("signature"),
        methods_of(F.get("cls_w", i + 1)).alias("methods")))
    classes = F.transform(classes, lambda c: F.struct(
        c["ord"].alias("ord"), c["name"].alias("name"), c["line"].alias("line"),
        c["signature"].alias("signature"), c["methods"].alias("methods"),
        F.size(c["methods"]).alias("method_count")))

    imports = F.filter(F.transform(F.col("imp_m"), X.py_strip), lambda s: F.length(s) > 0)
    imports = F.transform(imports, lambda s, i: F.struct(i.alias("ord"), s.alias("stmt"),
                                                           import_module(s).alias("module")))

    comments = F.filter(F.transform(F.col("cmt_p"), lambda r: F.struct(
        X.py_strip(r["text"]).alias("text"), r["line"].alias("line"))), lambda c: F.length(c["text"]) > 3)
    comments = F.transform(comments, lambda c, i: F.struct(
        i.alias("ord"), c["text"].alias("text"), c["line"].alias("line"),
        F.when(F.startswith(c["text"], F.lit("/*")), "multi").otherwise("single").alias("kind")))

    var_names = F.transform(F.col("var_m"), lambda m: X.first_group(m, lang, rules.variables))
    variables = F.sort_array(F.array_distinct(F.filter(
        var_names, lambda n: n.isNotNull() & ~F.startswith(n, F.lit("_")))))

    # a docstring is what stands between its three quotes
    docs = F.filter(F.transform(F.col("doc_p"), lambda r: F.struct(
        X.py_strip(F.substring(r["text"], F.lit(4), F.length(r["text"]) - 6)).alias("text"), r["line"].alias("line"))),
        lambda d: F.coalesce(F.length(d["text"]), F.lit(0)) > 10)
    docstrings = F.transform(docs, lambda d, i: F.struct(
        i.alias("ord"), d["text"].alias("text"), d["line"].alias("line"), F.length(d["text"]).alias("length")))

    total_lines = F.size("lines")
    code_lines = F.size(F.filter(F.col("lines"), X.has_text))
    complexity = F.size(F.regexp_extract_all(content, F.lit(KEYWORD_PATTERN), 0))
    lower = F.lower(content)

    df = df.select(
        "repo", "path", "language",
        F.when(content.isNull(), F.lit("unreadable content")).alias("parsing_error"),
        functions.alias("functions"), classes.alias("classes"), imports.alias("imports"),
        F.size("fns").alias("n_functions"), F.size("cls_p").alias("n_classes"), F.size(imports).alias("n_imports"),
        comments.alias("comments"), variables.alias("variables"), docstrings.alias("docstrings"),
        total_lines.alias("total_lines"), code_lines.alias("code_lines"),
        complexity.alias("complexity"),
        F.contains(lower, F.lit("main")).alias("has_main"),
        X.contains_any(lower, TEST_CONTENT_WORDS).alias("has_tests"),
        content.rlike(DOC_BLOCK_PATTERN).alias("has_documentation"),
        F.when(F.contains(content, F.lit("\t")), "tabs").otherwise("spaces").alias("indentation_style"),
        F.length(content).alias("n_chars"))
    return df.select(
        "*",
        (F.col("total_lines") - F.col("code_lines")).alias("blank_lines"),
        maintainability_score(F.col("code_lines"), F.col("complexity")).alias("maintainability_score"),
        ((F.col("n_chars") - (F.col("total_lines") - 1)) / F.col("total_lines")).alias("avg_line_length"),
    ).withColumn("maintainability", maintainability_level(F.col("maintainability_score"))).drop("n_chars")


class _Steps:
    """The calls made on it in place of a frame, to be made on frames later."""

    def __init__(self, calls: tuple = ()):
        self._calls = calls

    def __getattr__(self, name: str):
        return lambda *args, **kw: _Steps((*self._calls, (name, args, kw)))

    def made_on(self, df: DataFrame) -> DataFrame:
        for name, args, kw in self._calls:
            df = getattr(df, name)(*args, **kw)
        return df


def analysis(rules: LanguageRules = DEFAULT_RULES) -> Callable[[DataFrame], DataFrame]:
    """``analyze`` for many frames of one session: its columns, some tens of thousands of calls to the JVM, are built once."""
    return analyze(_Steps(), rules).made_on


def first_symbols(analyzed: DataFrame, imports: int = IMPORT_CAP, comments: int = COMMENT_CAP,
                  variables: int = VARIABLE_CAP, docstrings: int = DOCSTRING_CAP, methods: int = METHOD_CAP) -> DataFrame:
    """A view with only the first symbols of each kind per file (methods: per class), as the analysed tool lists them.

    Counts stay those of the whole file; every other table is built on the whole lists.
    """
    limits = {"imports": imports, "comments": comments, "variables": variables, "docstrings": docstrings}
    return analyzed.withColumns({c: F.slice(c, 1, k) for c, k in limits.items()} | {
        "classes": F.transform("classes", lambda c: c.withField("methods", F.slice(c["methods"], 1, methods)))})


def metrics_only(files: DataFrame) -> DataFrame:
    """C10–C12 without symbol extraction (cheaper for plain text corpora)."""
    content = F.col("content")
    lines = F.split(content, "\n", -1)
    lower = F.lower(content)
    df = files.select(
        "repo", "path", "language",
        F.size(lines).alias("total_lines"),
        F.size(F.filter(lines, X.has_text)).alias("code_lines"),
        F.size(F.regexp_extract_all(content, F.lit(KEYWORD_PATTERN), 0)).alias("complexity"),
        F.contains(lower, F.lit("main")).alias("has_main"),
        X.contains_any(lower, TEST_CONTENT_WORDS).alias("has_tests"),
        content.rlike(DOC_BLOCK_PATTERN).alias("has_documentation"),
        F.when(F.contains(content, F.lit("\t")), "tabs").otherwise("spaces").alias("indentation_style"),
        F.length(content).alias("n_chars"))
    return df.select(
        "repo", "path", "language", "total_lines", "code_lines",
        (F.col("total_lines") - F.col("code_lines")).alias("blank_lines"), "complexity",
        maintainability_score(F.col("code_lines"), F.col("complexity")).alias("maintainability_score"),
        "has_main", "has_tests", "has_documentation", "indentation_style",
        ((F.col("n_chars") - (F.col("total_lines") - 1)) / F.col("total_lines")).alias("avg_line_length"),
    ).withColumn("maintainability", maintainability_level(F.col("maintainability_score")))


def maintainability_score(code_lines: Column, complexity: Column) -> Column:
    """C11: max(0, 100 - code_lines // 10 - 3 * complexity)."""
    return F.greatest(F.lit(0), F.lit(100) - F.floor(code_lines / 10).cast("int") - complexity * 3)


def maintainability_level(score: Column) -> Column:
    return F.when(score >= 80, "High").when(score >= 60, "Medium").otherwise("Low")


def import_module(stmt: Column) -> Column:
    """Normalised module of an import statement (language-agnostic rules)."""
    s = X.py_strip(stmt)
    parts = X.py_split(s)
    n = F.size(parts)
    include = (F.when(F.contains(s, F.lit("<")), F.split(F.split(s, "<")[1], ">")[0])
               .when(F.contains(s, F.lit('"')), F.split(s, '"')[1])
               .otherwise(s))
    return (F.when(F.length(s) == 0, s)
            .when(F.startswith(s, F.lit("from")) & (n >= 2), parts[1])
            .when(F.startswith(s, F.lit("import")) & (n >= 2), F.split(parts[1], r"\.")[0])
            .when(F.startswith(s, F.lit("from")) | F.startswith(s, F.lit("import")), parts[0])
            .when(F.startswith(s, F.lit("#include")), include)
            .otherwise(parts[0]))


# ---------------------------------------------------------------------------
# Long views of ``analyze`` (narrow explodes).
# ---------------------------------------------------------------------------

def functions(analyzed: DataFrame) -> DataFrame:
    return (X.explode_rows(analyzed, "functions", "f", "repo", "path", "language")
            .select("repo", "path", "language", "f.ord", "f.name", "f.line", "f.signature",
                    "f.body_preview", "f.estimated_lines"))


def classes(analyzed: DataFrame) -> DataFrame:
    return (X.explode_rows(analyzed, "classes", "c", "repo", "path", "language")
            .select("repo", "path", "language", "c.ord", "c.name", "c.line", "c.signature", "c.method_count"))


def methods(analyzed: DataFrame) -> DataFrame:
    c = X.explode_rows(analyzed, "classes", "c", "repo", "path").select(
        "repo", "path", F.col("c.ord").alias("class_ord"), F.col("c.methods").alias("methods"))
    return X.posexplode_rows(c, "methods", "ord", "name", "repo", "path", "class_ord")


def imports(analyzed: DataFrame) -> DataFrame:
    return (X.explode_rows(analyzed, "imports", "i", "repo", "path", "language")
            .select("repo", "path", "language", "i.ord", "i.stmt", "i.module"))


def comments(analyzed: DataFrame) -> DataFrame:
    return (X.explode_rows(analyzed, "comments", "c", "repo", "path", "language")
            .select("repo", "path", "language", "c.ord", "c.text", "c.line", "c.kind"))


def variables(analyzed: DataFrame) -> DataFrame:
    return X.explode_rows(analyzed, "variables", "name", "repo", "path", "language")


def docstrings(analyzed: DataFrame) -> DataFrame:
    return (X.explode_rows(analyzed, "docstrings", "d", "repo", "path")
            .select("repo", "path", "d.ord", "d.text", "d.line", "d.length"))


METRIC_COLUMNS = ["repo", "path", "language", "total_lines", "code_lines", "blank_lines", "complexity",
                  "maintainability_score", "maintainability", "has_main", "has_tests",
                  "has_documentation", "indentation_style", "avg_line_length"]


def file_metrics(analyzed: DataFrame) -> DataFrame:
    return analyzed.select(*METRIC_COLUMNS)
