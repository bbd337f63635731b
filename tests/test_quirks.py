"""One test per documented fix of the analysed tool's quirks."""

from sourcelens.operators import extract as E
from sourcelens.functions.rules import LanguageRules, validate_pattern

import pytest


def test_line_comments_stop_at_newline(analyze_rows):  # Q1, Q2
    r = analyze_rows([("a.py", "python", "# first comment\nx = 1\n# second one\n")])["a.py"]
    assert [(c["text"], c["line"], c["kind"]) for c in r["comments"]] == \
        [("# first comment", 1, "single"), ("# second one", 3, "single")]


def test_python_imports_one_per_line(analyze_rows):  # Q3
    r = analyze_rows([("a.py", "python", "import os\nimport sys\nvalue = 1\nfrom x import (\n  a)\n")])["a.py"]
    assert [i["stmt"] for i in r["imports"]] == ["import os", "import sys", "from x import ("]
    assert [i["module"] for i in r["imports"]] == ["os", "sys", "x"]


def test_python_return_annotation(analyze_rows):  # Q4
    r = analyze_rows([("a.py", "python", "def typed(a: int) -> Dict[str, int]:\n    return {}\n")])["a.py"]
    assert [f["name"] for f in r["functions"]] == ["typed"]


def test_control_statements_are_not_functions(analyze_rows):  # Q5
    src = "void run(int a) {\n  if (a) {\n    a = 1;\n  } else if (a > 2) {\n  }\n  for (;;) {\n  }\n}\n"
    r = analyze_rows([("a.c", "c", src)])["a.c"]
    assert [f["name"] for f in r["functions"]] == ["run"]


def test_python_body_keeps_straight_line_code(analyze_rows):  # Q6
    src = "def f():\n    a = 1\n    b = 2\n    return a + b\nx = 3\n"
    fn = analyze_rows([("a.py", "python", src)])["a.py"]["functions"][0]
    assert fn["body_preview"] == "\n    a = 1\n    b = 2\n    return a + b"
    assert fn["estimated_lines"] == 4


def test_brace_body_closes_at_own_brace(analyze_rows):  # Q7
    src = "public class A {\n  public int get(int a) {\n    if (a) { a = 1; }\n    return a;\n  }\n  int z;\n}\n"
    fn = analyze_rows([("A.java", "java", src)])["A.java"]["functions"][0]
    assert fn["body_preview"] == "\n    if (a) { a = 1; }\n    return a;\n  }"


def test_multi_group_methods(analyze_rows):  # Q8
    src = "class Box {\n  build() {}\n}\nconst make = (a) => a;\nfunction helper(x) {}\n"
    cls = analyze_rows([("a.js", "javascript", src)])["a.js"]["classes"][0]
    assert cls["methods"] == ["make", "helper"]


def test_variables_are_whole_and_sorted(spark, files_of):  # Q12
    src = "\n".join(f"v{i:02d} = {i}" for i in range(30, 0, -1))
    whole = E.analyze(files_of([("a.py", "python", src)]))
    assert whole.first()["variables"] == [f"v{i:02d}" for i in range(1, 31)]
    assert E.first_symbols(whole).first()["variables"] == [f"v{i:02d}" for i in range(1, 16)]


def test_ssh_url_name(spark):  # Q21
    from sourcelens.sources.corpus import repo_registry
    df = spark.createDataFrame([("git@github.com:owner/name.git",)], "url string")
    assert repo_registry(df).collect()[0]["repo"] == "owner/name"


def test_register_language(files_of, spark):  # U1
    from sourcelens.operators import extract as E
    rules = LanguageRules().register("lua", [".lua"], function=r"function\s+(\w+)\s*\(",
                                     imports=r"require\s*\(?['\"][^'\"]+['\"]\)?", comment=r"--[^\n]*")
    files = files_of([("m.lua", "lua", "local x = require('mod')\nfunction go(a)\nend\n-- done here\n")])
    r = E.analyze(files, rules).collect()[0]
    assert [f["name"] for f in r["functions"]] == ["go"]
    assert [i["stmt"] for i in r["imports"]] == ["require('mod')"]
    assert [c["text"] for c in r["comments"]] == ["-- done here"]


def test_pattern_validation():
    with pytest.raises(ValueError):
        validate_pattern(r"(?=x)abc")
    with pytest.raises(ValueError):
        validate_pattern(r"a{b")


def test_unreadable_file_has_empty_symbols(spark):  # Q18 / B3
    from sourcelens.operators import extract as E
    from sourcelens.operators import stats as S
    from sourcelens.sources.corpus import corpus_from_table
    df = spark.createDataFrame([("r", "ok.py", "python", "def f():\n    return 1\n"), ("r", "bad.py", "python", None)],
                               "repo string, path string, language string, content string")
    an = E.analyze(corpus_from_table(df))
    counts = {r["path"]: (r["imports"], r["functions"], r["classes"]) for r in S.file_counts(an).collect()}
    assert counts == {"ok.py": (0, 1, 0), "bad.py": (0, 0, 0)}
    s = S.repo_summary(an).collect()[0]
    assert (s["files"], s["total_functions"]) == (1, 1)
    assert S.repo_facts(an).collect()[0]["total_files"] == 2
