"""One snippet per language for each extraction job (hand-derived expectations)."""

import pytest

SNIPPETS = {
    "typescript": ("a.ts", 'import { X } from "./x";\nexport class Svc extends Base implements I {\n'
                   "  run() {}\n}\nfunction top(a: number) { return a; }\nconst arrow: Fn = (a) => a;\n// note here\n",
                   ["top", "arrow"], ["Svc"], ['import { X } from "./x"']),
    "c": ("a.c", "#include <stdio.h>\nstruct point { int x; };\nint add(int a, int b) {\n  return a + b;\n}\n"
          "/* block\n comment */\n", ["add"], ["point"], ["#include <stdio.h>"]),
    "cpp": ("a.cpp", '#include "util.h"\nclass Shape : public Base {\n};\nint Shape::area() const {\n  return 1;\n}\n',
            ["area"], ["Shape"], ['#include "util.h"']),
    "rust": ("a.rs", "use std::io;\npub struct Cfg { a: i32 }\nfn main() {\n    let mut x = 1;\n}\n",
             ["main"], ["Cfg"], ["use std::io;"]),
    "php": ("a.php", "<?php\nrequire_once 'lib.php';\nabstract class Repo extends Base {\n"
            "  public static function find($id) { return 1; }\n}\n# hash comment\n",
            ["find"], ["Repo"], ["require_once 'lib.php';"]),
    "ruby": ("a.rb", "require 'json'\nclass User < Base\n  def save(x)\n  end\nend\n# ruby comment\n",
             ["save"], ["User"], ["require 'json'"]),
    "swift": ("a.swift", "import Foundation\npublic final class View: UIView {\n  func draw(rect: Int) {}\n}\n",
              ["draw"], ["View"], ["import Foundation"]),
    "kotlin": ("a.kt", "import kotlin.math.*\nopen class Node : Base() {\n  fun visit(x: Int) {}\n}\n"
               "private fun helper(y: Int) = y\n", ["visit", "helper"], ["Node"], ["import kotlin.math."]),
    "go": ("a.go", 'import "fmt"\ntype S struct {}\nfunc (s *S) Run(a int) {\n}\n', ["Run"], ["S"], ['import "fmt"']),
    "java": ("A.java", "import java.util.List;\npublic class A extends B {\n  private static int count(int n) {\n"
             "    if (n > 0) {\n      return n;\n    }\n    return 0;\n  }\n}\n",
             ["count"], ["A"], ["import java.util.List;"]),
    "javascript": ("a.js", "const lib = require('lib')\nclass Box extends Base {}\nfunction f1(x) { return x; }\n"
                   "let g = function(y) { return y; }\n", ["f1", "g"], ["Box"], ["require('lib')"]),
    "python": ("a.py", "from os import path\nclass K(object):\n    def m(self) -> int:\n        return 1\n",
               ["m"], ["K"], ["from os import path"]),
}


@pytest.fixture(scope="module")
def snippet_rows(spark):
    from sourcelens.operators import extract as E
    from sourcelens.sources.corpus import corpus_from_table
    df = spark.createDataFrame([("r", p, l, c) for l, (p, c, *_rest) in SNIPPETS.items()],
                               "repo string, path string, language string, content string")
    return {r["path"]: r for r in E.analyze(corpus_from_table(df)).collect()}


@pytest.mark.parametrize("language", sorted(SNIPPETS))
def test_extraction_per_language(snippet_rows, language):
    path, content, fns, classes, imports = SNIPPETS[language]
    r = snippet_rows[path]
    assert [f["name"] for f in r["functions"]] == fns
    assert [c["name"] for c in r["classes"]] == classes
    assert [i["stmt"] for i in r["imports"]] == imports


def test_comments_per_language(snippet_rows):
    rows = snippet_rows
    assert [c["text"] for c in rows["a.c"]["comments"]] == ["/* block\n comment */"]
    assert rows["a.c"]["comments"][0]["kind"] == "multi"
    assert [c["text"] for c in rows["a.php"]["comments"]] == ["# hash comment"]
    assert [c["text"] for c in rows["a.rb"]["comments"]] == ["# ruby comment"]
    assert [c["line"] for c in rows["a.ts"]["comments"]] == [7]


def test_variables(analyze_rows):
    r = analyze_rows([("a.go", "go", "var total int\nx := 1\n_y := 2\nvar total int\n"),
                      ("a.rs", "rust", "let mut b = 1;\nlet a = 2;\n")])
    assert r["a.go"]["variables"] == ["total", "x"]
    assert r["a.rs"]["variables"] == ["a", "b"]


def test_unknown_language_yields_nothing(analyze_rows):
    r = analyze_rows([("x.txt", "text", "def f(): pass\nclass A: pass\n")])["x.txt"]
    assert r["functions"] == [] and r["classes"] == [] and r["imports"] == []
    assert r["total_lines"] == 3  # split on "\n" keeps the empty last line


def test_docstrings(analyze_rows):
    src = 'def f():\n    """Return the answer to everything."""\n    return 42\n\'\'\'short\'\'\'\n'
    r = analyze_rows([("d.py", "python", src)])["d.py"]
    assert [(d["text"], d["line"], d["length"]) for d in r["docstrings"]] == \
        [("Return the answer to everything.", 2, 32)]
    assert r["has_documentation"] is True
