"""The analysed tool's own test cases, re-expressed on the Spark jobs."""

import json

from pyspark.sql import functions as F

from sourcelens.functions.rules import SUFFIX_LANGUAGE
from sourcelens.operators import extract as E
from sourcelens.operators import stats as S
from sourcelens.sources import corpus as SRC

PY_FUNCS = """# helpers
def area(width, height):
    return width * height


def greet(name) -> str:
    return "hi " + name
"""

PY_CLASSES = """class Shape:
    def new(self):
        return 1

    def case(self):
        return 2

class Circle(Shape):
    def area(self):
        return 3
"""

PY_IMPORTS = """import json, re
import os.path
from collections import OrderedDict
from a.b import c as d
"""

PY_NESTED = """def walk(rows):
    for row in rows:
        if row:
            while row.next:
                row = row.next

    else:
        return None
"""


def test_suffix_map():
    assert SUFFIX_LANGUAGE[".py"] == "python"
    assert len(SUFFIX_LANGUAGE) == 14 and len(set(SUFFIX_LANGUAGE.values())) == 12


def test_python_functions(analyze_rows):
    fns = analyze_rows([("a.py", "python", PY_FUNCS)])["a.py"]["functions"]
    assert [f["name"] for f in fns] == ["area", "greet"]
    assert [f["line"] for f in fns] == [2, 6]


def test_python_classes(analyze_rows):
    cls = analyze_rows([("a.py", "python", PY_CLASSES)])["a.py"]["classes"]
    assert [c["name"] for c in cls] == ["Shape", "Circle"]
    assert [c["line"] for c in cls] == [1, 8]
    # each class has the methods up to the next class; names like those of control statements are names here
    assert [c["methods"] for c in cls] == [["new", "case"], ["area"]]


def test_python_imports(analyze_rows):
    imps = analyze_rows([("a.py", "python", PY_IMPORTS)])["a.py"]["imports"]
    assert [i["module"] for i in imps] == ["json,", "os", "collections", "a.b"]


def test_complexity(analyze_rows):
    r = analyze_rows([("a.py", "python", PY_NESTED)])["a.py"]
    assert (r["total_lines"], r["code_lines"], r["blank_lines"], r["complexity"]) == (9, 7, 2, 4)
    assert r["maintainability_score"] == 88 and r["maintainability"] == "High"


def test_url_helpers(spark):
    urls = ["https://github.com/user/repo", "git@github.com:user/repo.git", "https://gitlab.com/user/repo",
            "not-a-url", "", "https://github.com/user/repo.git"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: r["repo"] for r in SRC.repo_registry(df).collect()}
    assert set(got) == {"https://github.com/user/repo", "git@github.com:user/repo.git",
                        "https://github.com/user/repo.git"}
    assert set(got.values()) == {"user/repo"}


def test_repo_info(spark):
    ok = json.dumps({"name": "repo", "description": "A test repo", "language": "Python",
                     "stargazers_count": 10, "forks_count": 5})
    df = spark.createDataFrame([("user/repo", 200, ok), ("user/missing", 404, "{}")],
                               "repo string, status int, body string")
    rows = SRC.load_repo_info(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["name"], r["description"], r["language"], r["stars"], r["forks"], r["size"], r["topics"]) == \
        ("repo", "A test repo", "Python", 10, 5, 0, [])


def test_directory_scan(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "mod.py").write_text("import os\r\ndef run():\r\n    return 1\r\n")
    (tmp_path / "main.js").write_text("function go(x) { return x; }\n")
    (tmp_path / "notes.md").write_text("# not code\n")
    (tmp_path / "big.py").write_text("x = 1\n" * 10000)
    (tmp_path / "bad.py").write_bytes(b"def ok():\n    pass\n\xff\xfe\n")
    files = SRC.scan_corpus(spark, str(tmp_path), repo="demo")
    rows = {r["path"]: r for r in files.collect()}
    assert set(rows) == {"pkg/mod.py", "main.js", "bad.py", "big.py"} and rows["big.py"]["lines"] == 10_001
    small = SRC.scan_corpus(spark, str(tmp_path), repo="demo", max_bytes=50_000)
    assert {r["path"] for r in small.collect()} == {"pkg/mod.py", "main.js", "bad.py"}
    skipped = SRC.skipped_files(spark, str(tmp_path), repo="demo", max_bytes=50_000).collect()
    assert [(r["path"], r["size_bytes"], r["skip_reason"]) for r in skipped] == [("big.py", 60_000, "too_large")]
    assert SRC.skipped_files(spark, str(tmp_path), repo="demo").count() == 0
    assert rows["pkg/mod.py"]["content"] == "import os\ndef run():\n    return 1\n"
    assert rows["pkg/mod.py"]["language"] == "python" and rows["pkg/mod.py"]["lines"] == 4
    assert rows["bad.py"]["content"] == "def ok():\n    pass\n\n"
    stats = {(r["language"]): r["files"] for r in S.language_stats(files).where(F.col("repo").isNotNull()).collect()}
    assert stats["python"] == 3 and stats["javascript"] == 1


def test_end_to_end_summary(spark, files_of):
    files = files_of([("a.py", "python", PY_FUNCS), ("b.py", "python", PY_CLASSES),
                      ("c/app.js", "javascript", "const f = (a) => { return a; };\n")])
    an = E.analyze(files)
    s = S.repo_summary(an).collect()[0]
    assert (s["files"], s["total_functions"], s["total_classes"]) == (3, 6, 2)
    recs = [r["rule"] for r in S.recommendations(S.repo_facts(an)).collect()]
    assert 0 not in recs


def test_project_context_with_repo_info(spark, files_of):  # E5 / D14
    import json
    body = json.dumps({"name": "Demo", "description": "A demo repository", "stargazers_count": 3})
    repos = SRC.load_repo_info(spark.createDataFrame([("r", 200, body)], "repo string, status int, body string"))
    an = E.analyze(files_of([("a.py", "python", PY_FUNCS), ("b/c.js", "javascript", "function go(x) {}\n")]))
    ctx = S.project_context(an, repos).collect()[0]["context"]
    assert ctx == ("Project: Demo | Description: A demo repository | Languages: ['python', 'javascript'] | "
                   "Total files: 2 | Functions: 3 | Classes: 0")
    plain = S.project_context(an).collect()[0]["context"]
    assert plain.startswith("Project: r | Languages: ")


def test_language_subset_and_quarantine(spark, files_of):  # B2, B4
    files = files_of([("a.py", "python", "x = 1\n"), ("b.js", "javascript", "let y = 2\n"),
                      ("c.py", "python", "z" * 60000), ("d.py", "python", None)])
    assert [r["path"] for r in SRC.select_languages(files, ["python"]).orderBy("path").collect()] == \
        ["a.py", "c.py", "d.py"]
    q = {r["path"]: (r["kept"], r["skip_reason"]) for r in SRC.quarantine(files).collect()}
    assert q == {"a.py": (True, None), "b.js": (True, None), "c.py": (False, "too_large"),
                 "d.py": (False, "unreadable")}
