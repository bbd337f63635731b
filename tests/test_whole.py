"""Whole tables, right labels: no cut, no mixed groups, no null taken for absence."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from sourcelens.functions.rules import LanguageRules
from sourcelens.operators import extract as E
from sourcelens.operators import retrieval as RT
from sourcelens.sources import corpus as SRC
from sourcelens.sources import snapshot as SNAP


def test_nothing_is_cut(analyze_rows):
    n = 60
    src = "\n".join([f"import mod{i}" for i in range(n)] + [f"# remark number {i}" for i in range(n)]
                    + [f"var_{i:02d} = {i}" for i in range(n)] + [f'"""docstring number {i}"""' for i in range(n)]
                    + ["class Big:"] + [f"    def method_{i}(self):\n        return {'1' * 30}" for i in range(n)])
    r = analyze_rows([("a.py", "python", src)])["a.py"]
    assert len(r["imports"]) == len(r["comments"]) == len(r["variables"]) == len(r["docstrings"]) == n
    assert r["classes"][0]["methods"] == [f"method_{i}" for i in range(n)]
    assert r["n_imports"] == n


@pytest.mark.parametrize("language,src,name", [
    ("rust", "pub fn new(x: i32) -> T { T }", "new"), ("ruby", "def try(x)\nend", "try"), ("go", "func new(a int) int { }", "new"),
    ("php", "function case() {}", "case"), ("kotlin", "fun catch() {}", "catch"), ("swift", "func new() {}", "new"),
    ("javascript", "function new(a) {}", "new"), ("python", "def case(x):\n    return 1", "case")])
def test_names_like_control_statements_are_names(analyze_rows, language, src, name):
    assert [f["name"] for f in analyze_rows([("a", language, src)])["a"]["functions"]] == [name]


@pytest.mark.parametrize("language", ["c", "cpp", "java"])
def test_control_statements_are_no_functions(analyze_rows, language):
    src = "int run(int a) {\n  if (a) {\n  }\n  while (a) {\n  }\n}\n"
    names = [f["name"] for f in analyze_rows([("a", language, src)])["a"]["functions"]]
    assert "if" not in names and "while" not in names


def test_positions_of_many_matches(analyze_rows):
    n = 3_000
    src = "\n".join(f"x  # c{i:04d}" + "\n" * (i % 3) for i in range(n))
    r = analyze_rows([("a.py", "python", src)])["a.py"]
    lines = [k for k, line in enumerate(src.split("\n"), 1) if "#" in line]
    assert [c["line"] for c in r["comments"]] == lines


def test_positions_cost_less_than_the_square(spark, files_of):
    def seconds(n):
        files = files_of([("a.py", "python", "# some remark\n" * n)])
        begun = time.perf_counter()
        E.analyze(files).select(F.size("comments")).collect()
        return time.perf_counter() - begun
    seconds(100)
    small, large = seconds(3_000), seconds(12_000)
    assert large < 9 * small + 1


def test_one_question_for_every_repository(spark):
    docs = spark.createDataFrame([("a", "d1", "s", "t", "alpha beta gamma"), ("a", "d2", "s", "t", "beta delta"),
                                  ("b", "d1", "s", "t", "alpha omega"), ("b", "d2", "s", "t", "alpha alpha zeta")],
                                 "repo string, doc_id string, source string, type string, text string")
    ask = lambda repo: spark.createDataFrame([(repo, "q", "alpha beta")], "repo string, qid string, text string")
    both = RT.search(RT.build_index(docs, group="repo", max_df=1.0), ask("a").union(ask("b"))).collect()
    for repo in ("a", "b"):
        alone = RT.search(RT.build_index(docs.where(F.col("repo") == repo), group="repo", max_df=1.0), ask(repo)).collect()
        assert sorted(r for r in both if r["repo"] == repo) == sorted(alone) and alone
    answers = RT.answers(RT.build_index(docs, group="repo", max_df=1.0), ask("a").union(ask("b"))).collect()
    assert sorted(r["repo"] for r in answers) == ["a", "b"]


def test_search_in_blocks_gives_the_same(spark):
    docs = spark.createDataFrame([(i, "s", "t", f"word{i % 7} word{i % 5} word{i % 3}") for i in range(40)],
                                 "doc_id int, source string, type string, text string")
    questions = spark.createDataFrame([(i, f"word{i} word{i + 1}") for i in range(6)], "qid int, text string")
    index = RT.build_index(docs)
    rows = [sorted(RT.search(index, questions, block_bytes=b).collect()) for b in (1 << 20, 1_500, 200)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 30


def test_unreadable_content_is_no_missing_file(spark):
    old = spark.createDataFrame([("r", "a", "x"), ("r", "b", None), ("r", "c", None), ("r", "d", "x"), ("r", "e", "x")], "repo string, path string, content string")
    new = spark.createDataFrame([("r", "a", None), ("r", "b", "y"), ("r", "c", None), ("r", "d", "x"), ("r", "f", None)], "repo string, path string, content string")
    got = {r["path"]: r["change"] for r in SNAP.changed_files(new, old).collect()}
    assert got == {"a": "modified", "b": "modified", "e": "deleted", "f": "added"}
    results = old.select("repo", "path", F.lit(1).alias("v"))
    fresh = SNAP.refresh(new, results, old, lambda f: f.select("repo", "path", F.lit(2).alias("v")))
    assert {r["path"]: r["v"] for r in fresh.collect()} == {"a": 2, "b": 2, "c": 1, "d": 1, "f": 2}


def test_several_roots_of_any_form(spark, tmp_path, monkeypatch):
    for name in ("one", "two"):
        (tmp_path / "src" / name / "pkg").mkdir(parents=True)
        (tmp_path / "src" / name / "pkg" / "m.py").write_text("x = 1\n")
    want = {("one", "pkg/m.py"), ("two", "pkg/m.py")}
    roots = [str(tmp_path / "src" / n) for n in ("one", "two")]
    for form in (roots, ["file://" + r for r in roots], [r + "/" for r in roots], [os.path.relpath(r) for r in roots]):
        got = {(r["repo"], r["path"]) for r in SRC.scan_corpus(spark, form).collect()}
        assert got == want, form
    deep = SRC.scan_corpus(spark, str(tmp_path / "src"), repo_depth=1).collect()
    assert {(r["repo"], r["path"]) for r in deep} == want


@pytest.mark.parametrize("pattern", ["x*", "(unclosed", "a|", "(?=x)", "", r"\b", "(a)(b)(c)", "noname"])
def test_patterns_that_cannot_work_are_refused(pattern):
    with pytest.raises(ValueError):
        LanguageRules().register("lang", [".l"], function=pattern)


def test_patterns_that_work_are_taken():
    rules = LanguageRules().register("lang", [".l"], function=r"proc\s+(\w+)", comment="--[^\n]*")
    assert rules.functions["lang"] and rules.suffixes[".l"] == "lang"


def test_search_makes_no_row_for_a_question_and_a_document(spark):
    r = random.Random(5)
    text = lambda n: " ".join(f"word{r.randint(0, 30)}" for _ in range(n))
    rows = [(i, "s", "t", text(12)) for i in range(60)] + [(7, "s", "t", text(9)), (None, "s", "t", text(12)), (3, "s", "t", None)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, type string, text string")
    asked = [(i, text(4)) for i in range(25)] + [(4, text(3)), (25, " "), (26, None)]
    index = RT.build_index(docs)
    vectors = {}
    for v in RT.query_vectors(index, spark.createDataFrame(asked, "qid int, text string")).collect():
        vectors.setdefault(v["qid"], []).append((v["term"], v["qw"]))
    weights = {}
    for p in index.postings.collect():
        weights.setdefault(p["term"], []).append((p["doc_id"], p["weight"]))
    want = set()
    for q, terms in vectors.items():
        total = {}
        for term, qw in terms:
            for d, w in weights[term]:
                total[d] = total.get(d, 0.0) + qw * w
        best = sorted(((-round(s, 9), d is not None, d) for d, s in total.items() if round(s, 9) > 0.1))[:5]
        want |= {(q, d, i + 1, -s) for i, (s, _, d) in enumerate(best)}
    found = RT.search(index, spark.createDataFrame(asked, "qid int, text string"), block_bytes=500)
    assert {tuple(h) for h in found.select("qid", "doc_id", "rank", "score").collect()} == want and len(want) > 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" in plan and "keys=[doc_id" not in plan
