"""Whole function bodies and class members against a plain scan, and their cost."""

import random
import time

import pytest

PREVIEW = 200


def brace_body(text, opens):
    depth = 1 if opens else 0
    for i, c in enumerate(text):
        depth += (c == "{") - (c == "}")
        if c == "}" and depth == 0:
            return text[:i + 1]
    return text


def indent_body(text):
    lines, first = text.split("\n"), None
    for k, line in enumerate(lines):
        if line.strip():
            indent = len(line) - len(line.lstrip())
            if first is None:
                first = indent
            elif indent < first:
                return "\n".join(lines[:k])
    return text


def expected(body):
    return body[:PREVIEW] + "..." if len(body) > PREVIEW else body, body.count("\n") + 1 if body else 1


def functions(row):
    return [(f["name"], f["body_preview"], f["estimated_lines"]) for f in row["functions"]]


def test_a_function_of_200_lines(analyze_rows):
    py = "def long(a):\n" + "".join(f"    x{k} = {k}\n" for k in range(199)) + "y = 1\ndef short():\n    pass\n"
    java = "class A {\n  public void big() {\n" + "".join(f"    if (a) {{ x{k}(); }}\n" for k in range(198)) + "  }\n  public void small() {\n  }\n}\n"
    js = "function outer(a) {\n" + "  f({ a: 1 });\n" * 300 + "  function inner() {\n    return {};\n  }\n}\nfunction last() {}\n"
    got = analyze_rows([("a.py", "python", py), ("A.java", "java", java), ("a.js", "javascript", js)])
    assert {f["name"]: f["estimated_lines"] for f in got["a.py"]["functions"]} == {"long": 200, "short": 3}
    lines = {f["name"]: f["estimated_lines"] for f in got["A.java"]["functions"]}
    assert lines["big"] == 200 and lines["small"] == 2
    assert {f["name"]: f["estimated_lines"] for f in got["a.js"]["functions"]} == {"outer": 305, "inner": 3, "last": 1}


@pytest.mark.parametrize("seed", range(3))
def test_bodies_equal_a_plain_scan(analyze_rows, seed):
    import re
    from sourcelens.functions.rules import DEFAULT_RULES
    r = random.Random(seed)
    rows, want = [], {}
    for n in range(25):
        if n % 2:
            parts = [r.choice(["function f%d(a) " % k, "{", "}", "\n", "x;\n", "{ a }\n", "é", "y" * r.choice([3, 150, 300])]) for k in range(r.randint(1, 60))]
            text, path, language = "".join(parts), f"{n}.js", "javascript"
        else:
            parts = [" " * r.choice([0, 0, 2, 4, 8]) + r.choice(["def f%d(a):" % k, "def g%d(): return é" % k, "x = 1", "", "\t", "z" * r.choice([5, 250])]) for k in range(r.randint(1, 60))]
            text, path, language = "\n".join(parts) + r.choice(["", "\n"]), f"{n}.py", "python"
        rows.append((path, language, text))
        found = []
        for m in re.finditer(DEFAULT_RULES.functions[language], text):
            name = next(g for g in m.groups() if g)
            rest = text[m.end():]
            found.append((name, *expected(indent_body(rest) if language == "python" else brace_body(rest, m[0].endswith("{")))))
        want[path] = found
    got = analyze_rows(rows)
    assert {p: functions(x) for p, x in got.items()} == want


def test_cost_grows_with_the_file(spark, files_of):
    """Twice the classes (functions) in one file take about twice the time, not four times."""
    from sourcelens.operators import extract as E

    def seconds(path, language, text):
        df = E.analyze(files_of([(path, language, text)]))
        best = 1e9
        for _ in range(2):
            t0 = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t0)
        return best

    for path, language, piece in (("A.java", "java", "class C{k} {{\n  public void m{k}() {{\n    if (a) {{ b(); }}\n  }}\n}}\n"),
                                  ("a.py", "python", "class C{k}:\n    def m{k}(self):\n        if a:\n            b()\n")):
        few, many = ("".join(piece.format(k=k) for k in range(n)) for n in (4_000, 8_000))
        a, b = seconds(path, language, few), seconds(path, language, many)
        assert b < 3 * a + 1, (language, a, b)
        print(language, round(a, 2), round(b, 2))
