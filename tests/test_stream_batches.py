"""The work of a micro-batch besides its files."""

from sourcelens.operators import extract as E
from sourcelens.streaming.incremental import OUTPUTS, ingest_stream, read_output


def tree(tmp_path, n=3):
    for i in range(n):
        (tmp_path / "src" / f"repo{i}").mkdir(parents=True)
        (tmp_path / "src" / f"repo{i}" / "m.py").write_text(f"import os\nclass C{i}:\n    def run(self):\n        pass\n")
    return str(tmp_path / "src")


def test_the_analysis_is_built_once_a_stream(spark, tmp_path, monkeypatch):
    built = []
    analyze = E.analyze
    monkeypatch.setattr(E, "analyze", lambda *a: (built.append(a), analyze(*a))[1])
    ingest_stream(spark, tree(tmp_path), str(tmp_path / "out"), str(tmp_path / "state"), repo_depth=1, max_files_per_trigger=1).awaitTermination(300)
    assert read_output(spark, str(tmp_path / "out"), "file_counts").select("batch").distinct().count() == 3
    assert len(built) == 1
    for name in OUTPUTS:
        read_output(spark, str(tmp_path / "out"), name)     # all are there


def test_an_output_that_fails_fails_the_stream(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setitem(OUTPUTS, "functions", lambda a: a.select(F.raise_error(F.lit("lost")).alias("x")))
    q = ingest_stream(spark, tree(tmp_path), str(tmp_path / "out"), str(tmp_path / "state"), repo_depth=1)
    try:
        q.awaitTermination(300)
        failed = False
    except Exception:  # noqa: BLE001 — a StreamingQueryException
        failed = True
    assert failed


def test_recorded_steps_are_those_of_analyze(spark, files_of):
    files = files_of([("a.py", "python", "import os\ndef f(a):\n    return 1\n"), ("b.js", "javascript", "function g(x) { return x; }\n// note here\n"), ("c.go", "go", None)])
    again = E.analysis()
    for _ in range(2):
        assert sorted(map(str, again(files).collect())) == sorted(map(str, E.analyze(files).collect()))
