"""Snapshots, change refresh, index reload and streaming ingest."""

import os

from pyspark.sql import functions as F

from sourcelens.operators import extract as E
from sourcelens.operators import retrieval as RT
from sourcelens.operators import stats as S
from sourcelens.sources import snapshot as SNAP
from sourcelens.sources.corpus import scan_corpus
from sourcelens.streaming.incremental import OUTPUTS, ingest_stream, read_output
from tests.conftest import SF_SMALL


def test_refresh_equals_full_reanalysis(spark, tmp_path):
    from sourcelens.plans.catalog import corpus, next_corpus
    old = corpus(spark, SF_SMALL)
    SNAP.write_snapshot(old, str(tmp_path / "snap"))
    snap = SNAP.read_snapshot(spark, str(tmp_path / "snap"))
    new = next_corpus(old)
    old_results = S.file_counts(E.analyze(old))
    refreshed = SNAP.refresh(new, old_results, snap, lambda f: S.file_counts(E.analyze(f)))
    full = S.file_counts(E.analyze(new))
    assert refreshed.exceptAll(full).count() == 0 and full.exceptAll(refreshed).count() == 0


def test_index_reload_gives_same_search(spark, tmp_path):
    from sourcelens.plans.catalog import bench_questions, kb_documents
    idx = RT.build_index(kb_documents(spark, SF_SMALL))
    idx.save(str(tmp_path / "idx"))
    again = RT.Index.load(spark, str(tmp_path / "idx"))
    q = bench_questions(spark, SF_SMALL)
    a = RT.search(idx, q).select("qid", "doc_id", "rank", F.round("score", 9).alias("s"))
    b = RT.search(again, q).select("qid", "doc_id", "rank", F.round("score", 9).alias("s"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "src"
    for repo in ("alpha", "beta"):
        (src / repo / "pkg").mkdir(parents=True)
        (src / repo / "pkg" / "m.py").write_text(f"import os\nclass {repo.title()}:\n    def run(self):\n        pass\n")
        (src / repo / "app.js").write_text("function start(x) { return x; }\n// entry\n")
    q = ingest_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ckpt"), repo_depth=1)
    q.awaitTermination(120)
    streamed = read_output(spark, str(tmp_path / "out"), "file_counts").drop("batch")
    batch = S.file_counts(E.analyze(scan_corpus(spark, str(src), repo_depth=1)))
    assert streamed.count() == 4
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    whole = E.analyze(scan_corpus(spark, str(src), repo_depth=1))
    assert len(OUTPUTS) == 9
    for name, view in OUTPUTS.items():
        rows = sorted(map(str, read_output(spark, str(tmp_path / "out"), name).drop("batch").collect()))
        assert rows == sorted(map(str, view(whole).collect())), name
    assert read_output(spark, str(tmp_path / "out"), "skipped").count() == 0
    # A second run with no new files processes nothing new.
    q2 = ingest_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ckpt"), repo_depth=1)
    q2.awaitTermination(120)
    assert read_output(spark, str(tmp_path / "out"), "file_counts").count() == 4
    # A new file is picked up by the next run, alone, in a new batch.
    (src / "beta" / "pkg" / "extra.go").write_text('import "fmt"\nfunc Extra(a int) {\n}\n')
    q3 = ingest_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ckpt"), repo_depth=1)
    q3.awaitTermination(120)
    out = read_output(spark, str(tmp_path / "out"), "file_counts")
    assert out.count() == 5
    new = out.where(F.col("path") == "pkg/extra.go").collect()
    assert len(new) == 1 and new[0]["repo"] == "beta" and new[0]["functions"] == 1
    assert out.select("batch").distinct().count() == 2


def test_write_docs(spark, tmp_path):
    from sourcelens.operators import docs as DOC
    from sourcelens.plans.catalog import analyzed
    docs = DOC.file_docs(analyzed(spark, SF_SMALL))
    saved = SNAP.write_docs(docs, str(tmp_path / "docs"))
    assert saved.count() == docs.count() > 0
    assert os.path.isdir(tmp_path / "docs")


def test_write_reports_matches_in_memory(spark, tmp_path):
    from sourcelens.plans.catalog import corpus
    from sourcelens.plans.reports import write_reports
    files = corpus(spark, SF_SMALL)
    out = write_reports(spark, files, str(tmp_path / "rep"), ["file_counts", "summary_report", "internal_deps"])
    for name, fn in (("file_counts", S.file_counts), ("summary_report", S.summary_report)):
        got = spark.read.parquet(out[name])
        want = fn(E.analyze(files))
        assert got.exceptAll(want.select(*got.columns)).count() == 0
        assert want.select(*got.columns).exceptAll(got).count() == 0


def test_write_all_reports(spark, tmp_path):
    from sourcelens.plans.catalog import corpus
    from sourcelens.plans.reports import REPORTS, write_reports
    out = write_reports(spark, corpus(spark, SF_SMALL), str(tmp_path / "all"), index=True)
    assert set(out) == set(REPORTS) | {"index"}
    idx = RT.Index.load(spark, out["index"], group="repo")
    assert idx.vocab.count() > 0 and idx.postings.count() > 0
    out.pop("index")
    for name, path in out.items():
        assert spark.read.parquet(path).count() >= 0, name
    assert spark.read.parquet(out["functions"]).count() > 0
    assert spark.read.parquet(out["kb_docs"]).count() > 0


def test_stream_in_small_batches_equals_batch(spark, tmp_path):
    src = tmp_path / "src"
    for repo in ("alpha", "beta", "gamma"):
        (src / repo).mkdir(parents=True)
        (src / repo / "a.py").write_text(f"def {repo}_a(x):\n    return x\n")
        (src / repo / "b.js").write_text(f"function {repo}B(y) {{ return y; }}\n")
    q = ingest_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ckpt"), repo_depth=1,
                      max_files_per_trigger=2)
    q.awaitTermination(180)
    streamed = read_output(spark, str(tmp_path / "out"), "functions")
    assert streamed.select("batch").distinct().count() == 3
    batch = E.functions(E.analyze(scan_corpus(spark, str(src), repo_depth=1)))
    s = streamed.drop("batch").select(*batch.columns)
    assert s.exceptAll(batch).count() == 0 and batch.exceptAll(s).count() == 0
