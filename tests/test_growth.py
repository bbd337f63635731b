"""Work and driver traffic that grow with the input alone, with the same results."""

import random
import re

from pyspark.sql import functions as F

from sourcelens.functions.rules import DOCSTRING_PATTERN, DOCSTRING_SCAN
from sourcelens.operators import extract as E
from sourcelens.session import LISTING_TASKS_PER_CORE, new_path
from sourcelens.sources.corpus import scan_corpus
from sourcelens.sources.fixtures import document_tree
from tests.conftest import SF_SMALL


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    most = LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    for i in range(most + 40):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "a.py").write_text("x = 1\n")
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, tracker = spark.conf.get(key), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    files = scan_corpus(spark, str(tmp_path), repo_depth=1)
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("listing")]
    spark.sparkContext.setJobGroup("", "")
    tasks = sum(tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds)
    assert 0 < tasks <= most and spark.conf.get(key) == before
    assert files.count() == most + 40


def test_docstrings_by_whole_stretches(spark, files_of):
    r = random.Random(8)
    pieces = ['"', '"""', "'", "'" * 3, "a", "bc \n", '""']
    soup = ["".join(r.choice(pieces) for _ in range(r.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in soup], "t string")
    for row in df.select("t", F.regexp_extract_all("t", F.lit(DOCSTRING_SCAN), F.lit(0)).alias("m")).collect():
        assert row["m"] == [m.group(0) for m in re.finditer(DOCSTRING_PATTERN, row["t"])]
    soup.append('def f():\n    """' + 'some "words" of a text, and more\n' * 2_000 + '"""\n    return None\n')
    files = files_of([(f"f{i}.py", "python", t) for i, t in enumerate(soup)])
    got = {}
    for d in E.docstrings(E.analyze(files)).collect():
        got.setdefault(d["path"], []).append((d["ord"], d["text"]))
    for i, t in enumerate(soup):
        found = [(m.group(1) or m.group(2) or "").strip() for m in re.finditer(DOCSTRING_PATTERN, t)]
        assert sorted(got.get(f"f{i}.py", [])) == list(enumerate(x for x in found if len(x) > 10))


def test_digests_of_terms_move_texts_only(spark):
    from sourcelens.plans.catalog import QUERIES
    plan = QUERIES["ngram_terms"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_files_of_a_tree_come_without_checksum_files(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"s{i % 2}") for i in range(6)], "doc_id long, text string, source string")
    path = document_tree(docs, new_path(spark, "tree"))
    folder = spark._jvm.java.io.File
    for s in range(2):
        names = [f.getName() for f in folder(f"{path}/source=s{s}/part=0").listFiles()]
        assert len(names) == 1 and names[0].endswith(".txt")
