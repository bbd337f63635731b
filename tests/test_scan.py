"""Files that can't be read, files too large, patterns that Java refuses, and the clean-up of written tables."""

import os

import pytest

from sourcelens import session
from sourcelens.functions.rules import LanguageRules
from sourcelens.sources.corpus import scan_corpus, scan_with_skipped, skipped_files
from sourcelens.streaming.incremental import ingest_stream, read_output


@pytest.fixture()
def tree(tmp_path):
    src = tmp_path / "src"
    (src / "alpha" / "lib").mkdir(parents=True)
    (src / "alpha" / "lib" / "good.py").write_text("def good():\n    pass\n")
    (src / "alpha" / "big.py").write_text("x = 1\n" * 500)
    bad = src / "alpha" / "lib" / "bad.py"
    bad.write_text("def bad():\n    pass\n" * 40)
    # a checksum that isn't the file's: opening it fails as a bad disk would
    (bad.parent / ".bad.py.crc").write_bytes(b"crc\x00\x00\x00\x02\x00" + b"\x00\x00\x00\x07" * 2)
    return str(src)


def test_unreadable_files_are_listed(spark, tree):
    for limit, large in ((None, []), (1_000, [("alpha", "big.py", 3000, "too_large")])):
        want = sorted([("alpha", "lib/bad.py", os.path.getsize(f"{tree}/alpha/lib/bad.py"), "unreadable"), *large])
        options = {"repo_depth": 1, "max_bytes": limit}
        got = skipped_files(spark, tree, **options).drop("full_path").collect()
        assert sorted(map(tuple, got)) == want
        files, skipped = scan_with_skipped(spark, tree, **options)
        assert sorted(map(tuple, skipped.drop("full_path").collect())) == want
        assert sorted(r.path for r in files.collect()) == sorted(r.path for r in scan_corpus(spark, tree, **options).collect()) \
            == (["big.py", "lib/good.py"] if limit is None else ["lib/good.py"])


def test_the_stream_lists_them_too(spark, tree, tmp_path):
    before = session.written_so_far(spark)
    ingest_stream(spark, tree, str(tmp_path / "out"), str(tmp_path / "state"), repo_depth=1).awaitTermination(120)
    assert [(r.path, r.skip_reason) for r in read_output(spark, str(tmp_path / "out"), "skipped").collect()] == [("lib/bad.py", "unreadable")]
    assert {r.name for r in read_output(spark, str(tmp_path / "out"), "functions").collect()} == {"good"}
    assert session.written_so_far(spark) == before


def test_written_tables_are_deleted(spark):
    mark = session.written_so_far(spark)
    kept = session.written(spark.range(3), "kept")
    later = session.written_so_far(spark)
    session.written(spark.range(3), "gone")
    root = session.checkpoint_dir(spark).removeprefix("file:")
    assert session.release_written(spark, later) == 1 and kept.count() == 3
    assert not [d for d in os.listdir(root) if d.startswith("gone-")]
    assert session.release_written(spark, mark) == 1 and not [d for d in os.listdir(root) if d.startswith("kept-")]


@pytest.mark.parametrize("pattern", [r"(?P<n>x)", r"(x)\Z", r"(?a:(x))", r"([[:x)"])
def test_patterns_that_java_refuses(spark, pattern):
    with pytest.raises(ValueError):
        LanguageRules().register("odd", [".odd"], function=pattern)
