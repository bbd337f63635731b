import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sourcelens.session import checkpoint_dir, local_session
    s = local_session(cores="*", shuffle_partitions=8, app="sourcelens-tests", driver_memory="8g")
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def files_of(spark):
    """Build a ``files`` DataFrame from (path, language, content) tuples."""
    from sourcelens.sources.corpus import corpus_from_table

    def make(rows, repo="r"):
        df = spark.createDataFrame([(repo, p, l, c) for p, l, c in rows],
                                   "repo string, path string, language string, content string")
        return corpus_from_table(df)
    return make


@pytest.fixture()
def analyze_rows(files_of):
    from sourcelens.operators import extract as E

    def run(rows, repo="r"):
        return {r["path"]: r for r in E.analyze(files_of(rows, repo)).collect()}
    return run
