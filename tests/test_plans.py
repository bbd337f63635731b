"""Plan assertions: no Python UDFs, bounded top-k, pushed-down scans."""

import pytest

from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    import __spark_entry__ as entry
    return {name: _plan(fn(spark, SF_SMALL)) for name, fn in entry.queries().items()}


def test_no_python_udfs(plans):
    for name, p in plans.items():
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p, name


def test_topk_uses_window_group_limit(spark):
    from sourcelens.plans.catalog import QUERIES
    df = QUERIES["top_imports"](spark, SF_SMALL)
    df._jdf.queryExecution().optimizedPlan()
    assert "WindowGroupLimit" in df._jdf.queryExecution().sparkPlan().toString()


def test_corpus_top_is_take_ordered(spark):
    from sourcelens.plans.catalog import QUERIES
    assert "TakeOrderedAndProject" in QUERIES["topk_imports"](spark, SF_SMALL)._jdf.queryExecution() \
        .sparkPlan().toString()


def test_scan_prunes_columns(spark):
    from sourcelens.plans.catalog import QUERIES
    p = _plan(QUERIES["line_metrics"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in p


def test_search_shuffles_no_pairs(spark):
    """The questions are broadcast, scores summed where the postings are dealt; after that only what ranks is shuffled."""
    from sourcelens.plans.catalog import QUERIES
    p = QUERIES["search"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in p
    shuffles = [x for x in p.split("\n") if "Exchange hashpartitioning" in x]
    assert not [x for x in shuffles if "doc_id" in x and "qid" in x]
    assert p.index("WindowGroupLimit") < p.index("Exchange hashpartitioning(doc_id")


def test_reports_scan_only_their_columns(spark):
    from sourcelens.plans.catalog import QUERIES
    p = _plan(QUERIES["repo_summary"](spark, SF_SMALL))
    assert "Scan parquet" in p and "ExistingRDD" not in p
    read = p[p.index("ReadSchema: "):].split("\n")[0]
    assert "body_preview" not in read and "comments" not in read and "stmt" not in read


def test_internal_deps_has_no_nested_loop(spark):
    from sourcelens.plans.catalog import QUERIES
    p = QUERIES["internal_deps"](spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert "NestedLoop" not in p and "CartesianProduct" not in p


def test_entry_runs(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns == ["repo", "rank", "path", "language", "score"]
