"""One repository holding about a third of all files: results stay whole and
the plans combine map-side / limit per task before any shuffle by repository."""

from pyspark.sql import functions as F

from sourcelens.operators import deps as DEP
from sourcelens.operators import extract as E
from sourcelens.operators import stats as S
from sourcelens.operators.rank import important_files
from tests.conftest import SF_SMALL


def _skewed(spark):
    from sourcelens.plans.catalog import corpus
    files = corpus(spark, SF_SMALL)
    # Every file whose path sorts before "m" (api/ and core/util/, about 2 of 7) moves into one hot repository.
    return files.withColumn("repo", F.when(F.col("path") < "m", F.lit("hot")).otherwise(F.col("repo")))


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_hot_repository_holds_a_third(spark):
    files = _skewed(spark)
    share = files.where(F.col("repo") == "hot").count() / files.count()
    assert 0.25 < share < 0.45


def test_results_whole_under_skew(spark):
    files = _skewed(spark)
    an = E.analyze(files)
    facts = S.repo_facts(an)
    assert facts.agg(F.sum("total_files")).first()[0] == files.count()
    want = E.functions(an).count()
    assert facts.agg(F.sum("total_functions")).first()[0] == want
    top = DEP.top_imports(an)
    hot = {r["module"]: r["uses"] for r in top.where(F.col("repo") == "hot").collect()}
    brute = (E.imports(an).where(F.col("repo") == "hot").groupBy("module").count()
             .orderBy(F.col("count").desc(), "module").limit(10).collect())
    assert hot == {r["module"]: r["count"] for r in brute}
    imp = important_files(S.file_counts(an), 5).where(F.col("repo") == "hot").count()
    assert imp == 5


def test_plans_combine_before_shuffle(spark):
    an = E.analyze(_skewed(spark))
    facts_plan = _plan(S.repo_facts(an))
    assert "partial_count" in facts_plan and "partial_sum" in facts_plan
    top_plan = _plan(DEP.top_imports(an))
    assert "WindowGroupLimit" in top_plan and "Partial" in top_plan
    assert "Window" in _plan(important_files(S.file_counts(an), 5))
