"""Property tests: the column helpers that model Python string semantics
agree with Python's own builtins on random input (one Spark batch each)."""

import pathlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sourcelens.functions import exprs as X
from sourcelens.sources.corpus import suffix_of

WS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0        　"
TEXT = st.text(alphabet=st.sampled_from(list(WS) + list("ab_é1#{}()​")), max_size=30)
SETTINGS = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(TEXT, min_size=50, max_size=200))
def test_strip_split_blank_match_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    rows = df.select("s", X.py_strip(F.col("s")).alias("strip"), X.has_text(F.col("s")).alias("nonblank"),
                     X.newlines(F.col("s")).alias("nl"), X.leading_ws_len(F.col("s")).alias("ind")).collect()
    for r in rows:
        s = r["s"]
        assert r["strip"] == s.strip()
        assert r["nonblank"] == bool(s.strip())
        assert r["nl"] == s.count("\n")
        assert r["ind"] == len(s) - len(s.lstrip())
    stripped = [v.strip() for v in values if v.strip()]
    df2 = spark.createDataFrame([(v,) for v in stripped], "s string")
    for r in df2.select("s", X.py_split(F.col("s")).alias("parts")).collect():
        assert r["parts"] == r["s"].split()


# Scanned paths never hold "." or ".." components (pathlib would normalise them away).
NAME = st.text(alphabet=st.sampled_from(list("ab.xyz_-")), min_size=1, max_size=10).filter(
    lambda n: n not in (".", ".."))


@SETTINGS
@given(st.lists(st.lists(NAME, min_size=1, max_size=4).map("/".join), min_size=50, max_size=200))
def test_suffix_matches_pathlib(spark, paths):
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for r in df.select("p", suffix_of(F.col("p")).alias("suf")).collect():
        assert r["suf"] == pathlib.PurePosixPath(r["p"]).suffix, r["p"]
