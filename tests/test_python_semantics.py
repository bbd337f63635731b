"""Spark's Java-regex results against Python's own `re` on the real
multilingual documents: line counts, `\\b`-delimited keyword counts and the
`(?u)\\b\\w\\w+\\b` tokenisation the retrieval layer models."""

import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sourcelens.functions.rules import CONTROL_KEYWORDS
from sourcelens.operators import extract as E
from sourcelens.operators import retrieval as RT

SF = "/root/testdata/sf0.01"
KEYWORDS = re.compile(r"\b(" + "|".join(CONTROL_KEYWORDS) + r")\b")
TOKEN = re.compile(r"(?u)\b\w\w+\b")


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "lang", "source"]).to_pylist()
    return {r["doc_id"]: r for r in t}


def test_line_metrics_match_python(spark, docs):
    from sourcelens.sources.corpus import documents_corpus
    m = E.metrics_only(documents_corpus(spark.read.parquet(f"{SF}/documents.parquet"))).select(
        "path", "total_lines", "code_lines", "complexity").collect()
    assert len(m) == len(docs)
    for r in m:
        text = docs[int(r["path"][4:-4])]["text"]
        lines = text.split("\n")
        assert r["total_lines"] == len(lines)
        assert r["code_lines"] == sum(1 for line in lines if line.strip())
        assert r["complexity"] == len(KEYWORDS.findall(text))


def test_tokens_match_python(spark, docs):
    stop = set(RT.ENGLISH_STOP_WORDS)
    got = {r["doc_id"]: r["tokens"] for r in RT.token_stats(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for doc_id, r in docs.items():
        want = [t for t in TOKEN.findall(r["text"].lower()) if t not in stop]
        assert got[doc_id] == len(want), doc_id
