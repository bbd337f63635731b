"""Statistics against plain Python, and the cascade's order and verdicts."""

import re
from collections import Counter

from pyspark.sql import functions as F

from sourcelens.llm import quality_rules as R


def by_hand(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    twice = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def check(docs):
    rows = R.quality_cascade(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == by_hand(text[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed) and r.kept == (r.rejected_by is None)
    return rows


def test_statistics(spark):
    a = "one two three four five six seven eight nine"
    texts = [f"{a} {a}", f"{a} x {a}", "a " * 8, "a " * 9, "b " * 30, f"{a}\n{a}\n\n \t\n{a} ", " x y z\x0bq\x0cr\rs",
             "😀 é\n😀 é", f"{a[4:]} {a} {a[:8]} {a}", "# $$ |<>| &a% *"]
    check(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))


def test_documents(spark):
    rows = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 5 = 0"))
    assert any(r.kept for r in rows) and any(not r.kept for r in rows)


def test_odd_tables(odd_docs, no_docs):
    rows = check(odd_docs)
    assert not any(r.kept for r in rows if r.doc_id in (3, 4, 5, 6))
    assert R.quality_cascade(no_docs).count() == 0


def test_rules_are_ordered_by_rejection_per_cost(spark):
    sample = spark.range(0, 3000).withColumn("v", F.col("id") % 100)
    slow = F.length(F.repeat(F.sha2(F.col("id").cast("string"), 512), 500)) < 0
    order = R.measure(sample, [R.Rule("slow_never", slow), R.Rule("often", F.col("v") < 90), R.Rule("never", F.col("v") < 0)])
    assert order[0].rule.name == "often" and order[0].rejected == 0.9
    ratios = [m.rejected / m.seconds_a_row for m in order]
    assert ratios == sorted(ratios, reverse=True)


def test_verdict_does_not_depend_on_the_order(spark):
    docs = spark.range(0, 100).withColumn("v", F.col("id") % 10)
    rules = [R.Rule("a", F.col("v") < 3), R.Rule("b", F.col("v") > 7), R.Rule("c", F.when(F.col("v") == 5, True))]
    one = docs.select("id", R.first_rejection(rules).isNull().alias("k")).collect()
    two = docs.select("id", R.first_rejection(rules[::-1]).isNull().alias("k")).collect()
    assert one == two and sum(r.k for r in one) == 40


def test_later_rules_are_not_evaluated(spark):
    docs = spark.range(0, 50)
    fails = F.raise_error(F.lit("evaluated")).cast("boolean")
    assert {r.x for r in docs.select(R.first_rejection([R.Rule("first", F.col("id") >= 0), R.Rule("later", fails)]).alias("x")).collect()} == {"first"}


def test_the_plan_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = R.quality_cascade(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
