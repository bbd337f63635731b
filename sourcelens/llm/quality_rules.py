"""Quality rules (method: short-circuit cascade), DataFrame functions only.

Each rule is a boolean column that says "reject".  Its cost (seconds a row)
and its selectivity (share of rows that it rejects) are measured on a bounded
sample; the rules are then ordered by rejection per cost and evaluated as one
nested CASE, so a later rule isn't evaluated for a row that an earlier one
rejects.  The order changes the cost only: a row is kept if no rule rejects it.

All work is inside the row; nothing is shuffled, so hot sources or groups of
copies can't land in one task.

Words are ``[^\\x20\\x09-\\x0D]+``.  Defined cases: a null or empty text has
no words and fails; repeated rows get a row each; an empty table gives no
rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
SAMPLE_ROWS = 500       # bound of the sample on which rules are timed


class Rule(NamedTuple):
    name: str
    rejects: Column


class Measured(NamedTuple):
    rule: Rule
    seconds_a_row: float
    rejected: float


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once (a lambda variable)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a ``window``-word run that the text holds twice or more."""
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        runs = F.size(hashes)
        order = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def again(s: Column) -> Column:
            same = lambda a, b: F.get(s, a)["x"] == F.get(s, b)["x"]
            twice = F.filter(F.sequence(F.lit(0), runs - 1), lambda k: ((k > 0) & same(k, k - 1)) | ((k < runs - 1) & same(k, k + 1)))
            return F.array_sort(F.transform(twice, lambda k: F.get(s, k)["i"]))

        def union(at: Column) -> Column:
            zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            return F.aggregate(at, zero, lambda a, p: F.struct(
                (a["n"] + p + window - F.greatest(a["end"], p)).alias("n"), (p + window).alias("end")))["n"]

        return F.when(F.size(F.array_distinct(hashes)) == runs, 0).otherwise(let(let(order, again), union))

    hashes = F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(n <= window, 0).otherwise(let(hashes, covered))


def text_stats(text: Column) -> Column:
    """One struct of the base statistics and those that further rules use; computed once a row."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.split(t, "\n")
    full = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_stats = let(full, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    long = lambda c: c.cast("long")
    from_words = let(words, lambda w: F.struct(
        long(F.size(w)).alias("n_words"),
        long(F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))).alias("word_chars"),
        long(repeated_words(w)).alias("n_repeat_words")))
    from_lines = let(line_stats, lambda s: F.struct(long(s["n"]).alias("n_lines"), long(s["n"] - s["d"]).alias("n_dup_lines")))
    symbols = long(F.length(t) - F.length(F.translate(t, SYMBOLS, "")))
    return let(from_words, lambda a: let(from_lines, lambda b: F.struct(
        a["n_words"].alias("n_words"), a["word_chars"].alias("word_chars"), symbols.alias("n_symbols"),
        b["n_dup_lines"].alias("n_dup_lines"), a["n_repeat_words"].alias("n_repeat_words"), b["n_lines"].alias("n_lines"))))


def base_rules() -> list[Rule]:
    c = F.col
    return [Rule("few_words", c("n_words") < MIN_WORDS),
            Rule("repeated_text", 100 * c("n_repeat_words") > 30 * c("n_words"))]


def further_rules() -> list[Rule]:
    """Rules beyond the base ones, over the statistics and the text."""
    c = F.col
    t = F.coalesce(c("text"), F.lit(""))
    capitals = F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    return [Rule("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words"))),
            Rule("symbols", 10 * c("n_symbols") > 3 * c("n_words")),
            Rule("repeated_lines", 2 * c("n_dup_lines") > c("n_lines")),
            Rule("capitals", 2 * capitals > letters),
            Rule("letters", 2 * letters < c("word_chars"))]


def measure(sample: DataFrame, rules: list[Rule]) -> list[Measured]:
    """Cost and selectivity of each rule on ``sample``, most rejection per cost first."""
    n = max(1, sample.count())
    out = []
    for rule in rules:
        begun = time.perf_counter()
        hits = sample.agg(F.count_if(rule.rejects).alias("c")).first()["c"]
        out.append(Measured(rule, (time.perf_counter() - begun) / n, hits / n))
    return sorted(out, key=lambda m: -m.rejected / m.seconds_a_row)


def first_rejection(order: list[Rule]) -> Column:
    """Name of the first rule of ``order`` that rejects the row, else null; later rules aren't evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(order):
        verdict = F.when(F.coalesce(rule.rejects, F.lit(False)), rule.name).otherwise(verdict)
    return verdict


def sample_rows(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows, written to the shared folder so that each rule is timed on the same small table."""
    n = docs.count()
    return written(docs.sample(min(1.0, rows / max(1, n)), seed=11), "rule-sample")


def quality_cascade(docs: DataFrame, rules: list[Rule] | None = None, sample: int = SAMPLE_ROWS,
                    id_col: str = "doc_id") -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and rejected_by (null if kept)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col("text"))
    stats = docs.select("doc_id", "text", text_stats(F.col("text")).alias("s")).select("doc_id", "text", "s.*")
    rules = base_rules() + (further_rules() if rules is None else rules)
    small = sample_rows(docs, sample)
    small = written(small.select("text", text_stats(F.col("text")).alias("s")).select("text", "s.*"), "rule-stats")
    order = [m.rule for m in measure(small, rules)]
    failed = F.lit(False)
    for rule in base_rules():
        failed = failed | rule.rejects
    out = stats.withColumn("rejected_by", first_rejection(order))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"), "rejected_by")
