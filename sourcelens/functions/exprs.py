"""Column-expression helpers shared by the operators.

Everything here returns a ``Column`` built from Spark built-ins (no UDFs), so
it stays inside Catalyst and whole-stage code generation.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import PY_WHITESPACE

NON_WS = "[^" + PY_WHITESPACE[1:]
LEADING_WS = "^" + PY_WHITESPACE + "+"
TRAILING_WS = PY_WHITESPACE + "+$"
WS_RUN = PY_WHITESPACE + "+"


def newlines(c: Column) -> Column:
    """Number of '\\n' characters in ``c``."""
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace."""
    return F.regexp_replace(F.regexp_replace(c, LEADING_WS, ""), TRAILING_WS, "")


def has_text(c: Column) -> Column:
    """True when ``c.strip()`` would be non-empty."""
    return c.rlike(NON_WS)


def py_split(c: Column) -> Column:
    """Python ``s.split()`` of an already stripped, non-empty string."""
    return F.split(c, WS_RUN)


def leading_ws_len(c: Column) -> Column:
    return F.length(F.regexp_extract(c, "^" + PY_WHITESPACE + "*", 0))


def contains_any(c: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(c, F.lit(w))
    return cond


def by_language(lang: Column, table: dict[str, str], build: Callable[[str], Column],
                default: Column | None = None) -> Column:
    """``CASE lang WHEN l THEN build(pattern_l) … END`` with literal patterns.

    Each branch carries a literal pattern, so Spark compiles it once per task
    instead of once per row.
    """
    expr = None
    for language, pattern in table.items():
        branch = build(pattern)
        expr = F.when(lang == language, branch) if expr is None else expr.when(lang == language, branch)
    if expr is None:
        return default if default is not None else F.lit(None)
    return expr.otherwise(default) if default is not None else expr


def explode_rows(df, arr: Column | str, alias: str, *keep) -> "DataFrame":
    """One row per array element, without Spark's inferred ``size(arr) > 0``
    pre-filter.

    A plain ``explode`` makes the optimizer add that filter and push it below
    the projections, which evaluates the whole array expression twice.  An
    outer explode followed by a null filter on the element keeps one
    evaluation (the arrays here never hold null elements).
    """
    arr_c = F.col(arr) if isinstance(arr, str) else arr
    return df.select(*keep, F.explode_outer(arr_c).alias(alias)).where(F.col(alias).isNotNull())


def posexplode_rows(df, arr: Column | str, pos_alias: str, alias: str, *keep) -> "DataFrame":
    arr_c = F.col(arr) if isinstance(arr, str) else arr
    return (df.select(*keep, F.posexplode_outer(arr_c).alias(pos_alias, alias))
            .where(F.col(alias).isNotNull()))


SEGMENTS = "array<struct<l:int,n:int,head:string>>"


def match_spans(content: Column, lang: Column, table: dict[str, str], head: int | None = None) -> tuple[Column, Column]:
    """Per-language matches and the split segments around them.

    Returns ``(matches, segs)``: ``matches`` is every match text in order;
    ``segs`` holds ``struct(l, n)`` = (length, newline count) of the text
    between matches (one more element than ``matches``); with ``head`` also the
    first so many characters of it.  Unknown languages give empty arrays.
    """
    empty_s = F.array().cast("array<string>")
    matches = by_language(lang, table, lambda p: F.regexp_extract_all(content, F.lit(p), 0), empty_s)
    fields = lambda s: [F.length(s).alias("l"), newlines(s).alias("n")] + ([F.substring(s, 1, head).alias("head")] if head else [])
    segs = by_language(
        lang, table, lambda p: F.transform(F.split(content, p, -1), lambda s: F.struct(*fields(s))),
        F.array().cast(SEGMENTS if head else "array<struct<l:int,n:int>>"))
    return matches, segs


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once per row (bound as a lambda variable)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _prefix_sums(items: Column, fields: tuple[str, ...]) -> Column:
    """For each struct of ``items``: the sums of ``fields`` over all structs before it.

    Blocks of about sqrt(n) elements are summed first, so an element adds up
    only the blocks before its own and its neighbours inside: n * sqrt(n)
    steps in all, not n * n.
    """
    zero = F.struct(*[F.lit(0).alias(f) for f in fields])
    total = lambda part: F.aggregate(part, zero, lambda a, x: F.struct(*[(a[f] + x[f]).alias(f) for f in fields]))
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int"))

    def sums(w: Column) -> Column:
        n_blocks = F.ceil(F.size(items) / w).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda k: total(F.slice(items, k * w + 1, w)))

        def inside(block: Column) -> Column:
            before = F.transform(block, lambda _, k: total(F.slice(block, F.lit(1), k)))
            return let(before, lambda base: F.transform(items, lambda _, i: let(
                total(F.slice(items, F.floor(i / w).cast("int") * w + 1, F.pmod(i, w))),
                lambda own: let(F.get(base, F.floor(i / w).cast("int")), lambda past: F.struct(
                    *[(past[f] + own[f]).alias(f) for f in fields])))))
        return let(blocks, inside)

    empty = F.array().cast("array<struct<" + ",".join(f"{f}:int" for f in fields) + ">>")
    return F.when(F.size(items) > 0, let(width, sums)).otherwise(empty)


def braces(content: Column) -> tuple[Column, Column]:
    """The braces of a text and the segments around them, for ``brace_depths``."""
    return (F.regexp_extract_all(content, F.lit("[{}]"), F.lit(0)),
            F.transform(F.split(content, "[{}]", -1), lambda s: F.struct(F.length(s).alias("l"), newlines(s).alias("n"))))


def brace_depths(found: Column, segs: Column) -> Column:
    """For each brace its 0-based position, line, step (1 or -1) and the depth after it."""
    spans = F.zip_with(found, F.slice(segs, F.lit(1), F.size(found)), lambda b, s: F.struct(
        s["l"].alias("l"), s["n"].alias("n"), (s["l"] + 1).alias("chars"), s["n"].alias("lines"),
        F.when(b == "{", 1).otherwise(-1).alias("step")))
    return let(spans, lambda items: F.zip_with(items, _prefix_sums(items, ("chars", "lines", "step")), lambda x, p: F.struct(
        (p["chars"] + x["l"]).alias("pos"), (F.lit(1) + p["lines"] + x["n"]).alias("line"), x["step"].alias("step"),
        (p["step"] + x["step"]).alias("depth"))))


def next_in_order(points: Column, queries: Column, body: Callable[[Column], Column]) -> Column:
    """For each query the first point that comes after it: one sort of both, no search for each.

    ``points`` are structs of ``g`` (a group), ``at`` and further fields; ``queries`` structs of ``g`` and ``at``.  A
    point at a query's own ``at`` doesn't come after it.  ``body`` gets the array of found points (null where the
    group has none left), in the order of the queries.
    """
    both = F.concat(
        F.transform(points, lambda p, i: F.struct(p["g"].alias("g"), p["at"].alias("at"), F.lit(0).alias("kind"), i.alias("i"))),
        F.transform(queries, lambda q, i: F.struct(q["g"].alias("g"), q["at"].alias("at"), F.lit(1).alias("kind"), i.alias("i"))))

    def found(merged: Column) -> Column:
        order = F.filter(merged, lambda e: e["kind"] == 0)
        asked = F.filter(F.transform(merged, lambda e, k: F.struct(e["i"].alias("i"), e["g"].alias("g"), e["kind"].alias("kind"), k.alias("k"))),
                         lambda e: e["kind"] == 1)

        def of_queries(points_in_order: Column) -> Column:
            hit = F.transform(asked, lambda q, j: let(F.get(points_in_order, q["k"] - j), lambda p: F.struct(
                q["i"].alias("i"), F.when(p["g"] == q["g"], F.get(points, p["i"])).alias("p"))))
            return F.transform(F.sort_array(hit), lambda h: h["p"])
        return let(order, lambda points_in_order: let(of_queries(points_in_order), body))
    return let(F.sort_array(both), found)


def positioned(matches: Column, segs: Column) -> Column:
    """Attach 0-based start offset and 1-based line number to each match.

    Start of match i = lengths of segments 0..i plus lengths of matches
    0..i-1; the line number counts newlines the same way.  Both inputs must be
    plain column references (computed in an earlier projection).
    """
    spans = F.zip_with(matches, F.slice(segs, F.lit(1), F.size(matches)), lambda m, s: F.struct(
        m.alias("text"), s["l"].alias("l"), s["n"].alias("n"),
        (s["l"] + F.length(m)).alias("chars"), (s["n"] + newlines(m)).alias("lines")))
    return let(spans, lambda items: F.zip_with(items, _prefix_sums(items, ("chars", "lines")), lambda x, p: F.struct(
        x["text"].alias("text"), (p["chars"] + x["l"]).alias("start"), (F.lit(1) + p["lines"] + x["n"]).alias("line"))))


def first_group(text: Column, lang: Column, table: dict[str, str], groups: int = 2) -> Column:
    """First non-empty capture group of ``text`` re-matched with its pattern.

    A match re-matched on its own text yields the same groups (the patterns
    have no anchors or look-around), so only the short match string is
    scanned again.
    """
    def build(p: str) -> Column:
        n = re_groups(p)
        gs = F.array(*[F.regexp_extract(text, p, k) for k in range(1, min(n, groups) + 1)])
        return F.get(F.filter(gs, lambda g: g != ""), F.lit(0))
    return by_language(lang, table, build)


def re_groups(pattern: str) -> int:
    return re.compile(pattern).groups


def sql_str(s: str) -> str:
    """Quote a Python string as an SQL string literal (no backslash escapes)."""
    return "'" + s.replace("'", "''") + "'"


def template_parts(template: str) -> list[tuple[str, str | None]]:
    """Split a ``str.format`` template into (literal, field) pairs."""
    return [(lit, field) for lit, field, _spec, _conv in string.Formatter().parse(template)]


def render(template: str, fields: dict[str, Column]) -> Column:
    """Fill a ``{field}`` template with columns (one ``concat``; nulls become '')."""
    parts: list[Column] = []
    for lit, field in template_parts(template):
        if lit:
            parts.append(F.lit(lit))
        if field is not None:
            parts.append(F.coalesce(fields[field].cast("string"), F.lit("")))
    return F.concat(*parts)


def render_sql(template: str, fields: dict[str, str]) -> str:
    """The same template as an SQL ``concat`` over SQL expressions."""
    parts: list[str] = []
    for lit, field in template_parts(template):
        if lit:
            parts.append(sql_str(lit))
        if field is not None:
            parts.append(f"coalesce(CAST({fields[field]} AS VARCHAR), '')")
    return "concat(" + ", ".join(parts) + ")"
