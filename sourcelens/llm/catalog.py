"""The queries opN_<name> over the whole tables, with production parameters, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, lang_id, main_text, near_dup, packing, pii, prefix_trie, quality_cnn, quality_rules, repeats, variants, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_lang_id")
def q_lang_id(spark, sf_dir):
    return lang_id.identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register("op2_quality_cnn")
def q_quality_cnn(spark, sf_dir):
    return quality_cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op3_near_duplicates")
def q_near_duplicates(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
             list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
w AS (SELECT doc_id, unnest(range(1, CAST(len(ws) AS BIGINT) - 6)) AS i, ws FROM l WHERE len(ws) > 8),
h AS (SELECT doc_id, i, ws[i:i + 7] AS win FROM w),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM h),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(8)) AS k) WHERE c > 1 GROUP BY doc_id),
s AS (SELECT l.doc_id, t, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
             length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS capitals,
             length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters
      FROM l LEFT JOIN p USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
       OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines OR 2 * capitals > letters
       OR 2 * letters < word_chars) AS kept
FROM s
"""


@register("op4_quality_rules", RULES_SQL)
def q_quality_rules(spark, sf_dir):
    return quality_rules.quality_cascade(table(spark, sf_dir, "documents")).drop("rejected_by")


@register("op5_ann")
def q_ann(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@register("op6_bpe")
def q_bpe(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN, keep_ids=False).drop("ids")


@register("op8_pii")
def q_pii(spark, sf_dir):
    return pii.pseudonymize(table(spark, sf_dir, "documents"))


@register("op9_packing")
def q_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS largest FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM d LEFT JOIN m USING (payload_digest)
"""


@register("op7_warc", WARC_SQL)
def q_warc(spark, sf_dir):
    return warc.archive_and_read(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op10_main_text")
def q_main_text(spark, sf_dir):
    return main_text.extract(table(spark, sf_dir, "pages"))


#: crc32 as SQL: the byte table from its rule, and one step a byte of a list.
CRC_TABLE_SQL = """crc_table AS (
SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def crc_sql(byte_list: str) -> str:
    return (f"xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {byte_list}), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))")


TRIE_SQL = f"""
WITH {CRC_TABLE_SQL},
turns AS (SELECT conv_id, turn, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS sym,
                 strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(sym ORDER BY turn NULLS FIRST, md5(sym)) AS s, list(bytes ORDER BY turn NULLS FIRST, md5(sym)) AS b
        FROM turns GROUP BY conv_id),
h AS (SELECT own.*, conv_id - conv_id % 5 AS base,
             {crc_sql("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))")} % 9 AS h
      FROM own, crc_table),
whole AS (SELECT h.conv_id, list_concat(coalesce(f.s, [])[1:h.h], h.s[h.h + 1:]) AS s,
                 list_concat(coalesce(f.b, [])[1:h.h], h.b[h.h + 1:]) AS b
          FROM h LEFT JOIN own f ON f.conv_id = h.base),
prefixes AS (SELECT conv_id, unnest(range(0, len(s) + 1)) AS depth, s, b FROM whole),
nodes AS (SELECT s[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n, max(coalesce(b[depth], 0)) AS bytes,
                 coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(s) = depth), '') AS ends
          FROM prefixes GROUP BY ALL),
children AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (p, depth)),
above AS (SELECT unnest(range(0, depth + 1)) AS up, depth, p, n, bytes, n_children FROM known),
subtree AS (SELECT p[1:up] AS p, up AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
                   sum((n - 1) * bytes) AS saved FROM above GROUP BY ALL)
SELECT k.conv_id, k.depth, u.conv_id AS parent_conv_id, k.n AS n_convs, CAST(k.n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM known k JOIN subtree USING (p, depth) LEFT JOIN known u ON u.depth = k.depth - 1 AND u.p = k.p[1:k.depth - 1]
"""


@register("op13_prefix_trie", TRIE_SQL)
def q_prefix_trie(spark, sf_dir):
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


VARIANTS_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) WHERE length(w) > 5),
counted AS (SELECT doc, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT doc, run, n, {crc_sql("""flatten(list_transform(string_split(doc || ':' || run, ''),
  lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [195, CAST(ord(x) AS BIGINT) - 64] END))""")} AS h FROM counted, crc_table),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n
          FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
          WHERE length(word) > 5 GROUP BY word HAVING sum(n) > 4),
gone AS (SELECT word, n, unnest(range(0, length(word) + 1)) AS k FROM words),
part AS (SELECT word, n, k, CASE WHEN k = 0 THEN word ELSE substr(word, 1, k - 1) || substr(word, k + 1) END AS rest FROM gone),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM part a JOIN part b USING (rest)
         WHERE a.word <> b.word AND (a.k = b.k OR a.k = 0 OR b.k = 0)),
best AS (SELECT word, n, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY ALL),
forms AS (SELECT b.word, n_near, min(CASE WHEN other_n = top AND top >= 5 * b.n THEN other END) AS form,
                 max(CASE WHEN top >= 5 * b.n THEN top END) AS form_n
          FROM best b JOIN near USING (word) GROUP BY ALL),
chain(word, link, step) AS (SELECT word, word, 0 FROM words
                      UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.link WHERE f.form IS NOT NULL),
ends AS (SELECT word, max_by(link, step) AS root FROM chain GROUP BY word)
SELECT w.word, f.form, e.root, w.n, CAST(coalesce(f.n_near, 0) AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM words w LEFT JOIN forms f USING (word) JOIN ends e USING (word)
"""


@register("op11_variants", VARIANTS_SQL)
def q_variants(spark, sf_dir):
    return variants.variants(table(spark, sf_dir, "documents"))


@register("op12_repeats")
def q_repeats(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))
