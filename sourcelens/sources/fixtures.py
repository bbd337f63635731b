"""``code_files``: a source-code corpus derived from the ``part`` table.

The shared test tables hold no source code, so the symbol jobs run over this
derivation.  The SQL text runs unchanged in Spark and in DuckDB; Spark binds
``{part}`` to a DataFrame, the oracle prepends it as a CTE over its ``part``
view.  Its size grows with ``part`` (one file per part row).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import corpus_from_table

CODE_FILES_SELECT = """
select concat('repo', p_partkey % 23) as repo,
 case p_partkey % 4 when 0 then 'python' when 1 then 'javascript' when 2 then 'java' else 'go' end as language,
 concat(case p_partkey % 7 when 0 then 'models/' when 1 then 'services/' when 2 then 'tests/' when 3 then 'api/' when 4 then 'core/util/' else '' end,
  case when p_partkey % 50 = 0 then concat('main_', p_partkey) else concat('mod_', p_partkey) end,
  case p_partkey % 4 when 0 then '.py' when 1 then '.js' when 2 then '.java' else '.go' end) as path,
 case p_partkey % 4
  when 0 then concat('import mod_', p_partkey % 97, chr(10), '# ', p_name, chr(10), case when p_size % 3 = 0 then 'from numpy import array; x = 1' else 'import requests; y = 2' end, chr(10), 'class K', p_size, ':', chr(10), '    def run_', p_partkey, '(self, a):', chr(10), '        if a > ', p_size, ':', chr(10), '            return ', p_size, chr(10), repeat(concat('    def m(self):', chr(10), chr(9), 'pass', chr(10)), CAST(p_size % 6 AS INT)))
  when 1 then concat('import React from ''react'';', chr(10), 'const v', p_size, ' = (a, b) => { return a; };', chr(10), 'function f', p_partkey, '(x) { while (x) { x = 0; } }', chr(10), '// ', p_brand, chr(10))
  when 2 then concat('import java.util.List;', chr(10), 'public class C', p_partkey, ' {', chr(10), '  public int get', p_size, '(int a) {', chr(10), '    return a;', chr(10), '  }', chr(10), '}', chr(10))
  else concat('import "fmt"', chr(10), 'type S', p_size, ' struct {}', chr(10), 'func F', p_partkey, '(a int) {', chr(10), '  for i := 0; i < ', p_size, '; i++ {}', chr(10), '}', chr(10)) end as content
from {part}
"""


def code_files(spark: SparkSession, part: DataFrame) -> DataFrame:
    """The derived corpus with the standard ``files`` columns."""
    # spark.sql formats its text with str.format: keep literal braces literal.
    text = CODE_FILES_SELECT.replace("{", "{{").replace("}", "}}").replace("{{part}}", "{part}")
    raw = spark.sql(text, part=part.select("p_partkey", "p_name", "p_brand", "p_size"))
    return corpus_from_table(raw, repo="repo", path="path", language="language", content="content")


DOCS_PER_FOLDER = 200
#: On local disks Hadoop starts a process to set the mode of each file, of its checksum, and of both again; for very many
#: small files that takes longer than writing them.  Without checksums there are fewer.  Other storage is written as ever.
NO_CHECKSUM_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def document_tree(documents: DataFrame, path: str) -> str:
    """The documents as text files, ``source=<source>/part=<doc_id // 200>/….txt``: each file holds the texts of its
    source's ids in that range, in order, a line break after each.  Returns ``path``."""
    rows = documents.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id", F.col("source"),
                            F.floor(F.col("doc_id") / DOCS_PER_FOLDER).cast("long").alias("part"))
    (rows.repartition("source", "part").sortWithinPartitions("source", "part", "doc_id").select("text", "source", "part")
     .write.options(**NO_CHECKSUM_FILES).partitionBy("source", "part").text(path))
    return path


def api_responses(spark: SparkSession, part: DataFrame) -> DataFrame:
    """``repo, status, body``: what a repository API would answer for the repositories of ``code_files``."""
    k = F.col("p_partkey") % 23
    facts = part.groupBy(k.alias("k")).agg(F.max("p_name").alias("about"), F.count(F.lit(1)).alias("stars"), F.sum("p_size").alias("forks"))
    body = F.to_json(F.struct(
        F.concat(F.lit("Name "), F.col("k").cast("string")).alias("name"),
        F.when(F.col("k") % 3 != 0, F.concat(F.lit("About "), "about")).alias("description"), F.lit("go").alias("language"),
        F.col("stars").alias("stargazers_count"), F.col("forks").alias("forks_count")))
    return facts.select(F.concat(F.lit("repo"), F.col("k").cast("string")).alias("repo"),
                        F.when(F.col("k") % 5 == 4, 404).otherwise(200).alias("status"), body.alias("body"))
