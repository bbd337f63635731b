"""Corpus sources: files on storage, tables, repository metadata and URLs.

``files`` schema (one row per source file):
``repo, path, full_path, language, content, size, lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import newlines
from ..functions.rules import DEFAULT_RULES, MAX_FILE_BYTES, LanguageRules
from ..operators.rank import top_k
from ..session import listed_by_few_tasks, written

def spread(df: DataFrame, *keys: str, factor: int = 2) -> DataFrame:
    """Hash-spread an input that arrives in fewer partitions than the cluster
    has cores (a few large files or row groups).

    A corpus read from many files already has at least that many splits, and
    is returned unchanged; only a narrow input pays for one shuffle so that
    the CPU-heavy per-row work below runs on every core.
    """
    spark = df.sparkSession
    try:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() >= cores:
            return df
    except Exception:  # noqa: BLE001 — no SparkContext (remote session): leave the input as is
        return df
    return df.repartition(cores * factor, *[F.col(k) for k in keys])


def suffix_of(path: Column) -> Column:
    """``Path(p).suffix``: the last '.xxx' of the file name ('' when none).

    A name that starts with its only dot (``.bashrc``) or ends with a dot has
    no suffix.
    """
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_extract(name, r"^.+?(\.[^.]+)$", 1)


def language_of(path: Column, rules: LanguageRules = DEFAULT_RULES) -> Column:
    """Suffix → language as a literal CASE (B1); null for unsupported files."""
    suf = suffix_of(path)
    expr = None
    for s, lang in rules.suffixes.items():
        expr = F.when(suf == s, F.lit(lang)) if expr is None else expr.when(suf == s, F.lit(lang))
    return expr


def normalize_text(binary_or_string: Column) -> Column:
    """Decode as UTF-8 dropping invalid bytes, and fold CRLF / CR to LF."""
    s = F.make_valid_utf8(binary_or_string.cast("string"))
    s = F.replace(s, F.lit("�"), F.lit(""))
    return F.regexp_replace(s, "\r\n?", "\n")


def corpus_from_table(df: DataFrame, *, repo: str | Column = "repo", path: str = "path",
                      language: str | Column | None = "language", content: str = "content",
                      rules: LanguageRules = DEFAULT_RULES) -> DataFrame:
    """A2: any table with path/content (and optionally language) becomes ``files``.

    When ``language`` is None it is derived from the path suffix (B1).
    ``size`` is characters of text, ``lines`` the count of '\\n'-separated lines.
    """
    repo_c = F.col(repo) if isinstance(repo, str) else repo
    path_c = F.col(path)
    if language is None:
        lang_c = language_of(path_c, rules)
    else:
        lang_c = F.col(language) if isinstance(language, str) else language
    content_c = F.col(content)
    return df.select(
        repo_c.cast("string").alias("repo"),
        path_c.cast("string").alias("path"),
        path_c.cast("string").alias("full_path"),
        lang_c.cast("string").alias("language"),
        content_c.alias("content"),
        F.length(content_c).cast("bigint").alias("size"),
        (newlines(content_c) + 1).cast("bigint").alias("lines"),
    )


def documents_corpus(documents: DataFrame) -> DataFrame:
    """The ``documents`` table as a corpus: repo = source, language = lang."""
    df = documents.select("doc_id", "source", "lang", "text")
    return corpus_from_table(
        df.withColumn("path", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))),
        repo="source", path="path", language="lang", content="text")


BINARY_FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
])


def suffix_glob(rules: LanguageRules = DEFAULT_RULES) -> str:
    return "*.{" + ",".join(sorted({s.lstrip(".") for s in rules.suffixes})) + "}"


def files_from_binary(raw: DataFrame, roots: list[str], *, repo_depth: int | None = None,
                      repo: str | None = None, rules: LanguageRules = DEFAULT_RULES,
                      max_bytes: int | None = None) -> DataFrame:
    """binaryFile rows (batch or stream) → ``files``: relative path,
    repository, language, decoded text; with ``max_bytes`` only files of that
    size (the others are in ``skipped_files``)."""
    if max_bytes is not None:
        raw = raw.where(F.col("length") <= max_bytes)
    repo_c, rel_path = _placed(raw, roots, repo_depth, repo)
    files = raw.select(
        repo_c.alias("repo"), rel_path.alias("path"), F.col("path").alias("full_path"),
        language_of(rel_path, rules).alias("language"), normalize_text(F.col("content")).alias("content"))
    files = files.where(F.col("language").isNotNull())
    return files.select(
        "repo", "path", "full_path", "language", "content",
        F.length("content").cast("bigint").alias("size"),
        (newlines(F.col("content")) + 1).cast("bigint").alias("lines"))


def qualified(spark: SparkSession, root: str) -> str:
    """A root as the file listing names it: scheme, authority and absolute path, without a slash at the end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.makeQualified(path).toString().rstrip("/")


def _placed(raw: DataFrame, roots: list[str], repo_depth: int | None, repo: str | None) -> tuple[Column, Column]:
    """Repository and relative path of each file under the root it was found in (the deepest that holds it).

    A file that lies under no root fails the job rather than get a wrong label.
    """
    spark = raw.sparkSession
    rel_path = own = None
    for root in sorted({qualified(spark, r) for r in roots}, key=len, reverse=True):
        under = F.startswith(F.col("path"), F.lit(root + "/"))
        rest = F.substring(F.col("path"), len(root) + 2, 1 << 30)
        name = F.lit(root.rsplit("/", 1)[-1])
        rel_path = F.when(under, rest) if rel_path is None else rel_path.when(under, rest)
        own = F.when(under, name) if own is None else own.when(under, name)
    lost = F.raise_error(F.concat(F.lit("file under none of the roots: "), F.col("path"))).cast("string")
    rel_path, own = rel_path.otherwise(lost), own.otherwise(lost)
    if repo is not None:
        return F.lit(repo), rel_path
    if repo_depth:
        parts = F.split(rel_path, "/")
        return F.array_join(F.slice(parts, 1, repo_depth), "/"), F.array_join(F.slice(parts, repo_depth + 1, 1 << 20), "/")
    return own, rel_path


def _raw_files(spark: SparkSession, roots: list[str], rules: LanguageRules) -> DataFrame:
    with listed_by_few_tasks(spark):
        return (spark.read.format("binaryFile")
                .option("recursiveFileLookup", "true")
                .option("pathGlobFilter", suffix_glob(rules))
                .option("ignoreCorruptFiles", "true")
                .load(roots))


def scan_corpus(spark: SparkSession, roots: str | list[str], *, repo_depth: int | None = None,
                rules: LanguageRules = DEFAULT_RULES, max_bytes: int | None = None,
                repo: str | None = None) -> DataFrame:
    """A1: recursive scan of source trees into ``files``.

    The suffix glob prunes at listing time.  All files are read by default;
    with ``max_bytes`` the size predicate is pushed into the binaryFile
    source.  A file that can't be read doesn't fail the scan: ``skipped_files``
    lists it with those left out (``scan_with_skipped`` gives both).  ``repo`` is either
    given, or the first ``repo_depth`` directories under the root, or the name
    of the root that the file lies in.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    return files_from_binary(_raw_files(spark, roots, rules), roots, repo_depth=repo_depth, repo=repo, rules=rules,
                             max_bytes=max_bytes)


def skipped_from_binary(raw: DataFrame, roots: list[str], *, repo_depth: int | None = None, repo: str | None = None,
                        max_bytes: int | None = None, read: DataFrame | None = None) -> DataFrame:
    """B2: ``repo, path, full_path, size_bytes, skip_reason`` of the files that ``files_from_binary`` leaves out.

    Names and sizes come from the listing, which reads no content; a listed file whose content didn't arrive is
    ``unreadable``.  ``read`` names the files that did (``full_path``, e.g. a written scan); without it every file of
    a size to be read is read once to find out.
    """
    listed = raw.select("path", "length")
    small = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    if read is None:
        # asking for the content makes the source open the file; one that can't be read gives no row
        read = raw.where(small & F.col("content").isNotNull()).select("path")
    else:
        read = read.select(F.col("full_path").alias("path"))
    skipped = listed.where(~small).withColumn("skip_reason", F.lit("too_large")).unionByName(
        listed.where(small).join(read, "path", "left_anti").withColumn("skip_reason", F.lit("unreadable")))
    repo_c, rel_path = _placed(skipped, roots, repo_depth, repo)
    return skipped.select(repo_c.alias("repo"), rel_path.alias("path"), F.col("path").alias("full_path"),
                          F.col("length").alias("size_bytes"), "skip_reason")


def skipped_files(spark: SparkSession, roots: str | list[str], *, repo_depth: int | None = None,
                  rules: LanguageRules = DEFAULT_RULES, max_bytes: int | None = None, repo: str | None = None,
                  scanned: DataFrame | None = None) -> DataFrame:
    """B2 of a scan with the same arguments: files too large and files that couldn't be read.

    With ``scanned``, the written result of that scan, no content is read again.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    return skipped_from_binary(_raw_files(spark, roots, rules), roots, repo_depth=repo_depth, repo=repo,
                               max_bytes=max_bytes, read=scanned)


def scan_with_skipped(spark: SparkSession, roots: str | list[str], *, repo_depth: int | None = None,
                      rules: LanguageRules = DEFAULT_RULES, max_bytes: int | None = None,
                      repo: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A1 and B2 with one listing and one read of the contents: the scan, written to the shared folder, and what it left out."""
    roots = [roots] if isinstance(roots, str) else list(roots)
    raw = _raw_files(spark, roots, rules)
    files = written(files_from_binary(raw, roots, repo_depth=repo_depth, repo=repo, rules=rules, max_bytes=max_bytes), "scan")
    return files, skipped_from_binary(raw, roots, repo_depth=repo_depth, repo=repo, max_bytes=max_bytes, read=files)


def quarantine(df: DataFrame, *, size_col: str = "size_bytes", max_bytes: int = MAX_FILE_BYTES,
               content: str = "content") -> DataFrame:
    """B2: tag each row kept/skipped with a reason, instead of failing the run."""
    size = F.col(size_col) if size_col in df.columns else F.octet_length(F.col(content))
    reason = (F.when(F.col(content).isNull(), F.lit("unreadable"))
              .when(size > max_bytes, F.lit("too_large")))
    return df.withColumn("skip_reason", reason).withColumn("kept", reason.isNull())


def select_languages(files: DataFrame, languages: list[str]) -> DataFrame:
    """A language subset (a plain predicate; pushed to the scan when the
    language is a stored column)."""
    return files.where(F.col("language").isin(*languages))


def valid(analyzed: DataFrame) -> DataFrame:
    """Rows that parsed (failed rows stay in file counts only)."""
    return analyzed.where(F.col("parsing_error").isNull())


def cap_files(files: DataFrame, n: int = 100) -> DataFrame:
    """First ``n`` files per repository, ordered by path."""
    return top_k(files, ["repo"], [F.col("path")], n)


REPO_INFO_SCHEMA = T.StructType([
    T.StructField("full_name", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("stargazers_count", T.LongType()),
    T.StructField("forks_count", T.LongType()),
    T.StructField("size", T.LongType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("topics", T.ArrayType(T.StringType())),
])


def load_repo_info(api_json: DataFrame, *, json_col: str = "body", status_col: str = "status",
                   repo_col: str = "repo") -> DataFrame:
    """A3: repository metadata from dumped API responses.

    Input rows hold ``repo``, an HTTP ``status`` and the JSON ``body``; only
    status 200 yields a row (a failed lookup gives no metadata).
    """
    parsed = F.from_json(F.col(json_col), REPO_INFO_SCHEMA)
    return (api_json.where(F.col(status_col) == 200)
            .select(F.col(repo_col).alias("repo"), parsed.alias("j"))
            .select(
                "repo",
                F.coalesce("j.name", F.lit("")).alias("name"),
                F.col("j.description").alias("description"),
                F.coalesce("j.language", F.lit("")).alias("language"),
                F.coalesce("j.stargazers_count", F.lit(0)).cast("bigint").alias("stars"),
                F.coalesce("j.forks_count", F.lit(0)).cast("bigint").alias("forks"),
                F.coalesce("j.size", F.lit(0)).cast("bigint").alias("size"),
                F.try_to_timestamp(F.col("j.created_at")).alias("created_at"),
                F.try_to_timestamp(F.col("j.updated_at")).alias("updated_at"),
                F.coalesce("j.topics", F.array().cast("array<string>")).alias("topics")))


HTTPS_PREFIX = "https://github.com/"
SSH_PREFIX = "git@github.com:"


def is_valid_repo_url(url: Column) -> Column:
    return F.startswith(url, F.lit(HTTPS_PREFIX)) | F.startswith(url, F.lit(SSH_PREFIX))


def repo_name_from_url(url: Column) -> Column:
    """``owner/name`` from a repository URL (both URL forms stripped, '.git' removed)."""
    stripped = F.replace(F.replace(F.replace(url, F.lit(HTTPS_PREFIX), F.lit("")),
                                   F.lit(SSH_PREFIX), F.lit("")), F.lit(".git"), F.lit(""))
    parts = F.split(stripped, "/")
    return F.when(F.contains(url, F.lit("github.com")) & (F.size(parts) >= 2),
                  F.concat(parts[0], F.lit("/"), parts[1]))


def repo_registry(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """A4: valid URLs with their derived ``owner/name``, one row per URL."""
    u = F.col(url_col)
    return (urls.where(is_valid_repo_url(u))
            .select(u.alias("url"), repo_name_from_url(u).alias("repo"))
            .dropDuplicates(["url"]))


def cache_key(source: Column) -> Column:
    """The snapshot key of a source string: '/', ':' and '.' become '_'."""
    return F.translate(source, "/:.", "___")
