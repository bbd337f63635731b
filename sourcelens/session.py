"""Session helpers: a local session for tests/bench and the shared checkpoint dir."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "sourcelens",
                  driver_memory: str = "8g", extra: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", driver_memory)
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this is set by the deployment and always used as is; an
    unset value there is an error (a machine-local folder would not survive
    the loss of that machine).  Only a local-mode session (tests, bench) gets
    a scratch folder when the setting is unset.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 — remote session: the server side owns the setting
        if not d:
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        return d
    d = d or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="sourcelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return d


LISTING_TASKS_PER_CORE = 4
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def list_by_few_tasks(spark: SparkSession) -> str:
    """From now on folders that Spark lists are dealt to a few tasks a core; returns the setting there was.

    By default each folder (up to 10,000 at a time) is a task, and every task sends the driver some kilobytes besides
    the names it found.
    """
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(before), LISTING_TASKS_PER_CORE * cores_of(spark))))
    return before


@contextmanager
def listed_by_few_tasks(spark: SparkSession) -> Iterator[None]:
    """``list_by_few_tasks`` for as long as the block runs."""
    before = list_by_few_tasks(spark)
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)


def cores_of(spark: SparkSession) -> int:
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 — no SparkContext (remote session)
        return 8


_WRITTEN: dict[str, list[str]] = {}


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written in the block leaves no shuffle files: by default they stay until the driver collects its garbage."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder.

    Cuts the lineage: a lost executor's part is read again, not worked out again, and readers take only the
    columns and row groups they need.  The table stays until ``release_written`` deletes it, as results that are
    worked out later read it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_freed(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, which ``release_written`` deletes."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written_so_far(spark: SparkSession) -> int:
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def release_written(spark: SparkSession, since: int = 0) -> int:
    """Deletes the tables written by this session (after the first ``since`` of them), once no result needs them.

    Returns how many there were.  Frames built on them can't be read afterwards.
    """
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    gone, paths[since:] = paths[since:], []
    for p in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    return len(gone)
