"""Small helpers of the llm operators: table access, the shared folder, folds, Arrow text buffers."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import new_path, written  # noqa: F401 — the operators write through this module

#: Rows of one Arrow batch; texts average a few kB, so a batch stays at some MB.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, as ``--py-files`` would, once a session: their Python may not have it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = pathlib.Path(__file__).resolve().parents[1]
    archive = pathlib.Path(tempfile.mkdtemp(prefix="py-files-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent).as_posix())
    sc.addPyFile(str(archive.resolve()))
    _SHIPPED.add(sc.applicationId)


def small_batches(spark: SparkSession) -> None:
    """For operators that run Python: ships the package, and bounds the rows of one Arrow batch, so that a batch of
    long texts fits in a Python worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder that the cluster names (``spark.checkpoint.dir``)."""
    return new_path(spark, name)


def quoted(name: str) -> Column:
    """A column whose name may hold dots or quotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as a column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def in_fold(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether crc32 of the id as text leaves remainder ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def hash_sample(key: Column, fraction: float, seed: int = 7) -> Column:
    """A fixed pseudo-random choice of about ``fraction`` of the keys (all of them at 1 and above)."""
    if fraction >= 1:
        return F.lit(True)
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000)


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """At most so many of the rows, chosen by a hash of all of their columns: each task hands on that many at most."""
    return rows.withColumn("__order", F.xxhash64(*rows.columns)).orderBy("__order").limit(most).drop("__order")


def text_slices(texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow string array that hold at most ``max_bytes`` each (one row may exceed it)."""
    offsets = text_bytes(texts)[1]
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, hi
        lo = hi


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string array; a null row is empty."""
    a = texts.cast(pa.large_binary())
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    if a.null_count:
        a = a.fill_null(b"")
    n = len(a)
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, np.int64)[a.offset:a.offset + n + 1] if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def annotate(df: DataFrame, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], fields: str, name: str = "found",
             keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` (default: all) and a struct column ``name`` worked out from each row's text.

    ``make`` runs once a task; what it returns gets the texts of some rows and gives one array for each field.
    Rows stay in their partitions.
    """
    small_batches(df.sparkSession)
    keep = df.columns if keep is None else keep
    n = len(keep)
    # plain names on the way, as a name may hold dots; the text goes to Python once, even if it is kept
    at = keep.index(text) if text in keep else n
    columns = [quoted(c).alias(f"c{k}") for k, c in enumerate(keep)] + ([] if at < n else [quoted(text).cast("string").alias(f"c{n}")])
    added = StructType.fromDDL(fields)
    schema = StructType()
    for k, c in enumerate(keep):
        schema.add(f"c{k}", df.schema[c].dataType)
    schema.add("found", added)
    names, field_names = schema.fieldNames(), added.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worked_out = make()
        for batch in batches:
            for lo, hi in text_slices(batch.column(at), 4 << 20):
                part = batch.slice(lo, hi - lo)
                found = pa.StructArray.from_arrays(worked_out(part.column(at)), field_names)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], found], names)

    return df.select(*columns).mapInArrow(run, schema).select(
        *[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], F.col("found").alias(name))
