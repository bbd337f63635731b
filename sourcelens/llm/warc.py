"""WARC archives (method: dictionary-compressed writer).

A Zstandard dictionary is built from a bounded sample of the records, embedded
in a leading skippable frame of every archive, and each record is compressed
as a frame of its own.  Records with equal payloads of at least
``MIN_REVISIT`` bytes are written once in full (the one with the largest
page id); the others become revisit records.

Spark's own text writer puts the frames down, through whatever file system the
path names and with its commit protocol, so a lost executor's files are
written again and never half seen.  The separator it puts after each frame is
an empty skippable frame: an archive is a plain concatenation of Zstandard
frames.  The reader splits at the separator, so that many tasks share one
large archive, and gets the dictionary from the leading frames.

Defined cases: a null html is an empty payload; a null url or page id leaves
its header out (a null id comes back null); repeated rows of the response's id
are each written as a response; payloads under the limit are never revisits;
an empty table writes no archive and reads back as no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, hash_sample, shared_path, small_batches

MIN_REVISIT = 1000
LEVEL = 3
DICT_BYTES = 64 << 10
DICT_SAMPLE = 1000              # records that the dictionary is built from
DICT_RECORD_BYTES = 64 << 10    # records above this aren't taken for it

DICT_MAGIC = struct.pack("<I", 0x184D2A5D)                  # skippable frame that holds the dictionary
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)               # empty skippable frame
BODY = b"\r\n\r\n"
READ_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, headers and block; a revisit has no block."""
    key = f"{page_id}/{digest}"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}/{digest}')}>",
                  f"X-Refers-To-Page: {refers_to}",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = payload if refers_to is None else b""
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8") + BODY + block + BODY


def parse(data: bytes) -> dict:
    head, _, rest = data.partition(BODY)
    h = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[:int(h["Content-Length"])]
    if rest[len(block):] != BODY:
        raise ValueError("record is not as long as its Content-Length")
    kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
        raise ValueError("payload does not have its digest")
    number = lambda k: int(h[k]) if k in h else None
    return {"page_id": number("X-Page-ID"), "url": h.get("WARC-Target-URI"), "record_type": kind,
            "payload_bytes": len(block) if kind == "response" else number("X-Payload-Length"), "payload_digest": digest,
            "refers_to": number("X-Refers-To-Page"), "payload": block if kind == "response" else None}


def dictionary_frame(dictionary: bytes) -> bytes:
    return DICT_MAGIC + struct.pack("<I", len(dictionary)) + dictionary


def compress(data: bytes, dictionary: zstandard.ZstdCompressionDict | None, level: int = LEVEL) -> bytes:
    """A frame that doesn't hold the separator by chance."""
    for at in (level, 1, *range(4, 20)):
        frame = zstandard.ZstdCompressor(level=at, dict_data=dictionary, write_checksum=True).compress(data)
        if SEPARATOR not in frame:
            return frame
    raise ValueError("every frame of this record holds the separator")


def build_dictionary(pages: DataFrame, size: int = DICT_BYTES, sample: int = DICT_SAMPLE) -> bytes:
    """A dictionary from about ``sample`` records of the archive; empty where they are too few to train on."""
    n = pages.count()
    rows = bounded(pages.where((F.octet_length("html") <= DICT_RECORD_BYTES)
                               & hash_sample(F.col("page_id"), sample / max(1, n)))
                   .select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest"), 2 * sample).collect()
    records = [record(r.page_id, r.url, bytes(r.html), r.digest, None) for r in rows]
    # samples that separators could be trained into stay out
    records = [r for r in records if SEPARATOR not in r]
    try:
        made = zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b""
    return b"" if SEPARATOR in made else made


def with_digests(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), "url", payload.alias("html")).withColumns(
        {"digest": F.sha1(payload.cast("binary")), "bytes": F.octet_length(payload).cast("long")})


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``pages`` with refers_to: the largest page id of an equal payload, null for that row and for short ones.

    The digests' maxima are combined on the map side; the join back is on the digest, and Spark splits a
    digest that many pages share.
    """
    largest = (pages.where(F.col("bytes") >= min_bytes).groupBy("digest")
               .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("copies"))
               .where("copies > 1").drop("copies"))
    joined = pages.join(largest, "digest", "left")
    return joined.withColumn("refers_to", F.when(F.coalesce(F.col("page_id") != F.col("largest"), F.col("largest").isNotNull()), F.col("largest"))).drop("largest")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", level: int = LEVEL) -> None:
    """Writes one archive for each task under ``path``."""
    spark = pages.sparkSession
    small_batches(spark)
    pages = with_digests(pages, id_col)
    raw = build_dictionary(pages)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = zstandard.ZstdCompressionDict(raw) if raw else None
        pack = zstandard.ZstdCompressor(level=level, dict_data=made, write_checksum=True)
        begun = False
        for batch in batches:
            out = [] if begun else [dictionary_frame(raw)]
            begun = True
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                data = record(page_id, url, html, digest, refers_to)
                frame = pack.compress(data)
                out.append(frame if SEPARATOR not in frame else compress(data, made, level))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    rows = revisits(pages).select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", "refers_to")
    (rows.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", SEPARATOR.decode("ascii")).option("compression", "none").text(path))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``; payloads are checked against their digests."""
    small_batches(spark)
    rows = (spark.read.schema("value string").option("lineSep", SEPARATOR.decode("ascii")).text(path)
            .select(F.col("value").cast("binary").alias("frame")))
    is_dictionary = F.substring("frame", 1, 4) == F.lit(bytearray(DICT_MAGIC))
    known = [bytes(r.frame)[8:] for r in rows.where(is_dictionary).distinct().collect()]  # one for each writing job

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionaries = [zstandard.ZstdCompressionDict(d) for d in known if d]
        by_id = {d.dict_id(): zstandard.ZstdDecompressor(dict_data=d) for d in dictionaries}
        by_id[0] = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for frame in batch.column(0):
                data = frame.as_py()
                out.append(parse(by_id[zstandard.get_frame_parameters(data).dict_id].decompress(data)))
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    return rows.where(~is_dictionary).mapInArrow(records, READ_SCHEMA)


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def archive_and_read(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Writes archives to the shared folder and returns what is read back from them."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, id_col)
    return read_archives(pages.sparkSession, path)
