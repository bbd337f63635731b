"""Archives: exact round trip, revisits against SQL, layout of the files."""

import glob
import hashlib

import zstandard

from sourcelens.llm import warc
from sourcelens.llm.common import shared_path


def test_round_trip_of_odd_pages(spark, odd_pages):
    got = sorted(warc.archive_and_read(odd_pages).collect(), key=lambda r: (r.page_id or -1, r.refers_to or -1))
    want = sorted(odd_pages.collect(), key=lambda r: r.page_id or -1)
    assert [r.page_id for r in got] == [r.page_id for r in want]
    for g, w in zip(got, want):
        data = (w.html or "").encode("utf-8")
        assert (g.payload_bytes, g.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        if g.record_type == "response":
            assert bytes(g.payload) == data and g.refers_to is None
    kinds = [(g.page_id, g.record_type, g.refers_to) for g in got if g.page_id in (None, 1, 2, 3, 6, 7)]
    # the largest id of equal payloads is the response, in each of its rows; short ones never refer
    assert kinds == [(None, "revisit", 3), (1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (3, "response", None),
                     (6, "response", None), (7, "response", None)]
    assert next(g.url for g in got if g.page_id == 6) == "http://a/6%0D%0AX: y"


def test_empty_table(spark, odd_pages):
    assert warc.archive_and_read(odd_pages.limit(0)).count() == 0


def test_archives_are_plain_zstandard_with_a_leading_dictionary(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    path = shared_path(spark, "warc-test")
    warc.write_archives(pages.repartition(3), path)
    files = glob.glob(path.removeprefix("file:") + "/part-*")
    assert files
    records = 0
    for file in files:
        data = open(file, "rb").read()
        assert data[:4] == warc.DICT_MAGIC
        size = int.from_bytes(data[4:8], "little")
        assert size > 1000
        dictionary = zstandard.ZstdCompressionDict(data[8:8 + size])
        reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(data, read_across_frames=True)
        records += reader.read().count(b"WARC/1.1\r\n")
    assert records == pages.count()


def test_a_frame_never_holds_the_separator():
    noise = b"".join(hashlib.sha256(bytes([k % 256, k // 256])).digest() for k in range(300))
    data = noise + warc.SEPARATOR + noise
    frame = warc.compress(data, None)
    assert warc.SEPARATOR not in frame and zstandard.ZstdDecompressor().decompress(frame) == data
