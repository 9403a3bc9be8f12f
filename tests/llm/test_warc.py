"""WARC writing, normalising and reading: round trips on odd pages, against brute force on a whole table."""

import gzip
import hashlib
import io
import zlib

from pyarrow import fs

from pricelens.llm import warc
from pricelens.llm.queries import QUERIES
from pricelens.llm.shared import shared_folder, table

SMALL = "/root/testdata/sf0.001"


def expected(rows):
    """page_id -> (bytes, digest, type, refers_to); ids must be distinct."""
    first: dict[str, int] = {}
    for page_id, html in sorted(rows):
        data = (html or "").encode()
        if len(data) >= 100:
            first.setdefault(hashlib.sha256(data).hexdigest(), page_id)
    out = {}
    for page_id, html in rows:
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        lead = first.get(digest, page_id)
        out[page_id] = (len(data), digest, "response" if lead == page_id else "revisit", None if lead == page_id else lead)
    return out


def as_dict(df):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()}


def test_query_against_brute_force(spark):
    rows = [(r.page_id, r.html) for r in table(spark, SMALL, "pages").collect()]
    assert as_dict(QUERIES["op1_warc_normalise"](spark, SMALL)) == expected(rows)


def test_odd_pages(spark, monkeypatch):
    long = "x" * 120
    rows = [(5, "http://a/\r\nX: 1", long), (2, None, long), (9, "u", long), (1, "u", None), (3, "u", ""), (4, "u", "short"), (6, "u", "short"),
            (7, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 4\r\n\r\n" * 9), (8, "é漢", "é" * 50), (10, "u", "é" * 50), (11, "u", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash", 0) for r in rows], "page_id long, url string, html string, archive string, ordinal long").repartition(2)
    folder = shared_folder(spark, "w")
    got = warc.archive_pages(pages, folder)
    assert as_dict(got) == expected([(r[0], r[2]) for r in rows])
    # each member of the normalised archives is one record, readable alone and by any gzip reader
    archives = {r.archive for r in got.select("archive").distinct().collect()}
    store, root = fs.FileSystem.from_uri(folder)
    for name in archives:
        with store.open_input_file(f"{root}/records/{name}") as f:
            data = f.readall()
        whole = gzip.decompress(data)
        rows_here = sorted((r.offset, r.length) for r in got.where(f"archive = '{name}'").collect())
        assert rows_here[0][0] == 0 and rows_here[-1][0] + rows_here[-1][1] == len(data)
        assert b"".join(zlib.decompress(data[a:a + n], 31) for a, n in rows_here) == whole
        assert all(zlib.decompress(data[a:a + n], 31).startswith(b"WARC/1.1\r\n") for a, n in rows_here)


def test_repeated_and_null_page_ids(spark):
    long = "z" * 200
    rows = [(1, "u", long), (1, "u", long), (None, "u", long), (None, "u", "small")]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), shared_folder(spark, "w")).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got if r.payload_bytes == 200) == [(0, "revisit", 1), (1, "response", None), (1, "revisit", 1)]
    assert len(got) == 4


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"), shared_folder(spark, "w")).count() == 0


def test_inflate_reads_any_member_layout(monkeypatch):
    records = [warc._record("response", "u", {"N": str(i)}, warc._http(b"ab" * i), str(i)) for i in range(40)]
    whole = b"".join(records)
    layouts = [gzip.compress(whole), b"".join(map(gzip.compress, records)), gzip.compress(whole[:700]) + gzip.compress(whole[700:])]
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(warc, "READ_BYTES", size)
        for data in layouts:
            assert list(warc.split_records(warc.inflate(io.BytesIO(data)))) == records
