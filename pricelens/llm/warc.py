"""WARC archives: write, normalise a monolithic gzip, read back by offset index.

``write_archives`` streams rows into archives that are one gzip stream each
(the form some crawlers leave).  ``normalise`` inflates such a file once,
front to back, rewrites every record as its own gzip member and writes a
sidecar index of member offsets, so that any record can be read alone.
``read_records`` seeks to the members the index names.

Files go to the shared folder.  A manifest row is what a task commits; files
of failed attempts have names no manifest holds.

Edge cases: null html is an empty payload; a null URL is written as
``about:blank``; empty tables give no archives; repeated page_ids stay apart
(one record per row); among equal payloads with the same smallest page_id one
row is the response.  Control characters in a URL are percent-encoded.  A page of
any length is one record, held whole by its task; extra columns, whatever their
names, are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.shared import store, unique_name, written

#: Payloads smaller than this are always stored in full.
REVISIT_MIN_BYTES = 100
#: Raw bytes after which a writer starts its next archive.
ROLL_BYTES = 32 << 20
#: Compressed bytes read from a store at a time.
READ_BYTES = 1 << 20
GZIP = 31  # zlib window bits of a gzip stream
LEVEL = 3  # of both compressions

MANIFEST = "archive string, ordinal long, page_id long, payload_bytes long, payload_digest string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, offset long, length long"


def _record(kind: str, url: str | None, headers: dict[str, str], block: bytes, seed: str) -> bytes:
    target = "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url) if url else "about:blank"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, seed)}>",
             f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
             *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _http(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one whole record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        k, _, v = line.partition(": ")
        headers[k] = v
    return headers, rest[:int(headers["Content-Length"])]


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from a stream of inflated bytes; holds one record and one chunk at most."""
    buffer = bytearray()
    need = 0  # bytes of the record at the front, once its header has been read
    searched = 0
    for chunk in chunks:
        buffer += chunk
        at = 0
        while True:
            if not need:
                end = buffer.find(b"\r\n\r\n", max(at, searched - 3))
                if end < 0:
                    searched = len(buffer)
                    break
                head = bytes(buffer[at:end])
                size = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                need = end - at + 4 + size + 4
            if len(buffer) - at < need:
                break
            yield bytes(buffer[at:at + need])
            at += need
            need = searched = 0
        del buffer[:at]
        searched = max(0, searched - at)
    if buffer:
        raise ValueError(f"archive ends inside a record ({len(buffer)} bytes left)")


def inflate(stream) -> Iterator[bytes]:
    """A whole gzip file, member after member, inflated once in bounded pieces."""
    engine = zlib.decompressobj(GZIP)
    while data := stream.read(READ_BYTES):
        while data:
            piece = engine.decompress(data, 4 * READ_BYTES)
            if piece:
                yield piece
            data = engine.unconsumed_tail
            if engine.eof:
                data = engine.unused_data
                engine = zlib.decompressobj(GZIP)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row (page_id, url, html) as a response record; the manifest of what was written.

    No shuffle: each scan task writes its own rows, rolling over at
    ``ROLL_BYTES``, so a skewed key costs nothing here.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = store(folder)
        filesystem.create_dir(root, recursive=True)
        out = engine = None
        name, raw, ordinal = "", 0, 0
        try:
            for batch in batches:
                rows: list[tuple] = []
                for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    if out is None:
                        name, raw, ordinal = unique_name("crawl", ".warc.gz"), 0, 0
                        out, engine = filesystem.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                    payload = (html or "").encode()
                    digest = hashlib.sha256(payload).hexdigest()
                    headers = {"WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(len(payload))}
                    if page_id is not None:
                        headers["X-Page-Id"] = str(page_id)
                    data = _record("response", url, headers, _http(payload), f"{page_id}:{name}:{ordinal}")
                    out.write(engine.compress(data))
                    rows.append((name, ordinal, page_id, len(payload), digest))
                    raw += len(data)
                    ordinal += 1
                    if raw >= ROLL_BYTES:
                        out.write(engine.flush())
                        out.close()
                        out = None
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                    names=["archive", "ordinal", "page_id", "payload_bytes", "payload_digest"]) if rows else pa.RecordBatch.from_pylist([], schema=MANIFEST_ARROW)
        finally:
            if out is not None:
                out.write(engine.flush())
                out.close()

    return pages.select("page_id", "url", "html").mapInArrow(write, MANIFEST)


MANIFEST_ARROW = pa.schema([("archive", pa.string()), ("ordinal", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def revisits(manifest: DataFrame, min_bytes: int = REVISIT_MIN_BYTES) -> DataFrame:
    """Rows that another row's equal payload makes revisits: archive, ordinal, refers_to.

    The first row of each payload is one partial/final aggregate over all
    rows; only payloads that repeat go into the join, whose hot digests
    adaptive execution splits.
    """
    rank = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "archive", "ordinal")
    large = manifest.where(F.col("payload_bytes") >= min_bytes)
    first = (large.groupBy("payload_digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("payload_digest", "first"))
    return (large.join(first, "payload_digest")
            .where(~((F.col("archive") == F.col("first.archive")) & (F.col("ordinal") == F.col("first.ordinal"))))
            .select("archive", "ordinal", F.col("first.page_id").alias("refers_to"), F.col("payload_digest")))


def normalise(manifest: DataFrame, folder: str, to_folder: str) -> DataFrame:
    """Rewrite every archive of the manifest with one gzip member per record.

    One task per archive (their size is bounded by ``ROLL_BYTES`` plus one
    record).  Rows that :func:`revisits` names lose their payload and point at
    the response instead.  Returns archive (new name) and its sidecar index.
    """
    links = revisits(manifest).groupBy("archive").agg(F.collect_list(F.struct("ordinal", "refers_to")).alias("links"))
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    jobs = manifest.select("archive").distinct().join(links, "archive", "left").repartition(tasks)  # small rows, large work

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, root = store(folder)
        target, to_root = store(to_folder)
        target.create_dir(to_root, recursive=True)
        for batch in batches:
            done: list[tuple] = []
            for row in batch.to_pylist():
                refers = {x["ordinal"]: x["refers_to"] for x in row["links"] or []}
                name = unique_name(row["archive"].removesuffix(".warc.gz"), ".warc.gz")
                offset, index = 0, []
                with source.open_input_stream(f"{root}/{row['archive']}", compression=None) as stream, \
                        target.open_output_stream(f"{to_root}/{name}", compression=None) as out:
                    for ordinal, data in enumerate(split_records(inflate(stream))):
                        if ordinal in refers:
                            data = _revisit(data, refers[ordinal])
                        engine = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                        member = engine.compress(data) + engine.flush()
                        out.write(member)
                        index.append(f"{ordinal}\t{offset}\t{len(member)}\n")
                        offset += len(member)
                with target.open_output_stream(f"{to_root}/{name}.idx", compression=None) as out:
                    out.write("".join(index).encode())
                done.append((name, f"{name}.idx", len(index)))
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["archive", "index", "records"])

    return jobs.mapInArrow(rewrite, "archive string, index string, records long")


def _revisit(data: bytes, refers_to: int | None) -> bytes:
    headers, block = parse_record(data)
    status = block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n"
    kept = {k: headers[k] for k in ("WARC-Payload-Digest", "X-Payload-Length", "X-Page-Id") if k in headers}
    if refers_to is not None:
        kept["X-Refers-To-Page-Id"] = str(refers_to)
    kept["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return _record("revisit", headers["WARC-Target-URI"], kept, status, headers["WARC-Record-ID"])


def read_records(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the indexed archives, each inflated alone at its offset.

    A response's length and digest are computed from the payload read; a
    revisit's are those its header carries.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with filesystem.open_input_stream(f"{root}/{row['index']}", compression=None) as f:
                    index = [tuple(map(int, x.split(b"\t"))) for x in f.read().splitlines()]
                out: list[tuple] = []
                with filesystem.open_input_file(f"{root}/{row['archive']}") as f:
                    for _, offset, length in index:
                        headers, block = parse_record(zlib.decompress(f.read_at(length, offset), GZIP))
                        if headers["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        else:
                            size, digest = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                        out.append((page and int(page), size, digest, headers["WARC-Type"], refers and int(refers),
                                    headers["WARC-Target-URI"], row["archive"], offset, length))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "archive", "offset", "length"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return archives.mapInArrow(read, RECORD)


def archive_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Write, normalise and index ``pages`` under ``folder``; the records as read back."""
    manifest = written(write_archives(pages, f"{folder}/monolithic"), "warc-manifest")
    indexed = written(normalise(manifest, f"{folder}/monolithic", f"{folder}/records"), "warc-archives")
    # archives are few, large rows of work: spread them over the tasks there are
    spread = indexed.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return read_records(spread, f"{folder}/records")
