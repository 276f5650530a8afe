"""Dictionary-compressed WARC archives, written and read back by Spark tasks.

Each task writes archives of its own rows: a Zstandard dictionary is built from the first
``SAMPLE_BYTES`` of the archive's records, placed (compressed) in a leading skippable
frame, and every record is a frame of its own. An archive is closed at ``ARCHIVE_BYTES``.
A row with the same payload as one of smaller page_id becomes a revisit record without
the payload; payloads below ``least`` bytes are always stored.

Archives go to a folder that all executors share, under names no other attempt uses. The
saved index names the archives of the attempts that count; files left by lost executors
are never read. A record is read through its archive's own dictionary.

Null html is an empty payload. Rows that repeat the smallest page_id of a payload are all
response records; a payload of null page_ids only has no revisits. Null urls are written
as ``about:blank``. Other columns are ignored; an empty table gives no archives, no rows.
"""

import base64
import hashlib
import io
import struct
import urllib.parse
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from spectralake.llm.tables import bounded
from spectralake.storage import save, shared_dir

LEAST = 0
ARCHIVE_BYTES = 64 << 20
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
SKIPPABLE = 0x184D2A5D   # fixed: magic number of a WARC dictionary frame
DATE = "2024-01-01T00:00:00Z"
INDEX = "file string, at long, length long, page_id long, record_type string"


def digest_of(payload):
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id):
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url, payload, first):
    """The bytes of one record; ``first`` is the page_id of the response a revisit refers to."""
    revisit = first is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}",
             f"WARC-Date: {DATE}", "WARC-Target-URI: " + urllib.parse.quote(url or "about:blank", safe="%/:=&?~#+!$,;'@()*[]"),
             f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {_record_id(first)}", f"X-Refers-To-Page-ID: {first}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data):
    """(headers by lower-cased name, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    headers = {k.lower(): v for k, v in headers.items()}
    block = rest[:int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def dictionary(samples):
    """A dictionary from whole records, or None where they are too few to make one."""
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8))
    for times in (1, 32):
        try:
            return zstandard.train_dictionary(size, samples * times, k=256, d=8)
        except zstandard.ZstdError:
            continue
    return None


def _open(folder):
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class Archive:
    """One growing archive: records wait until the dictionary is built."""

    def __init__(self, folder):
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        store, path = _open(folder)
        self.out = store.open_output_stream(f"{path}/{self.name}", compression=None)
        self.waiting, self.held, self.at, self.coder, self.index = [], 0, 0, None, []

    def add(self, data, page_id, kind):
        if self.coder is None:
            self.waiting.append((data, page_id, kind))
            self.held += len(data)
            if self.held >= SAMPLE_BYTES:
                self.begin()
        else:
            self.put(data, page_id, kind)

    def begin(self):
        made = dictionary([data for data, _, _ in self.waiting])
        content = zstandard.ZstdCompressor(level=LEVEL).compress(made.as_bytes()) if made else b""
        self.out.write(struct.pack("<II", SKIPPABLE, len(content)) + content)
        self.at = 8 + len(content)
        self.coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=made)
        info = b"software: spectralake\r\nformat: WARC File Format 1.1\r\n"
        self.put(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_record_id(self.name)}\r\nWARC-Date: {DATE}\r\n"
                 f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n", None, None)
        for row in self.waiting:
            self.put(*row)
        self.waiting = []

    def put(self, data, page_id, kind):
        frame = self.coder.compress(data)
        self.out.write(frame)
        if kind:
            self.index.append((self.name, self.at, len(frame), page_id, kind))
        self.at += len(frame)

    def close(self):
        if self.coder is None:
            self.begin()
        self.out.close()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*self.index), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
            ["file", "at", "length", "page_id", "record_type"])


def write(pages, folder, least=LEAST):
    """Write archives of ``pages`` (page_id, url, html) to ``folder``; the saved index of their records."""
    store, path = _open(folder)
    store.create_dir(path, recursive=True)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("bytes"),
                        F.sha1(html).alias("digest"))
    repeated = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(bounded(save(repeated), 128), ["digest", "bytes"], "left").select(
        "page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first")).alias("first"))

    def run(batches):
        archive = None
        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(c) for c in ("page_id", "url", "html", "first"))):
                page_id, first = page_id.as_py(), first.as_py()
                archive = archive or Archive(folder)
                archive.add(record(page_id, url.as_py(), html.as_py().encode(), first), page_id, "response" if first is None else "revisit")
                if archive.at >= ARCHIVE_BYTES:
                    yield archive.close()
                    archive = None
        if archive:
            yield archive.close()

    return save(rows.mapInArrow(run, INDEX))


def records(stream):
    """Every record of one archive's bytes (warcinfo left out), frame after frame, as (headers, payload)."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    content = stream.read(size)
    made = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(content)) if content else None
    coder = zstandard.ZstdDecompressor(dict_data=made)
    left = b""
    while True:
        frame, data = coder.decompressobj(), io.BytesIO()
        while not frame.eof:
            piece = left or stream.read(1 << 20)
            if not piece:
                if data.tell():
                    raise ValueError("archive ends within a record")
                return
            data.write(frame.decompress(piece))
            left = frame.unused_data if frame.eof else b""
        headers, payload = parse(data.getvalue())
        if headers["warc-type"] != "warcinfo":
            yield headers, payload


def read(spark, folder, index):
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record of the index's archives.

    Bytes and digest of a response are taken from the payload as read, those of a revisit
    from its headers.
    """
    files = index.select("file").distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        store, path = _open(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for headers, payload in records(stream):
                        number = lambda key: int(headers[key]) if key in headers else None  # noqa: B023, E731
                        stored = headers["warc-type"] == "response"
                        digest = digest_of(payload) if stored else headers["warc-payload-digest"].removeprefix("sha1:")
                        rows.append((number("x-page-id"), len(payload) if stored else number("x-payload-length"), digest,
                                     headers["warc-type"], number("x-refers-to-page-id"), headers["warc-target-uri"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    # dealt in turn: by hash of the name, Spark would reuse the partitions of distinct() and merge them
    return files.repartition(parts).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(pages, least=LEAST):
    """Write ``pages`` to new archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read(spark, folder, write(pages, folder, least)).drop("url")


ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS h,
             min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to FROM d
"""
