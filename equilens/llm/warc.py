"""WARC archives with a two-level capture index.

Writing: tasks write one archive file each, a gzip member for each record, and report every
record's file, offset and length.  Equal payloads are found by digest and size with map-side
combining; the one with the largest page id becomes the response, the others revisit it.

Index: captures are range-sorted by reversed-host URL key (``com,example)/path``); each task
packs its range into compressed blocks of ``BLOCK`` captures and writes them to one index
file, followed by a sparse directory of the blocks' first keys.  A lookup finds the file and
the block by binary search, reads that block alone, and then reads the records by range.

Archives and index lie in a folder that all executors share; files are written under a name
of their attempt and only those a successful task reports are ever read, so lost executors
and repeated tasks leave at most unused files.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.llm.common import materialize, shared_folder, text_slices

BLOCK = 512              # captures of an index block
CRLF = "\r\n"
ARCHIVE_FIELDS = "page_id long, url string, key string, file string, offset long, length long"
DIRECTORY_FIELDS = "file string, block int, first_key string, last_key string, offset long, length long, captures long"
RECORD_FIELDS = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
                 "refers_to long, payload binary")


# ---------------------------------------------------------------- records

def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then port, path and query; null gives the empty key."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "//" in url else "//" + url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:                       # no URL by the rules: it stands under its own text
        return url
    host = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _one_line(value: str | None) -> str:
    return "".join(" " if ord(c) < 32 or ord(c) == 127 else c for c in value or "")


def _record(page_id, url: str | None, payload: bytes, digest: str, response_id) -> bytes:
    """One record; a revisit names the response and carries no payload, but its size and digest."""
    revisit = response_id is not None and response_id != page_id
    body = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:equilens:page:{'' if page_id is None else page_id}>",
            f"WARC-Target-URI: {_one_line(url)}", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:equilens:page:{response_id}>"]
    if url is None:
        head = [h for h in head if not h.startswith("WARC-Target-URI")]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return (CRLF.join(head) + CRLF * 2).encode("utf-8") + body + (CRLF * 2).encode()


def _urn_id(value: str) -> int | None:
    tail = value.rstrip(">").rpartition(":")[2]
    return int(tail) if tail else None


def parse_record(data: bytes) -> dict:
    """Fields of one record; the digest of a payload that is there is computed anew."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split(CRLF)
    field = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    body = rest[:int(field["content-length"])]
    kind = field["warc-type"]
    if kind == "response":
        size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
        if digest != field["warc-payload-digest"].removeprefix("sha1:"):
            raise ValueError(f"payload digest does not match in {field['warc-record-id']}")
    else:
        size, digest = int(field["x-payload-length"]), field["warc-payload-digest"].removeprefix("sha1:")
    return {"page_id": _urn_id(field["warc-record-id"]), "url": field.get("warc-target-uri"), "record_type": kind,
            "payload_bytes": size, "payload_digest": digest,
            "refers_to": _urn_id(field["warc-refers-to"]) if "warc-refers-to" in field else None,
            "payload": body if kind == "response" else None}


def _gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") \
        else (pafs.LocalFileSystem(), folder)


# ---------------------------------------------------------------- writing

def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   min_bytes: int = 0, file_bytes: int = 256 << 20) -> DataFrame:
    """Write one record for each row; returns the captures ``page_id, url, key, file, offset, length``.

    Of rows with equal payloads of at least ``min_bytes`` the largest ``page_id`` is the
    response and the others revisit it; smaller ones are responses.  Null html is the empty
    payload.  Rows that repeat the largest id are all responses; rows with a null id are
    responses unless another row of the payload has an id.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    best = rows.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("response_id"))
    rows = rows.join(best, ["sha", "size"], "left").select("page_id", "url", "payload", "sha", "response_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        name, out, offset = "", None, 0
        try:
            for batch in text_slices(batches, "payload"):
                captures = []
                for r in batch.to_pylist():
                    if out is None or offset >= file_bytes:
                        if out is not None:
                            out.close()
                        name, offset = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                    member = _gzip_member(_record(r["page_id"], r["url"], r["payload"], digest, r["response_id"]))
                    out.write(member)
                    captures.append((r["page_id"], r["url"], url_key(r["url"]), name, offset, len(member)))
                    offset += len(member)
                if captures:
                    cols = list(zip(*captures))
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                     names=["page_id", "url", "key", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return materialize(rows.mapInArrow(write, ARCHIVE_FIELDS), "captures")


def write_index(captures: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Write the two-level index; returns the directory, one row for each block, in key order by file."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        name, out, offset, held, directory = f"index-{uuid.uuid4().hex}.idx", None, 0, [], []

        def put() -> None:
            nonlocal offset
            data = zlib.compress(json.dumps(held).encode(), 6)
            out.write(data)
            directory.append((name, len(directory), held[0][0], held[-1][0], offset, len(data), len(held)))
            offset += len(data)
            held.clear()

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                held.append([r["key"], r["url"], r["page_id"], r["file"], r["offset"], r["length"]])
                if len(held) == block:
                    put()
        if out is None:
            return
        if held:
            put()
        foot = zlib.compress(json.dumps([d[2:6] for d in directory]).encode(), 6)
        out.write(foot + len(foot).to_bytes(8, "big"))
        out.close()
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*directory), kinds)],
                                         names=["file", "block", "first_key", "last_key", "offset", "length", "captures"])

    # a URL captured very often spreads over several files: ties go on by page and place
    order = ["key", "page_id", "file", "offset"]
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(ranged.mapInArrow(write, DIRECTORY_FIELDS), "directory")


# ---------------------------------------------------------------- reading

def _slice(source, offset: int, length: int) -> bytes:
    source.seek(offset)
    return source.read(length)


class _Files:
    """Open files of a folder, a bounded number at a time."""

    def __init__(self, folder: str, limit: int = 64):
        (self.fs, self.base), self.limit, self.open = _filesystem(folder), limit, {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= self.limit:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.fs.open_input_file(f"{self.base}/{name}")
        return _slice(self.open[name], offset, length)

    def size(self, name: str) -> int:
        return self.fs.get_file_info(f"{self.base}/{name}").size


def _records(entries: list[list], files: _Files, step: int = 64) -> Iterator[pa.RecordBatch]:
    """Read and parse the records of index entries, in the order they lie in the archives."""
    entries = sorted(entries, key=lambda e: (e[3], e[4]))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
                        ("payload", pa.binary())])
    for i in range(0, len(entries), step):
        rows = [parse_record(zlib.decompress(files.read(e[3], e[4], e[5]), 31)) for e in entries[i:i + step]]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_archives(directory: DataFrame, folder: str) -> DataFrame:
    """Every record that the index names, block by block, by range reads.

    Columns ``page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload``
    (the payload of responses).
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder)
        for batch in batches:
            for d in batch.to_pylist():
                block = json.loads(zlib.decompress(files.read(d["file"], d["offset"], d["length"])))
                yield from _records(block, files)

    # blocks hold a bounded number of captures and are dealt evenly
    return directory.repartition("file", "block").mapInArrow(read, RECORD_FIELDS)


def _footer(files: _Files, name: str) -> list[list]:
    """Block directory at the end of an index file: first key, last key, offset, length of each block."""
    size = files.size(name)
    length = int.from_bytes(files.read(name, size - 8, 8), "big")
    return json.loads(zlib.decompress(files.read(name, size - 8 - length, length)))


def lookup(directory: DataFrame, folder: str, urls: DataFrame, url: str = "url") -> DataFrame:
    """Records of the URLs in ``urls``: file by key range, block by binary search, then range reads.

    URLs of one key (scheme and fragment do not count) find the same captures; a null URL
    finds the captures without one; repeated URLs find their captures once.  The driver
    holds one row for each index file (as many as the index was written in partitions).
    """
    tops = sorted((r["low"], r["high"], r["file"]) for r in directory.groupBy("file").agg(
        F.min("first_key").alias("low"), F.max("last_key").alias("high")).collect())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        highs = [t[1] for t in tops]
        for batch in batches:
            found = []
            for key in {url_key(u) for u in batch.column("url").to_pylist()}:
                i = bisect.bisect_left(highs, key)          # the first file that may hold the key
                while i < len(tops) and tops[i][0] <= key:
                    found.append((tops[i][2], key))
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()),
                                              pa.array([k for _, k in found], pa.string())], names=["file", "key"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, footers = _Files(folder), {}
        at, block = None, []
        for batch in batches:
            for r in batch.to_pylist():
                name, key = r["file"], r["key"]
                if name not in footers:
                    footers[name] = _footer(files, name)
                blocks = footers[name]
                i = bisect.bisect_left(blocks, key, key=lambda b: b[1])
                while i < len(blocks) and blocks[i][0] <= key:
                    if at != (name, i):
                        at, block = (name, i), json.loads(zlib.decompress(files.read(name, *blocks[i][2:4])))
                    low = bisect.bisect_left(block, key, key=lambda e: e[0])
                    high = bisect.bisect_right(block, key, key=lambda e: e[0])
                    yield from _records(block[low:high], files)
                    i += 1

    asked = urls.select(F.col(url).alias("url")).distinct().mapInArrow(place, "file string, key string").distinct()
    # by ranges of keys: a block is opened by one task or two, however many keys are asked for
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return asked.repartitionByRange(parts, "file", "key").sortWithinPartitions("file", "key").mapInArrow(read, RECORD_FIELDS)


def build(pages: DataFrame, folder: str | None = None, block: int = BLOCK, **options) -> tuple[str, DataFrame]:
    """Write archives and index below ``folder`` (by default a new shared one); returns it and the directory."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    return folder, write_index(write_archives(pages, folder, **options), folder, block)
