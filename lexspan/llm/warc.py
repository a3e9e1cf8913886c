"""WARC archives with a two-level capture index.

Archives hold a gzip member per record. Capture lines, keyed by the URL with
its host reversed, are sorted over all archives and stored in compressed blocks
of ``BLOCK`` lines; a sparse directory has the first key, place and size of
each block. A lookup binary-searches the parts, then a part's directory, reads
that one block, and range-reads the record its line points to.

Every attempt of a task writes files of its own name, and what it returns says
which: a task that runs again or twice at a time leaves an unread file behind
and never replaces one that committed lines point into.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import os
import uuid
import zlib
from bisect import bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.scratch import partitions, written
from lexspan.llm.skew import looked_up

BLOCK = 1000
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """The URL with its host's labels reversed, lower-cased, without scheme and fragment: ``com,example)/path?q``."""
    if not url:
        return "-"
    url = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return f"-{url.lower()}"
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + path.lower()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, refers_url: str | None = None) -> bytes:
    """A response, or a revisit of page refers_to's response, as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "urn:none")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"X-Page-ID: {'' if page_id is None else page_id}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(member: bytes) -> dict:
    """Headers of a record with its HTTP length and payload (None for a revisit)."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http_length"] = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    fields["payload"] = payload if fields["WARC-Type"] == "response" else None
    return fields


def _own(folder: str, end: str) -> str:
    """A file name of this attempt alone."""
    os.makedirs(folder, exist_ok=True)
    t = TaskContext.get()
    return f"{folder}/{t.partitionId():06d}-{t.taskAttemptId()}-{uuid.uuid4().hex[:8]}{end}"


def _batches(rows, kinds: dict, room: int = 8 << 20):
    """Arrow batches of (row, bytes), cut where ``room`` bytes or 10,000 rows are held."""
    held, size = [], 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds.values())], names=list(kinds))
    for row, n in rows:
        held.append(row)
        size += n
        if size >= room or len(held) >= 10_000:
            yield out()
            held, size = [], 0
    if held:
        yield out()


_LINES = {"key": pa.string(), "page_id": pa.int64(), "file": pa.string(), "at": pa.int64(), "size": pa.int64()}
_ROWS = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "html": pa.string()}


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html, digest, refers_to); capture lines (key, page_id, file, at, size)."""

    def lines(batches):
        name, at = _own(folder, ".warc.gz"), 0
        with open(name, "wb") as f:
            for batch in batches:
                for row in zip(*batch.columns):
                    page_id, url, html, digest, refers_to = (x.as_py() for x in row)
                    payload = (html or "").encode()
                    member = record(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), refers_to)
                    f.write(member)
                    key = url_key(url)
                    yield (key, page_id, name, at, len(member)), len(key) + len(name) + 24
                    at += len(member)

    return pages.mapInArrow(lambda batches: _batches(lines(batches), _LINES), "key string, page_id long, file string, at long, size long")


def _sort_key(key: str, page_id) -> tuple[str, str]:
    # numbers in text that sort as numbers do; null first
    return key, "" if page_id is None else f"{page_id + (1 << 63):020d}"


def write_index(lines: DataFrame, folder: str) -> DataFrame:
    """Write sorted capture lines as compressed blocks and their directories; (part, first, blocks) of each part."""
    n = partitions(lines.sparkSession)
    order = [F.col("key"), F.col("page_id"), F.col("file"), F.col("at")]
    dealt = lines.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches):
        part = _own(folder, "")
        directory, block, at = [], [], 0
        with open(f"{part}.cdx", "wb") as f:

            def flush():
                nonlocal at, block
                data = zlib.compress("\n".join(json.dumps(x) for x in block).encode(), 1)
                f.write(data)
                directory.append([*_sort_key(block[0][0], block[0][1]), at, len(data)])
                at, block = at + len(data), []

            for batch in batches:
                for line in zip(*(c.to_pylist() for c in batch.columns)):
                    block.append(line)
                    if len(block) == BLOCK:
                        flush()
            if block:
                flush()
        if not directory:
            os.remove(f"{part}.cdx")
            return
        with open(f"{part}.idx", "w") as f:
            f.write("\n".join(json.dumps(x) for x in directory))
        yield pa.RecordBatch.from_pydict({"part": [part], "key": [directory[0][0]], "id": [directory[0][1]], "blocks": [len(directory)]})

    return dealt.mapInArrow(run, "part string, key string, id string, blocks long")


class CaptureIndex:
    """Looks keys up: parts, then a part's directory, then one block; the last block is remembered."""

    def __init__(self, parts: list[tuple[str, str, str]]):
        """parts: (first key, its id, path), in order."""
        self.parts = parts
        self.directory: tuple[str, list] = ("", [])
        self.block: tuple[tuple[str, int], dict] = (("", -1), {})
        self.blocks_read = 0

    def find(self, key: str, page_id) -> list[tuple[str, int, int]]:
        """(file, at, size) of the captures of a page, over as many blocks as they lie in."""
        want = _sort_key(key, page_id)
        out: list[tuple[str, int, int]] = []
        # equal keys may begin in the block before and go on in those after
        p = bisect_right(self.parts, want, key=lambda x: (x[0], x[1])) - 1
        while p >= 0:
            path = self.parts[p][2]
            if self.directory[0] != path:
                with open(f"{path}.idx") as f:
                    self.directory = (path, [json.loads(x) for x in f])
            entries = self.directory[1]
            b = bisect_right(entries, want, key=lambda x: (x[0], x[1])) - 1
            while b >= 0:
                first, _, at, size = entries[b][0], entries[b][1], entries[b][2], entries[b][3]
                if self.block[0] != (path, at):
                    with open(f"{path}.cdx", "rb") as f:
                        f.seek(at)
                        rows = [json.loads(x) for x in zlib.decompress(f.read(size)).decode().split("\n")]
                    held: dict = {}
                    for k, i, *place in rows:
                        held.setdefault((k, i), []).append(tuple(place))
                    self.block = ((path, at), held)
                    self.blocks_read += 1
                out += self.block[1].get((key, page_id), [])
                if (entries[b][0], entries[b][1]) < want:
                    return out
                b -= 1
            p -= 1
        return out


def read_back(lookups: DataFrame, parts: list[tuple[str, str, str]], texts: bool = True) -> DataFrame:
    """Every page of lookups (key, page_id), sorted, through the index and a range read of its record.

    Payloads are checked against their digests; they are returned, as html, if
    texts is set. A worker holds a block of lines, a record and a few megabytes
    of rows.
    """

    def rows(batches):
        index, handles = CaptureIndex(parts), {}
        for batch in batches:
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for file, at, size in index.find(key, page_id):
                    if file not in handles:
                        if len(handles) >= 64:
                            handles.pop(next(iter(handles))).close()
                        handles[file] = open(file, "rb")  # noqa: SIM115
                    handles[file].seek(at)
                    r = parse(handles[file].read(size))
                    digest, payload = r["WARC-Payload-Digest"].removeprefix("sha1:"), r["payload"]
                    if payload is not None and (len(payload) != r["http_length"] or base32_sha1(payload) != digest):
                        raise ValueError(f"{file} at {at}: the payload is damaged")
                    refers = r.get("X-Refers-To-Page")
                    html = payload.decode() if texts and payload is not None else None
                    yield (page_id, r["http_length"], digest, r["WARC-Type"], int(refers) if refers else None, html), 200 + len(html or "")
        for f in handles.values():
            f.close()

    return lookups.mapInArrow(
        lambda batches: _batches(rows(batches), _ROWS), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
    )


def _revisits(rows: DataFrame, least: int, tag: str) -> DataFrame:
    """rows with refers_to: the largest page_id of an equal payload, null for that page itself.

    Digests alone are grouped; only groups of two pages or more come back.
    """
    groups = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1 and last is not null").withColumnRenamed("digest", "of"), f"{tag}-groups")
    rows = looked_up(rows, "digest", F.xxhash64("page_id", "url"), groups, rows.count(), "last")
    return rows.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def archive(pages: DataFrame, folder: str, least: int = 0, tag: str = "warc", texts: bool = True) -> DataFrame:
    """Write pages (page_id, url, html) as WARC with an index in a mounted folder, and read all back through it.

    Of the pages with equal payloads of at least ``least`` bytes the one with
    the largest page_id is the response and the others revisit it; smaller
    payloads are all responses. A null html is an empty payload, a null url has
    key "-", control characters and spaces of a url are escaped. Rows that
    repeat the largest page_id are responses too; a null page_id is smaller
    than any other and a response where it is alone. An empty table gives no
    rows. Returns page_id, payload_bytes, payload_digest, record_type,
    refers_to and html (null for revisits, and for all unless texts is set).
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html"),
        F.sha1(body).alias("digest"), F.octet_length(body).alias("bytes"),
    )
    told = _revisits(rows, least, tag)
    lines = written(write_archives(told, f"{folder}/archive"), f"{tag}-lines")
    parts = written(write_index(lines, f"{folder}/index"), f"{tag}-parts")
    # one entry a part of the index, as many as shuffle partitions
    top = sorted((r["key"], r["id"], r["part"]) for r in parts.collect())
    keys = lines.groupBy("key", "page_id").agg(F.count("*").alias("n")).select("key", "page_id")
    n = partitions(pages.sparkSession)
    return read_back(keys.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id"), top, texts)
