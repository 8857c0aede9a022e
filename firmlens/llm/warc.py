"""WARC archives with a two-level capture index.

Writing: each task writes one archive of gzip members, a record each, to the shared
folder and returns its index lines. Equal payloads are stored once: the capture with the
largest id is a response, the others are revisits that refer to it.

Index: lines are sorted by reversed-host URL key into compressed blocks of a fixed number
of lines; a sparse directory keeps each block's first key, file, offset and length. A
lookup searches the directory, reads one block's range, searches in it and reads one
record's range.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import shared_dir, stored

BLOCK_LINES = 2_000
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_LEVEL = 6


def sort_key(url: str | None) -> str:
    """Reversed-host key: `http://www.A.org/x?y` -> `org,a)/x?y`; null or no host: `)` and the rest."""
    rest = (url or "").partition("://")[2] or ""
    host, tail = re.match(r"([^/?#]*)([^#]*)", rest, re.S).groups()
    host = re.sub(r"^www\d*\.", "", host.rpartition("@")[2].lower())
    name, _, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + (tail or "/")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def capture_uri(page_id) -> str:
    return f"<urn:capture:{page_id}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; a revisit has no payload but the length of the one it refers to."""
    revisit = refers_to is not None
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": capture_uri(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\r\n]+", "%0A", url or ""),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    if revisit:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": capture_uri(refers_to)}
    head["Content-Length"] = str(len(body))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict, bytes, bytes]:
    """(WARC headers, HTTP head, payload) of one record."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    head = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])
    body = rest[: int(head["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return head, http, payload


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system that drivers and executors reach alike, by the scheme of the shared folder."""
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def attempt() -> str:
    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId()}" if context else uuid.uuid4().hex


def deduplicated(pages: DataFrame, page_id: str = "page_id", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """(id, sha1, refers_to): each id and payload once, and the capture that it revisits, or null.

    A null id never is what others revisit, unless no equal payload has an id; then all
    are responses. Rows of one id are told apart by their payloads. Only ids and digests move: digests held twice or more are found with map-side
    combining and joined back, where AQE splits a digest that many pages share.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    ids = stored(pages.select(F.col(page_id).alias("id"), F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("n")), "digests")
    top = ids.where(F.col("n") >= min_bytes).groupBy("sha1").agg(F.max("id").alias("top"), F.count("*").alias("c")).where("c > 1").select("sha1", "top")
    joined = ids.join(top.hint("shuffle_merge"), "sha1", "left")
    return joined.select("id", "sha1", F.when(~F.col("id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to")).distinct()


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> tuple[str, DataFrame]:
    """Write archives; returns their folder and (key, id, file, offset, length), a row per page.

    Null payloads are empty, null urls are empty. Every row is a capture, also where ids
    repeat or are null (a null id's record is named by nothing but its place). A task that runs again writes a new file; only files that index lines name are ever read.
    """
    folder = f"{shared_dir(pages.sparkSession)}/firmlens/warc-{uuid.uuid4().hex}"
    roles = stored(deduplicated(pages, page_id, html, min_bytes), "roles")
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), F.sha1(F.coalesce(F.col(html), F.lit("")).cast("binary")).alias("sha1"))
    same = rows["id"].eqNullSafe(roles["id"]) & (rows["sha1"] == roles["sha1"])
    rows = rows.join(roles.hint("shuffle_hash"), same).select(rows["id"], "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = store(folder)
        files.create_dir(top, recursive=True)
        name, out, at = f"{attempt()}.warc.gz", None, 0
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, 64):
                    lines = []
                    for r in batch.slice(start, 64).to_pylist():
                        payload = (r["html"] or "").encode()
                        data = gzip.compress(record(r["id"], r["url"], payload, payload_digest(payload), r["refers_to"]), _LEVEL, mtime=0)
                        out = out or files.open_output_stream(f"{top}/{name}", compression=None)
                        out.write(data)
                        lines.append((sort_key(r["url"]), r["id"], name, at, len(data)))
                        at += len(data)
                    if lines:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*lines, strict=True), LINE.types, strict=True)], schema=LINE)
        finally:
            if out:
                out.close()

    return folder, stored(rows.mapInArrow(run, "key string, id long, file string, offset long, length long"), "cdx")


LINE = pa.schema([("key", pa.string()), ("id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
DIRECTORY = pa.schema([("key", pa.string()), ("id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64())])


def index(folder: str, lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the sorted, compressed index blocks; returns the sparse directory, a row per block.

    Lines are dealt by range of (key, id), so that a key with very many captures is
    split, and each task writes its sorted run as one file of gzip members.
    """
    n = lines.count()
    parts = max(1, min(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // (4 * block_lines))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = store(folder)
        name, out, at, waiting, made = f"{attempt()}.cdx.gz", None, 0, [], []

        def flush() -> None:
            nonlocal out, at, waiting
            data = gzip.compress("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in waiting).encode(), _LEVEL, mtime=0)
            out = out or files.open_output_stream(f"{top}/{name}", compression=None)
            out.write(data)
            made.append((waiting[0][0], waiting[0][1], name, at, len(data), len(waiting)))
            at, waiting = at + len(data), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting.append(row)
                if len(waiting) == block_lines:
                    flush()
        if waiting:
            flush()
        if out:
            out.close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), DIRECTORY.types, strict=True)], schema=DIRECTORY)

    ranged = lines.select(*LINE.names).repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")
    return stored(ranged.mapInArrow(run, "key string, id long, file string, offset long, length long, lines long"), "directory")


def read_block(files: fs.FileSystem, top: str, file: str, offset: int, length: int) -> list[list]:
    with files.open_input_file(f"{top}/{file}") as f:
        return [json.loads(x) for x in gzip.decompress(f.read_at(length, offset)).decode().split("\n")[:-1]]


def lookup(folder: str, directory: list[tuple], url: str) -> list[dict]:
    """All captures of a url by binary search: `directory` is (key, file, offset, length) sorted by key.

    Reads the blocks whose range can hold the key, then the records themselves.
    """
    files, top = store(folder)
    key, keys, out = sort_key(url), [d[0] for d in directory], []
    for d in directory[max(0, bisect.bisect_left(keys, key) - 1) : bisect.bisect_right(keys, key)]:
        lines = read_block(files, top, *d[1:4])
        heads = [x[0] for x in lines]
        for _, _, file, offset, length in lines[bisect.bisect_left(heads, key) : bisect.bisect_right(heads, key)]:
            with files.open_input_file(f"{top}/{file}") as f:
                head, _, payload = parse(zlib.decompress(f.read_at(length, offset), 31))
            out.append({"head": head, "payload": payload})
    return out


def captures(folder: str, directory: DataFrame) -> DataFrame:
    """Every capture that the index leads to, read back from the archives by ranges.

    (id, url, payload, payload_bytes, payload_digest, record_type, refers_to); a revisit's
    payload is null and its length that of the payload it refers to. A row per capture.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = store(folder)
        for batch in batches:
            for d in batch.to_pylist():
                opened, out = {}, []
                for line in sorted(read_block(files, top, d["file"], d["offset"], d["length"]), key=lambda x: (x[2], x[3])):
                    f = opened.get(line[2])
                    if f is None:
                        for x in opened.values():
                            x.close()
                        opened = {line[2]: (f := files.open_input_file(f"{top}/{line[2]}"))}
                    head, http, payload = parse(zlib.decompress(f.read_at(line[4], line[3]), 31))
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest, revisit = head["WARC-Payload-Digest"].partition(":")[2], head["WARC-Type"] == "revisit"
                    if not revisit and (len(payload) != size or payload_digest(payload) != digest):
                        raise ValueError(f"{line[2]} at {line[3]}: the payload does not fit its digest")
                    refers = int(head["WARC-Refers-To"].rpartition(":")[2][:-1]) if revisit else None
                    out.append((line[1], head["WARC-Target-URI"], None if revisit else payload, size, digest, head["WARC-Type"], refers))
                    if len(out) == 256:
                        yield _captures(out)
                        out = []
                for x in opened.values():
                    x.close()
                if out:
                    yield _captures(out)

    blocks = directory.repartition(max(1, min(directory.count(), int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    return blocks.mapInArrow(run, "id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


CAPTURE = pa.schema([("id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), CAPTURE.types, strict=True)], schema=CAPTURE)
