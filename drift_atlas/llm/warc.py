"""WARC archives with an index first: write, index, then read by coalesced byte ranges.

Writing. Rows meet, by page and digest, the page they revisit, if any; then each
task streams its rows into archives of bounded size, one gzip member per record,
and emits one index row per record: file, offset, length, URL and digest. A file
carries its task attempt in its name. Only attempts that succeed reach the index,
so what a lost executor left behind is never read.

Reading. The index of the selected records is grouped by file and aligned
stretch, sorted, and neighbouring ranges are coalesced into one read. Every
record read is checked against its digest.

Archives are opened through Arrow's file systems, so the folder may be local,
HDFS or an object store; it lies below the session's shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drift_atlas.llm import common

#: Compressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 64 << 20
#: Aligned stretch of an archive that one read may span, and the gap that a read bridges.
STRETCH_BYTES, GAP_BYTES = 8 << 20, 1 << 16
WARC_DATE = "2024-01-01T00:00:00Z"

_INDEX = "page_id long, url string, digest string, file string, `offset` long, length long"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_digest(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _uri(url: str | None) -> str:
    """The URL on one line: white space, control and non-ASCII characters are percent-encoded."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "urn:none"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """A record's fields; raises ValueError if its length or its payload's digest is wrong."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    full = next(int(line.split(b": ")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != full or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload does not have its digest")
    whole = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": whole("Page-ID"), "payload_bytes": full, "payload_digest": digest, "record_type": kind, "refers_to": whole("Refers-To-Page-ID"), "payload": payload if kind == "response" else None}


def _writer(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        stem = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        made, out, at, name = 0, None, 0, ""
        try:
            for batch in batches:
                columns = {n: [] for n in ("page_id", "url", "digest", "file", "offset", "length")}
                for page_id, url, html, sha1, refers, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{stem}-{made:04d}.warc.gz", 0
                        made += 1
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    digest = base32_digest(sha1)
                    raw = build_record(page_id, url, (html or "").encode(), digest, refers, again)
                    press = zlib.compressobj(3, zlib.DEFLATED, 31)
                    packed = press.compress(raw) + press.flush()
                    out.write(packed)
                    for key, value in zip(columns, (page_id, url, digest, name, at, len(packed)), strict=True):
                        columns[key].append(value)
                    at += len(packed)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns.values(), kinds, strict=True)], names=list(columns))
        finally:
            if out is not None:
                out.close()

    return run


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with fs.open_input_file(f"{base}/{name}") as f:
                    for start, end, members in coalesce_ranges([(r["offset"], r["length"], r["digest"]) for r in ranges]):
                        f.seek(start)
                        data = f.read(end - start)
                        for offset, length, digest in members:
                            row = parse_record(zlib.decompress(data[offset - start : offset - start + length], 31))
                            if row["payload_digest"] != digest:
                                raise ValueError("a record is not the one its index row names")
                            rows.append(row)
                kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))

    return run


def coalesce_ranges(ranges: list[tuple[int, int, str]], gap: int = GAP_BYTES) -> list[tuple[int, int, list[tuple[int, int, str]]]]:
    """Sort (offset, length, ...) ranges and join those that are at most ``gap`` bytes apart."""
    out: list[tuple[int, int, list[tuple[int, int, str]]]] = []
    for r in sorted(ranges):
        if out and r[0] - out[-1][1] <= gap:
            start, end, members = out[-1]
            out[-1] = (start, max(end, r[0] + r[1]), [*members, r])
        else:
            out.append((r[0], r[0] + r[1], [r]))
    return out


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row and return the index: page_id, url, digest, file, offset, length.

    Of the rows with equal payloads of at least ``min_revisit_bytes`` bytes, those
    with the smallest id are responses and the others revisit it; so are repeats
    of that id responses. Null HTML is an empty payload. Rows without an id revisit
    the smallest id of their payload, or are responses if no row of it has an id.
    Further columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    digests = common.materialize(rows.where(F.octet_length("html") >= min_revisit_bytes).select("page_id", "sha1"), "page-digests")
    groups = digests.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    groups = common.materialize(groups.select("sha1", "first"), "payload-groups")
    again = digests.join(groups, "sha1").where("page_id is null or page_id > first").distinct()
    again = common.materialize(again.select(F.col("page_id").alias("__page"), F.col("sha1").alias("__sha1"), F.col("first").alias("refers_to")), "revisits")
    met = rows.join(again, rows["page_id"].eqNullSafe(F.col("__page")) & (rows["sha1"] == F.col("__sha1")), "left")
    met = met.select("page_id", "url", "html", "sha1", "refers_to", F.col("refers_to").isNotNull())
    fs, where = common.hadoop_fs(pages.sparkSession, folder)
    fs.mkdirs(where)
    return common.materialize(met.mapInArrow(_writer(folder, archive_bytes), _INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, stretch_bytes: int = STRETCH_BYTES) -> DataFrame:
    """The indexed records: page_id, payload_bytes, payload_digest, record_type, refers_to, payload.

    A revisit has the bytes and digest of the full payload and a null payload.
    """
    stretches = index.groupBy("file", F.floor(F.col("offset") / stretch_bytes).alias("stretch"))
    ranges = stretches.agg(F.sort_array(F.collect_list(F.struct("offset", "length", "digest"))).alias("ranges"))
    return ranges.select("file", "ranges").mapInArrow(_reader(folder), _RECORD)
