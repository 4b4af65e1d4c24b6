"""WARC archives: a writer, and a reader that splits compressed files.

Writing: tasks write their rows to archives of their own, one gzip member per record, under a
shared folder that any file system of pyarrow can open. Names are unique per attempt, and the
returned manifest lists the files of the attempts that succeeded; others are never read. Of
records with equal payloads of at least ``least`` bytes the one with the largest page id is a
response, the others are revisits that refer to it and carry no payload.

Reading: files are cut into byte ranges. A task scans its range for the gzip magic and takes a
place for a member if the header of a record can be decoded there; from then on it goes from
member to member. It owns the records that start inside its range and reads past the end to
finish the last one, so every record is read exactly once whatever the range size.

Null payloads are empty ones; null urls and ids are left out of the header. Rows that share the
largest id of a group of equal payloads are all responses; null ids are smaller than any other.
A member that breaks off, or a record shorter than it says, is an error that names file and
offset.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcohort.llm.common import utf8
from seqcohort.session import scratch_path, settle

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("8c0bf3b0-6f0f-5d0e-9a55-1d6a6ee8f9c1")
SCHEMA = ("path string, offset long, record_type string, page_id long, refers_to long, uri string, "
          "payload_bytes long, payload_digest string, payload binary")


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder as Spark names it."""
    if re.match(r"^(file:)?/", uri):
        return fs.LocalFileSystem(), re.sub(r"^(file:)?/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, salt: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}{salt}')}>"


def header_value(text: str) -> str:
    """Header values hold no line ends or other control characters."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: a response, or a revisit of page ``refers_to``."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)),
              ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if url is not None:
        fields.append(("WARC-Target-URI", header_value(url)))
    if page_id is not None:
        fields.append(("WARC-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to)), ("WARC-Refers-To-Page-ID", str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def with_references(pages: DataFrame, least: int) -> DataFrame:
    """``pages`` (``page_id, url, html``) with ``refers_to``, null for responses."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.when(F.octet_length(html) >= least, F.sha2(html, 256)).alias("key"))
    tops = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("top")).filter("n > 1")
    # Only groups of several pages are on the right, one row each: a payload shared by very
    # many pages is split by the adaptive join.
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    return keyed.join(tops, "key", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = 1000, date: str = "2024-01-01T00:00:00Z",
                   file_bytes: int = 1 << 30, level: int = 6) -> DataFrame:
    """Archives of ``pages``; returns the written manifest ``path, bytes, records``."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(folder)
        out, path, written, records, listed = None, "", 0, 0, []
        for batch in stream:
            ids, urls, refers = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for page, url, payload, target in zip(ids, urls, utf8(batch.column(2)), refers):
                if out is None:
                    store.create_dir(root, recursive=True)
                    path, written, records = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                written += out.write(data := member(record(page, url, payload, target, date), level)) or len(data)
                records += 1
                if written >= file_bytes:
                    out.close()
                    listed.append((path, written, records))
                    out = None
        if out is not None:
            out.close()
            listed.append((path, written, records))
        if listed:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*listed)], ["path", "bytes", "records"])

    rows = with_references(pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ), least)
    return settle(rows.mapInArrow(run, "path string, bytes long, records long"))


class Ranged:
    """Reads at any offset, a chunk at a time."""

    def __init__(self, file, chunk: int = CHUNK):
        self.file, self.chunk, self.size, self.start, self.data = file, chunk, file.size(), 0, b""

    def at(self, offset: int, n: int) -> bytes:
        if offset < self.start or offset + n > self.start + len(self.data):
            self.file.seek(offset)
            self.start, self.data = offset, self.file.read(max(n, self.chunk))
        return self.data[offset - self.start:offset - self.start + n]


def decode_member(source: Ranged, offset: int, head_only: bool = False) -> tuple[bytes, int]:
    """The bytes of the member at ``offset`` and the offset behind it; with ``head_only`` about
    the first 64 bytes, empty if they cannot be decoded."""
    unpack, out, at, step = zlib.decompressobj(31), [], offset, 1 << 12
    while not unpack.eof:
        data = source.at(at, step)
        if not data:
            if head_only:
                break
            raise ValueError(f"member at {offset} breaks off")
        try:
            out.append(unpack.decompress(data, 64) if head_only else unpack.decompress(data))
        except zlib.error as error:
            if head_only:
                return b"", offset
            raise ValueError(f"member at {offset}: {error}") from error
        at += len(data)
        if head_only:
            break
        step = min(2 * step, source.chunk)
    return b"".join(out), at - len(unpack.unused_data)


def starts_record(source: Ranged, offset: int) -> bool:
    return source.at(offset, 3) == MAGIC and decode_member(source, offset, True)[0].startswith(b"WARC/1.")


def owned_members(source: Ranged, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the records that start in ``[start, end)``."""
    at, sure = start, False
    while at < min(end, source.size):
        if not sure:
            window = source.at(at, min(CHUNK, end - at) + len(MAGIC) - 1)
            found = window.find(MAGIC)
            if found < 0:
                at += min(CHUNK, end - at)
                continue
            at += found
            if not starts_record(source, at):
                at += 1
                continue
        data, behind = decode_member(source, at)
        yield at, data
        at = behind
        sure = at < end and starts_record(source, at)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, split, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields.get("content-length", 0))
    if not split or len(rest) < size:
        raise ValueError("record is shorter than its header says")
    return fields, rest[:size]


def read_archives(manifest: DataFrame, split_bytes: int = 64 << 20, with_payload: bool = False) -> DataFrame:
    """The records of the archives in ``manifest`` (``path, bytes``), with columns ``SCHEMA``."""
    step = F.lit(split_bytes).cast("long")
    ranges = manifest.filter("bytes > 0").select(
        "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, step)).alias("start")
    ).withColumn("end", F.col("start") + step)
    splits = manifest.agg(F.sum(F.ceil(F.col("bytes") / step))).first()[0] or 1

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for path, start, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
                store, name = open_fs(path)
                rows, held = [], 0
                with store.open_input_file(name) as file:
                    for offset, data in owned_members(Ranged(file), start, end):
                        try:
                            fields, block = parse(data)
                        except ValueError as error:
                            raise ValueError(f"{path} at {offset}: {error}") from error
                        kind = fields.get("warc-type")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        if kind == "revisit":
                            size = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
                            length, digest = int(size[1]) if size else None, fields.get("warc-payload-digest", "")
                            digest = base64.b32decode(digest.removeprefix("sha1:")).hex() if digest.startswith("sha1:") else None
                            payload = None
                        else:
                            length, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        page, target = fields.get("warc-page-id"), fields.get("warc-refers-to-page-id")
                        rows.append((path, offset, kind, page and int(page), target and int(target), fields.get("warc-target-uri"),
                                     length, digest, payload if with_payload else None))
                        held += len(data) if with_payload else 200
                        if held > CHUNK:
                            yield as_batch(rows)
                            rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    return ranges.repartition(int(splits), "path", "start").mapInArrow(run, SCHEMA)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 1000, split_bytes: int = 64 << 20) -> DataFrame:
    """Write ``pages`` to archives under ``folder`` (a new shared one by default), read them back."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, least), split_bytes)
