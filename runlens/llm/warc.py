"""WARC (operator 10): seekable Zstandard bundles.

Records are grouped into frames of about ``frame_bytes``, each an independent Zstandard frame; a
bundle is its frames and a footer, the seek table of the public Zstandard seekable format (a
skippable frame with the compressed and the raw size of every frame, and a fixed end), so any
reader unpacks a bundle as one stream and a seeking one finds a frame from the end of the file.
An index maps each record identifier to its bundle, frame, offset in the unpacked frame and length.

Among records with equal payloads of at least ``min_revisit`` bytes the one with the largest id is
the response; the others are revisits that carry the payload's digest and length and the
response's id, but no payload. The choice needs digests only: one aggregate on the digest and
a join back on it. Payloads are moved once, to the task that bundles them.

Bundles are rows of a Parquet table (name, frames, data) written by Spark: the commit protocol
makes them whole or absent when an executor is lost, on any store. ``export`` copies them to
files. A bundle closes at ``bundle_bytes`` of raw records, so a task holds one bundle (or one longer
record) at a time.

Edge cases: a null payload is empty; an empty table gives no bundles. Rows that repeat the id and
payload of a response are responses too. A null id is written as empty and is never referred to;
copies whose ids are all null are all responses. Only the three named columns are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_slices, texts_of


@dataclass(frozen=True)
class Bundling:
    frame_bytes: int = 1 << 18
    bundle_bytes: int = 16 << 20
    min_revisit: int = 1000
    level: int = 3


BUNDLING = Bundling()
# Fixed values of the public seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "2000-01-01T00:00:00Z"  # the input has no fetch time; a fixed one keeps bundles reproducible


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has no payload but its digest and length."""
    def urn(i):
        return f"<urn:page:{'' if i is None else i}>"

    body = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}",
            f"WARC-Date: {_DATE}", f"WARC-Target-URI: {' '.join((url or '').split())}",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The record at ``at`` of an unpacked frame: headers, body, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = data[end + 4:end + 4 + int(head["Content-Length"])]
    return head, body, end + 4 + len(body) + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *s) for s in sizes)
    return struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(sizes), 0, SEEKABLE)


def frames(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, raw size) of each frame, read from the footer."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    out, at = [], 0
    for packed, raw in struct.iter_unpack("<II", data[-9 - 8 * n:-9]):
        out.append((at, packed, raw))
        at += packed
    return out


def unpack(data: bytes, frame: tuple[int, int, int]) -> bytes:
    at, packed, raw = frame
    return zstandard.ZstdDecompressor().decompress(data[at:at + packed], max_output_size=raw)


def read_record(data: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record of a bundle by what the index says: only its frame is unpacked."""
    return parse(unpack(data, frames(data)[frame]), offset)[:2]


def decided(pages: DataFrame, p: Bundling = BUNDLING) -> DataFrame:
    """``pages(page_id, url, html)`` -> page_id, url, html, digest, revisit, refers_to."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    large = F.octet_length("html") >= p.min_revisit
    first = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("digest").alias("_digest"), "first")
    rows = rows.join(first, large & (F.col("digest") == F.col("_digest")), "left")
    return rows.select("page_id", "url", "html", "digest",
                       (F.col("_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"),
                       F.col("first").alias("refers_to"))


BUNDLE = "bundle string, frames int, data binary, ids array<bigint>, record_frames array<int>, offsets array<bigint>, lengths array<bigint>"


def write(pages: DataFrame, p: Bundling = BUNDLING) -> DataFrame:
    """Write the bundles to the shared folder and return the table of them (BUNDLE: with the index of
    their records)."""
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=p.level, write_content_size=True).compress
        data, sizes, index, open_frame, room = [], [], [], [], 0

        def close_frame():
            nonlocal open_frame
            if open_frame:
                raw = b"".join(open_frame)
                data.append(pack(raw))
                sizes.append((len(data[-1]), len(raw)))
                open_frame = []

        def close():
            nonlocal data, sizes, index, room, made
            close_frame()
            columns = [pa.array([f"{task:06d}-{made:06d}.warc.zst"]), pa.array([len(sizes)], pa.int32()),
                       pa.array([b"".join(data) + seek_table(sizes)], pa.binary())]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            columns += [pa.array([c], pa.list_(k)) for c, k in zip(map(list, zip(*index)), kinds)]
            made += 1
            data, sizes, index, room = [], [], [], 0
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BUNDLE.split(", ")])

        at = 0
        for b in text_slices(batches, "html"):
            rows = zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), texts_of(b.column("html")),
                       b.column("digest").to_pylist(), b.column("refers_to").to_pylist(), b.column("revisit").to_pylist())
            for row in rows:
                r = record(*row)
                if not open_frame:
                    at = 0
                index.append((row[0], len(sizes), at, len(r)))
                open_frame.append(r)
                at += len(r)
                room += len(r)
                if at >= p.frame_bytes:
                    close_frame()
                if room >= p.bundle_bytes:
                    yield close()
        if index:
            yield close()

    return staged(decided(pages, p).mapInArrow(bundle, BUNDLE), "warc-bundles")


def index(bundles: DataFrame) -> DataFrame:
    """page_id -> bundle, frame, offset in the unpacked frame, length."""
    r = F.explode(F.arrays_zip("ids", "record_frames", "offsets", "lengths")).alias("r")
    return bundles.select("bundle", r).select(F.col("r.ids").alias("page_id"), "bundle", F.col("r.record_frames").alias("frame"),
                                              F.col("r.offsets").alias("offset"), F.col("r.lengths").alias("length"))


READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def read(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the bundles, found through their seek tables (READ). A response's digest and
    length are made anew from what was read, a revisit's are those its record carries."""
    import hashlib

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def number(urn):
            return int(urn[10:-1]) if len(urn) > 11 else None

        for b in batches:
            for data in b.column("data").to_pylist():
                for f in frames(data):
                    raw, at, rows = unpack(data, f), 0, []
                    while at < len(raw):
                        head, body, at = parse(raw, at)
                        revisit = head["WARC-Type"] == "revisit"
                        rows.append((number(head["WARC-Record-ID"]),
                                     int(head["X-Payload-Length"]) if revisit else len(body),
                                     head["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else hashlib.sha1(body).hexdigest(),
                                     head["WARC-Type"], number(head["WARC-Refers-To"]) if revisit else None, body))
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                    names = [x.split()[0] for x in READ.split(", ")]
                    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    yield batch if payloads else batch.drop_columns(["payload"])

    schema = READ if payloads else READ.removesuffix(", payload binary")
    return bundles.select("data").mapInArrow(records, schema)


def export(bundles: DataFrame, uri: str) -> DataFrame:
    """Copy the bundles to files under ``uri`` (any store that pyarrow opens, or a shared folder):
    written under another name, then renamed, so a lost task leaves no half file under a final name."""
    def copy(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        for b in batches:
            for name, data in zip(b.column("bundle").to_pylist(), b.column("data").to_pylist()):
                part = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(part) as f:
                    f.write(data)
                store.move(part, f"{base}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)], pa.int64())], names=["bundle", "bytes"])

    return staged(bundles.select("bundle", "data").mapInArrow(copy, "bundle string, bytes bigint"), "warc-export")
