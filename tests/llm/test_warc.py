import hashlib
from collections import Counter

import pytest
import zstandard
from pyspark.sql import types as T

from runlens.llm import warc

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                       T.StructField("digest", T.StringType()), T.StructField("first", T.StringType())])
SAME = "<p>" + "same é " * 300
ROWS = [(1, "http://a/1", SAME, "x", None), (2, None, SAME, "x", None), (9, "http://a/9\r\nX: y", SAME, "x", None), (9, "u", SAME, "x", None),
        (None, "http://a/n", SAME, "x", None), (3, "u", None, "x", None), (4, "u", "", "x", None), (5, "u", "short", "x", None),
        (6, "u", "short", "x", None), (7, "u", "line\r\n\r\nWARC/1.1\r\n\r\n" * 100, "x", None), (8, "u", "z" * 3_000_000, "x", None),
        (10, "u", "a" * 1000, "x", None), (11, "u", "a" * 1000, "x", None), (12, "u", "b" * 999, "x", None), (13, "u", "b" * 999, "x", None)]


def expected(rows):
    out, groups = [], {}
    for page_id, _, html, *_ in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000 and page_id is not None:
            groups[raw] = max(page_id, groups.get(raw, page_id))
    for page_id, _, html, *_ in rows:
        raw = (html or "").encode()
        to = groups.get(raw) if len(raw) >= 1000 else page_id
        revisit = len(raw) >= 1000 and to is not None and to != page_id
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None,
                    b"" if revisit else raw))
    return Counter(out)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


SMALL = warc.Bundling(frame_bytes=4000, bundle_bytes=20_000)


@pytest.mark.parametrize("p", [warc.BUNDLING, SMALL])
def test_round_trip(pages, p):
    got = warc.read(warc.write(pages, p)).collect()
    assert Counter(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got) == expected(ROWS)


def test_whole_table(spark, sf, duck):
    from runlens.llm.queries import ORACLES, QUERIES
    got = sorted(map(tuple, QUERIES["op10_warc_bundles"](spark, sf).collect()))
    rel = duck.sql(ORACLES["op10_warc_bundles"])
    order = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert got == sorted(rel.project(", ".join(order)).fetchall())


def test_bundles_are_seekable_zstandard(pages):
    bundles = warc.write(pages, SMALL)
    index = {(r["bundle"], r["frame"], r["offset"]): r for r in warc.index(bundles).collect()}
    n = 0
    for b in bundles.collect():
        data = bytes(b["data"])
        table = warc.frames(data)
        assert len(table) == b["frames"]
        assert data[-9 - 8 * len(table) - 8:][:4] == (0x184D2A5E).to_bytes(4, "little")
        parts = [warc.unpack(data, f) for f in table]
        stream = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()  # any reader sees one stream
        assert stream == b"".join(parts)
        for (name, frame, offset), r in index.items():
            if name == b["bundle"]:
                head, body = warc.read_record(data, frame, offset)
                assert head["WARC-Record-ID"] == f"<urn:page:{'' if r['page_id'] is None else r['page_id']}>"
                assert int(head["Content-Length"]) == len(body)
                assert parts[frame][offset:offset + r["length"]].startswith(b"WARC/1.1\r\n")
                n += 1
    assert n == len(ROWS)


def test_export(pages, tmp_path):
    bundles = warc.write(pages, SMALL)
    done = {r["bundle"]: r["bytes"] for r in warc.export(bundles, f"file://{tmp_path}/out").collect()}
    files = {f.name: f.stat().st_size for f in (tmp_path / "out").iterdir()}
    assert files == done and len(files) == bundles.count()


def test_empty(spark):
    b = warc.write(spark.createDataFrame([], SCHEMA))
    assert b.count() == 0 and warc.read(b).count() == 0 and warc.index(b).count() == 0
