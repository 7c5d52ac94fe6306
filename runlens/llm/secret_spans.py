"""Secret scans (operator 9): Aho-Corasick keyword prefilter, anchored patterns, checksums.

One pass of an Aho-Corasick automaton over the whole text (ASCII letters folded) finds the places
where a keyword ends; only there are the patterns tried, anchored at the keyword. Base kinds:

* assign: a keyword, an optional quote, ``:`` or ``=``, and a value of 6 or more characters;
* access: ``AKIA`` and capitals or digits, 20 or more in all;
* hex: a run of 24 or more of ``0-9a-f``. It has no keyword; runs are found by byte class.

Within a kind matches are leftmost and do not overlap; one that fails the length still uses its
text up, as in a plain left-to-right search. Added kinds are tokens that carry a checksum, and only
those whose checksum holds are kept: github and npm tokens (30 characters and the CRC-32 of them
in six base-62 digits).

A task holds one text at a time and every pattern starts at a keyword, so cost is linear in the
text but for the blanks that may follow a keyword. Edge cases: null is empty and has no span;
texts are read whole; spans count code points. Empty tables give empty results; rows that repeat
are scanned alike. Only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEADS, text_slices, texts_of

# The kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "github", "npm")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
}
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
CHECKED = {"github": re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
           "npm": re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")}
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


_open: list[ahocorasick.Automaton] = []


def checksum(body: bytes) -> str:
    """CRC-32 of a token's body in six base-62 digits."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _DIGITS[d] + out
    return out


def hex_runs(text: bytes, least: int = MIN_HEX) -> list[tuple[int, int]]:
    flags = np.zeros(len(text) + 2, np.int8)
    flags[1:-1] = _HEX[np.frombuffer(text, np.uint8)]
    step = np.diff(flags)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist()))


def spans(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start and then by kind as listed."""
    if not _open:
        _open.append(_automaton())
    found = [(s, e, "hex") for s, e in hex_runs(text)]
    used = dict.fromkeys(KINDS, 0)
    hits = [(end - n + 1, kind) for end, (kind, n) in _open[0].iter(text.lower().decode("latin-1"))]
    for at, kind in sorted(hits):
        if at < used[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                used[kind] = m.end()
                if len(m[2]) >= MIN_VALUE:
                    found.append((at, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                used[kind] = m.end()
                if m.end() - at >= MIN_ACCESS:
                    found.append((at, m.end(), kind))
        elif m := CHECKED[kind].match(text, at):
            if checksum(m[1]) == m[2].decode():
                used[kind] = m.end()
                found.append((at, m.end(), kind))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def in_code_points(text: bytes, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    if not found or text.isascii():
        return found
    before = np.zeros(len(text) + 1, np.int64)
    np.cumsum(LEADS[np.frombuffer(text, np.uint8)], out=before[1:])
    return [(int(before[s]), int(before[e]), kind) for s, e, kind in found]


def scan(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, spans: array of (start, end, kind) in code points."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for b in text_slices(batches):
            rows = [[{"start": s, "end": e, "kind": k} for s, e, k in in_code_points(t, spans(t))]
                    for t in texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, spans array<struct<start:bigint,end:bigint,kind:string>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts and joined spans of what ``scan`` found."""
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS[:3]))
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))
