"""Token counts (operator 8): offset-mapped attribution of whole-document tokens to sections.

A document is encoded once and whole, as a model sees it; encoding sections alone would give other
tokens at their borders. Every token has a span of code points; the spans are interval-joined to
the document's sections (sorted, not overlapping) by binary search. The rule for the rest:

* a token that crosses a border goes, whole, to the section that holds most of its code points, of
  equals to the first;
* a token that lies between sections (line ends) goes to the section before it, or to the first;
* a byte-level token that is part of one code point goes where that code point is.

So the sections' counts add up to the document's tokens. The tokenizer is the public byte-level BPE; its
pattern cuts a text into pieces whose tokens do not depend on their neighbours, and the token
lengths of frequent pieces are remembered (``LIMIT``), others are encoded again.

Sections are the text's lines unless ``split`` says otherwise (text -> list of (start, end)).

Edge cases: null or empty text has one empty section without tokens; blank lines are sections
without code points and get a token only as the one before a gap. Texts are read whole, one at a time.
Null ids are carried. Rows that repeat are counted alike. Empty tables give empty results.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEADS, text_slices, texts_of

LIMIT = 300_000
LONGEST = 64


class _Pieces(dict):
    """Piece -> the byte lengths of its tokens, as bytes."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encode = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = np.zeros(max(ranks.values()) + 1, np.uint8)
        for token, rank in ranks.items():
            self.size[rank] = len(token)

    def __missing__(self, piece: str) -> bytes:
        sizes = self.size[self.encode(piece)].tobytes()
        if len(self) < LIMIT and len(piece) < LONGEST:
            self[piece] = sizes
        return sizes


_open: dict[str, tuple] = {}


def token_sizes(text: str, path: str | None = None) -> np.ndarray:
    """Byte lengths of the text's tokens, in order."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _open:
        import regex

        _open[path] = _Pieces(path, public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN)
    pieces, pattern = _open[path]
    return np.frombuffer(b"".join(map(pieces.__getitem__, pattern.findall(text))), np.uint8)


def lines(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def spans(text: str, raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point spans of tokens from their byte lengths. A token without a first byte of a code point
    spans the code point it is part of."""
    end = np.cumsum(sizes, dtype=np.int64)
    start = end - sizes
    if len(raw) == len(text):
        return start, end
    leads = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(LEADS[np.frombuffer(raw, np.uint8)], out=leads[1:])
    s, e = leads[start], leads[end]
    part = s == e
    return np.where(part, s - 1, s), e


def attributed(start: np.ndarray, end: np.ndarray, sections: list[tuple[int, int]]) -> np.ndarray:
    """Tokens of each section by the rule above."""
    a, b = np.array(sections, np.int64).reshape(-1, 2).T
    first = np.searchsorted(b, start, side="right")   # first section that ends after the token's start
    stop = np.searchsorted(a, end, side="left")       # first section that begins at or after its end
    to = np.where(first < stop, first, np.maximum(stop - 1, 0))
    for i in np.flatnonzero(stop - first > 1):
        k = np.arange(first[i], stop[i])
        to[i] = k[np.argmax(np.minimum(b[k], end[i]) - np.maximum(a[k], start[i]))]
    return np.bincount(to, minlength=len(sections))


COUNTS = "doc_id bigint, section int, start bigint, n_chars bigint, n_tokens bigint, doc_tokens bigint"


def attribute(docs: DataFrame, split: Callable[[str], list[tuple[int, int]]] = lines, path: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per section (COUNTS)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            of, parts, tokens, totals = [], [], [], []
            for row, raw in enumerate(texts_of(b.column("text"))):
                text = raw.decode()
                sections = split(text)
                if not sections:
                    continue
                sizes = token_sizes(text, path)
                got = attributed(*spans(text, raw, sizes), sections)
                of.append((row, len(sections)))
                parts += sections
                tokens.append(got)
                totals.append(len(sizes))
            if not of:
                continue
            rows, n = np.array(of, np.int64).T
            a, z = np.array(parts, np.int64).T
            number = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(np.repeat(rows, n))), pa.array(number.astype(np.int32)), pa.array(a), pa.array(z - a),
                 pa.array(np.concatenate(tokens)), pa.array(np.repeat(np.array(totals, np.int64), n))],
                names=[x.split()[0] for x in COUNTS.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(count, COUNTS)
