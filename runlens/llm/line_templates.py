"""Line dedup (operator 6): a log-template tree over all lines of the corpus.

A line is parsed by fixed depth: the number of its tokens, then its leading ``depth`` tokens, give
its leaf. Tokens with a digit are variable fields and become ``<*>`` first. At the leaf the rest of
the line is generalised: besides the line itself, a template leaves one third of the remaining
tokens open, the first, the second or the third one, so lines that differ in one such stretch meet in a
template whose other tokens are all equal. (A streaming template miner merges lines into the
first template that is alike enough, which depends on their order and needs the leaf in one
place; here a template is a key, and templates are counted like words.)

A line is data and no template if variable fields are most of it: with fewer than ``min_constant``
other tokens, or more fields than others, only the line as it stands is its key (rows of a number
table differ in nothing but their fields). The same holds for what an open third leaves.

A template that occurs in ``min_docs`` documents or more recurs: its lines are dropped, except in the
first document that has it. Lines of fewer than ``min_tokens`` tokens are never dropped by it. Only
lines of ``min_open`` tokens or more are generalised, so short common phrases stay.

Records inside lines: the tree also takes stretches of ``stretch`` tokens, wherever lines begin and end. Of every
``spread`` stretches in a row the one with the least hash is a record (the left one of equals), so the
choice depends on the words alone, and two texts that share ``stretch + spread - 1`` tokens in a row (50)
share a record. A record, or a line of ``long_tokens`` or more, that two distinct texts have is a
passage: it is dropped from every text but that of the first document that has it. What is left shares no
50 tokens in a row with an earlier document, but for the next rule. (Copies of a whole document are one
text, and copies of the first document's text keep its passages.)

Near copies: if two passages or more together make up over half of a text's remaining tokens, the text is
a copy as a whole and keeps its passages; finding such texts is the near-dedup's work, and shreds of them would
hide them from it.

The first document is the one with the least (id, text hash), null ids last, so it is one document even
where ids are null or repeat; rows equal in id and text are alike.

Scale: the texts are read twice and no key is stored. Once for counts by 64-bit key with partial
aggregation: a line that stands in a third of all documents is one key with one count per task. Once
for the rows of recurring keys, which give each document its places (sets, so repeated rows add nothing).
The texts are shuffled once to meet them. No group of equal lines or of one leaf is gathered.

Edge cases: null text stays null and has no lines; blank lines stay; a document whose lines all go
has the empty text. Rows that repeat count as documents of their own and are treated alike. Empty
tables give empty results. Other columns are carried whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import staged, text_slices, texts_of


@dataclass(frozen=True)
class Tree:
    depth: int = 3
    min_tokens: int = 5
    min_open: int = 12
    min_docs: int = 6
    min_constant: int = 3  # tokens without a digit that a template with variable fields needs, and half of all
    long_tokens: int = 50  # lines of so many tokens are passages
    stretch: int = 25      # tokens of a record inside lines
    spread: int = 26       # of so many of them in a row one is taken


TREE = Tree()
_LAST = (1 << 63) - 1  # stands for a null id in comparisons
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_FIELD = np.uint64(xxh3_64_intdigest(b"<*>"))  # what a variable field is to a template
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_SLICE = 1 << 19  # text bytes handled at once: about twenty arrays of eight bytes a token
LINE, LONG, RECORD = 0, 1, 2  # what a key is: a template, the own template of a long line, a stretch
_OWN, _AS_IS, _OPEN, _STRETCH = 1, 2, 3, 6  # keeps the kinds of keys apart; the three open thirds are 3, 4 and 5


def _key(total: np.ndarray, n: np.ndarray | int, salt: int) -> np.ndarray:
    key = total + np.asarray(n).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(salt * 0x9FB21C651E98DF25 % (1 << 64))
    key = (key ^ (key >> np.uint64(32))) * _MIX
    return key ^ (key >> np.uint64(29))


def _tokens(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each token, and first byte of each line."""
    data = np.frombuffer(text, np.uint8)
    solid = ~_BLANK[data]
    return (np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]])),
            np.concatenate([[0], np.flatnonzero(data == 10) + 1]).astype(np.int64))


class Hashes:
    """Hash of any stretch of tokens from running totals: the sum of token hash times base ^ place. The base is odd, so
    its powers have inverses and the place can be counted from the beginning of the stretch."""

    def __init__(self, tokens: np.ndarray):
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
            tokens * np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(len(tokens) - 1, 0), _BASE, np.uint64))])[:len(tokens)],
            dtype=np.uint64)])
        self.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(tokens), pow(_BASE, -1, 1 << 64), np.uint64))])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.total[b] - self.total[a]


def chosen(key: np.ndarray, end: np.ndarray, p: Tree) -> np.ndarray:
    """Stretches that are records: the least of any ``spread`` in a row in one text, the left one of equals. ``end``: the
    token after the text of the token where a stretch begins."""
    bits = 22  # the place beside the hash; more tokens than this are no more than a slice has, but for one longer text
    low = np.uint64((1 << bits) - 1)
    least = (key & ~low) | (np.arange(len(key)).astype(np.uint64) & low)
    have = 1
    while have < p.spread:  # minimum of 1, 2, 4, ... and then of spread
        step = min(have, p.spread - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = np.arange(len(least))
    at = at[at + p.spread + p.stretch - 1 <= end[:len(least)]]
    return np.unique(at + ((least[at] - at.astype(np.uint64)) & low).astype(np.int64))


def keys_of(texts: list[bytes], p: Tree = TREE) -> tuple[np.ndarray, ...]:
    """Text number, key, kind and place (line number, or first token of a RECORD) of every key of every line and stretch.

    All tokens of the texts are handled at once as arrays."""
    text = b"\n".join(texts)
    tokens = text.split()
    raw = np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    start, line = _tokens(text)
    text_start = np.cumsum([0, *[len(t) + 1 for t in texts]])
    field = np.zeros(len(raw), bool)
    if len(raw):
        field = np.logical_or.reduceat(_DIGIT[np.frombuffer(text, np.uint8)], start)
    as_is, masked = Hashes(raw), Hashes(np.where(field, _FIELD, raw))
    fields = np.concatenate([[0], np.cumsum(field)])

    first = np.searchsorted(start, line)                                    # tokens before each line
    n = np.diff(np.append(first, len(raw)))
    of_line = np.searchsorted(text_start, line, side="right") - 1
    first_line = np.searchsorted(line, text_start[:-1])
    use = np.flatnonzero(n >= p.min_tokens)
    lo, n, hi = first[use], n[use], first[use] + n[use]

    def data(kept: np.ndarray, variable: np.ndarray) -> np.ndarray:
        """Whether a template has fields and too few other tokens."""
        return (fields[hi] > fields[lo]) & ((kept - variable < p.min_constant) | (2 * (kept - variable) < kept))

    rows = data(n, fields[hi] - fields[lo])
    own = np.where(rows, _key(as_is.between(lo, hi) * as_is.down[lo], n, _AS_IS), _key(masked.between(lo, hi) * masked.down[lo], n, _OWN))
    out = [(use, own, np.where(n >= p.long_tokens, LONG, LINE))]
    rest = np.maximum(n - p.depth, 0)
    cuts = [np.minimum(lo + p.depth + x, hi) for x in (0, rest // 3, 2 * rest // 3, rest)]
    for k in range(3):
        a, b = cuts[k], cuts[k + 1]
        take = (n >= p.min_open) & ~rows & ~data(n - (b - a), fields[hi] - fields[lo] - fields[b] + fields[a])
        key = _key((masked.between(lo, a) + masked.between(b, hi)) * masked.down[lo], n, _OPEN + k)
        out.append((use[take], key[take], np.full(take.sum(), LINE)))
    at = np.concatenate([x[0] for x in out])
    row, key, kind, place = of_line[at], np.concatenate([x[1] for x in out]), np.concatenate([x[2] for x in out]), at - first_line[of_line[at]]

    many = len(raw) - p.stretch + 1
    if many >= p.spread:
        begin = np.arange(many)
        stretch = _key(as_is.between(begin, begin + p.stretch) * as_is.down[:many], p.stretch, _STRETCH)
        text_first = np.append(np.searchsorted(start, text_start[:-1]), len(raw))
        of = np.repeat(np.arange(len(texts)), np.diff(text_first))[:many]
        at = chosen(stretch, text_first[of + 1], p)
        row, key = np.concatenate([row, of[at]]), np.concatenate([key, stretch[at]])
        kind = np.concatenate([kind, np.full(len(at), RECORD)])
        place = np.concatenate([place, at - text_first[of[at]]])
    return row, key, kind, place


def keyed(docs: DataFrame, p: Tree = TREE) -> DataFrame:
    """``docs(doc_id, text)`` -> key, kind, doc_id, text_key, places: one row per document and key; places: line
    numbers, or first tokens of a RECORD."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, max_bytes=_SLICE):
            row, key, kind, place = keys_of(texts_of(b.column("text")), p)
            order = np.lexsort((place, key, row))
            row, key, kind, place = row[order], key[order], kind[order], place[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            begin = np.flatnonzero(new)
            of = pa.array(row[begin], pa.int64())
            places = pa.ListArray.from_arrays(pa.array(np.append(begin, len(row)), pa.int32()), pa.array(place, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[begin].view(np.int64)), pa.array(kind[begin], pa.int8()), b.column("doc_id").take(of),
                 b.column("text_key").take(of), places], names=["key", "kind", "doc_id", "text_key", "places"])

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return d.mapInArrow(rows, "key bigint, kind tinyint, doc_id bigint, text_key bigint, places array<int>")


def recurring_places(docs: DataFrame, p: Tree = TREE) -> DataFrame:
    """doc_id, text_key, hits (kind, places) of documents with recurring keys that an earlier one has; kind LINE: the
    lines go, LONG and RECORD: passages."""
    made = keyed(docs, p)
    order = F.coalesce("doc_id", F.lit(_LAST))
    counts = made.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(order, "text_key")).alias("first"), F.max("kind").alias("kind"),
                                     F.min("text_key").alias("a"), F.max("text_key").alias("b"))
    often = (F.col("n") >= p.min_docs) & (F.col("kind") != RECORD)
    passage = (F.col("kind") != LINE) & (F.col("a") < F.col("b"))
    recurring = staged(counts.where(often | passage).select(
        F.col("key").alias("_key"), F.col("first.col1").alias("_id"), F.col("first.text_key").alias("_text"),
        F.when(often, LINE).otherwise(F.col("kind")).cast("int").alias("_kind")), "line-recurring")
    other = (F.col("text_key") != F.col("_text")) | ((F.col("_kind") == LINE) & (order != F.col("_id")))
    hits = made.join(recurring, F.col("key") == F.col("_key")).where(other)
    # one row per document and key: at most as many as the document has keys
    return hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(F.col("_kind").alias("kind"), "places")).alias("hits"))


def without(text: bytes, hits: list[dict], p: Tree = TREE) -> tuple[bytes, list[int], list[int]]:
    """What is left of a text, the numbers of its dropped lines, and first and end token of each dropped passage."""
    lines = text.split(b"\n")
    gone = {n for h in hits if h["kind"] == LINE for n in h["places"]}
    if all(h["kind"] == LINE for h in hits):
        return b"\n".join(x for n, x in enumerate(lines) if n not in gone), sorted(gone), []
    long = {n for h in hits if h["kind"] == LONG for n in h["places"]} - gone
    start, line = _tokens(text)
    first = np.append(np.searchsorted(start, line), len(start))
    covered, out = np.zeros(len(start), bool), np.zeros(len(start), bool)
    for h in hits:
        if h["kind"] == RECORD:
            for at in h["places"]:
                covered[at:at + p.stretch] = True
    for n in long:
        covered[first[n]:first[n + 1]] = True
    for n in gone:
        out[first[n]:first[n + 1]] = True
    covered &= ~out
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]]))).reshape(-1, 2)
    if len(edge) > 1 and 2 * covered.sum() > len(start) - out.sum():
        return b"\n".join(x for n, x in enumerate(lines) if n not in gone), sorted(gone), []
    touched = np.searchsorted(first, np.flatnonzero(covered), side="right") - 1
    # a line goes as a whole if its template recurs or passages take all its tokens
    taken = np.bincount(touched, minlength=len(lines))
    drop = gone | set(np.flatnonzero((taken > 0) & (taken == np.diff(first))).tolist())
    for n in set(touched.tolist()) - drop:
        a, b, begin, stop = int(first[n]), int(first[n + 1]), int(line[n]), int(line[n]) + len(lines[n])
        after = [*start[a + 1:b].tolist(), stop]  # a token goes with the blanks after it
        at, left = begin, []
        for k in np.flatnonzero(covered[a:b]).tolist():
            left.append(text[at:int(start[a + k])])
            at = after[k]
        lines[n] = b"".join([*left, text[at:stop]])
    return b"\n".join(x for n, x in enumerate(lines) if n not in drop), sorted(drop), edge.ravel().tolist()


def without_templates(docs: DataFrame, p: Tree = TREE) -> DataFrame:
    """``docs`` -> ``row`` (all columns as a struct), dropped (line numbers, null if nothing goes), passages (first and
    end token of each one that goes), text (what is left)."""
    gone = recurring_places(docs, p).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "hits")
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.join(gone, F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("_key")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            dropped: list = [None] * b.num_rows
            passages: list = [None] * b.num_rows
            with_hits = pc.indices_nonzero(b.column("hits").is_valid())
            left = {}
            some = b.select(["text", "hits"]).take(with_hits)
            for i, text, hits in zip(with_hits.to_pylist(), texts_of(some.column("text")), some.column("hits").to_pylist()):
                rest, lines, edges = without(text, hits, p)
                if lines or edges:
                    left[i], dropped[i], passages[i] = rest, lines, edges
            texts = b.column("text")
            if left:
                changed = np.zeros(b.num_rows, bool)
                changed[list(left)] = True
                texts = pc.replace_with_mask(texts, pa.array(changed), pa.array(list(left.values()), pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(dropped, pa.list_(pa.int32())), pa.array(passages, pa.list_(pa.int32())), texts], names=["row", "dropped", "passages", "text"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.select("row", F.col("row.text").alias("text"), "hits").mapInArrow(
        cut, f"row {kind}, dropped array<int>, passages array<int>, text string")


def drop_templates(docs: DataFrame, p: Tree = TREE) -> DataFrame:
    """The documents without their recurring lines; n_chars, if there, follows the text."""
    out = without_templates(docs, p)
    columns = [F.col("text") if c == "text" else
               F.when(F.col("dropped").isNull(), F.col("row.n_chars")).otherwise(F.length("text")).cast(docs.schema[c].dataType)
               .alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return out.select(*columns)
