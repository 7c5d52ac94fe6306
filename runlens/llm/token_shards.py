"""Token-ID / binary output (operator 5): best-fit-decreasing packing into binary shards.

Each task encodes its documents and gathers pieces up to ``group_tokens``; a group is packed
best-fit-decreasing and becomes one shard, so ids are never shuffled and a task holds one group
at a time. The bin for a piece is the one with the least room that still takes it: a segment tree
over the rooms 0 to ``seq_len`` counts the open bins and finds the least room at or above the
piece's length in log(seq_len) steps. Documents longer than a sequence are cut into full pieces
and a last shorter one; nothing is dropped.

A shard is one row of a Parquet table that Spark commits whole or not at all, on any store:

* ids: the id matrix, rows of ``seq_len``, little-endian, 16 bits where the vocabulary allows, else
  32; places after a row's last segment hold ``pad_id``;
* segments: int32, the number of segments of each row;
* cu_seqlens: int32, for each row 0 and the ends of its segments (one number more than segments);
* resets: int32, for each row the places where positions begin again at 0 (its segments' starts);
* doc_ids, pieces, starts: for each segment its document, its number there and the ids before it.

Edge cases: null or empty text is the end id alone; null ids are kept (``has_id`` in the validity of
doc_ids); very long texts become many pieces, spread over groups; rows that repeat are packed
like any others; an empty table gives no shards. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_slices, texts_of
from .encoding import encoder, word_tokenizer


@dataclass(frozen=True)
class Shards:
    seq_len: int = 4096
    end_id: int = 1
    pad_id: int = 0
    id_bytes: int = 2             # 2 for vocabularies of up to 65,536 ids
    group_tokens: int = 4 << 20
    tokenizer: str | None = None


SHARDS = Shards()


class Rooms:
    """Counts of open bins by room, as a segment tree: the least room at or above a size."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.tree = [0] * (2 * self.base)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def _count(self, room: int, step: int) -> None:
        at = room + self.base
        while at:
            self.tree[at] += step
            at >>= 1

    def put(self, room: int, which: int) -> None:
        self.bins[room].append(which)
        self._count(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, bin) of the least room >= size, taken out; none if there is no such bin."""
        at, tree = size + self.base, self.tree
        while not tree[at]:                    # up to the first subtree on the right that has a bin
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
            if at & (at - 1) == 0:             # past the right end of a level
                return None
        while at < self.base:                  # down to its leftmost one
            at = 2 * at if tree[2 * at] else 2 * at + 1
        room = at - self.base
        self._count(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(sizes: list[int], most: int) -> list[list[int]]:
    """Bins of indexes into ``sizes``, each of at most ``most`` together."""
    rooms, out = Rooms(most), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        got = rooms.take(sizes[i])
        if got is None:
            got = most, len(out)
            out.append([])
        room, which = got
        out[which].append(i)
        rooms.put(room - sizes[i], which)
    return out


SHARD = ("shard string, n_rows int, ids binary, segments binary, cu_seqlens binary, resets binary, "
         "doc_ids array<bigint>, pieces array<int>, starts array<bigint>")


def write(docs: DataFrame, p: Shards = SHARDS) -> DataFrame:
    """``docs(doc_id, text)`` -> the written table of shards (SHARD)."""
    path = p.tokenizer or word_tokenizer()
    dtype = "<u2" if p.id_bytes == 2 else "<u4"

    def shard(name: str, held: list[tuple]) -> pa.RecordBatch:
        rows = best_fit_decreasing([len(x[3]) // 4 for x in held], p.seq_len)
        ids = np.full((len(rows), p.seq_len), p.pad_id, dtype)
        order, ends, resets = [], [], []
        for r, row in enumerate(rows):
            at = 0
            ends.append(0)
            for i in row:
                x = np.frombuffer(held[i][3], "<u4")
                ids[r, at:at + len(x)] = x
                resets.append(at)
                at += len(x)
                ends.append(at)
            order += row
        as_bytes = lambda x: pa.array([np.array(x, "<i4").tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([len(rows)], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
             as_bytes([len(r) for r in rows]), as_bytes(ends), as_bytes(resets),
             pa.array([[held[i][0] for i in order]], pa.list_(pa.int64())), pa.array([[held[i][1] for i in order]], pa.list_(pa.int32())),
             pa.array([[held[i][2] for i in order]], pa.list_(pa.int64()))], names=[x.split()[0] for x in SHARD.split(", ")])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.uint32(p.end_id).tobytes()
        task, made, held, size, step = TaskContext.get().partitionId(), 0, [], 0, 4 * p.seq_len
        for b in text_slices(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts_of(b.column("text"))):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    held.append((doc_id, k, at // 4, ids[at:at + step]))
                    size += len(held[-1][3]) // 4
                    if size >= p.group_tokens:
                        yield shard(f"{task:06d}-{made:06d}", held)
                        made, held, size = made + 1, [], 0
        if held:
            yield shard(f"{task:06d}-{made:06d}", held)

    return staged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(groups, SHARD), "token-shards")


SEGMENT = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, shard string, row int, offset bigint")


def segments(shards: DataFrame, p: Shards = SHARDS) -> DataFrame:
    """What the shards hold, read back from their binary columns: one row per segment (SEGMENT;
    ids_crc32 over little-endian unsigned 32-bit ids)."""
    dtype = "<u2" if p.id_bytes == 2 else "<u4"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                ids = np.frombuffer(x["ids"], dtype).reshape(x["n_rows"], p.seq_len)
                per_row, cu = np.frombuffer(x["segments"], "<i4"), np.frombuffer(x["cu_seqlens"], "<i4")
                row = np.repeat(np.arange(x["n_rows"], dtype=np.int32), per_row)
                first = np.arange(len(row)) + row          # each row has one number more than segments
                lo, hi = cu[first].astype(np.int64), cu[first + 1].astype(np.int64)
                crc = [zlib.crc32(ids[r, s:e].astype("<u4").tobytes()) for r, s, e in zip(row, lo, hi)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["doc_ids"], pa.int64()), pa.array(x["pieces"], pa.int32()), pa.array(x["starts"], pa.int64()),
                     pa.array(hi - lo), pa.array(crc, pa.int64()), pa.array([x["shard"]] * len(row)), pa.array(row), pa.array(lo)],
                    names=[y.split()[0] for y in SEGMENT.split(", ")])

    return shards.select("shard", "n_rows", "ids", "segments", "cu_seqlens", "doc_ids", "pieces", "starts").mapInArrow(read, SEGMENT)


def position_ids(segments_of_row: np.ndarray, seq_len: int) -> np.ndarray:
    """Positions of one row from its resets: each place's distance from the last reset."""
    last = np.zeros(seq_len, np.int64)
    last[segments_of_row] = segments_of_row
    return np.arange(seq_len) - np.maximum.accumulate(last)
