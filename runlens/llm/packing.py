"""Best-fit packing (operator 3): a configuration linear program over the length histogram.

Documents become token ids, ended by one end id; only those longer than a sequence are cut, into
pieces of a full sequence and a last shorter one. How to fill the sequences depends on the
histogram of piece lengths alone, at most ``seq_len`` numbers, whatever the corpus:

* The program: choose how often each configuration (a multiset of lengths of at most ``seq_len``
  together) is used so that every length is covered and the number of sequences is least. Its
  dual gives each length a price.
* Multiplicative weights: a length's price starts as its share of a sequence and is multiplied up
  as the length falls behind the others in being covered. Each round prices all configurations
  at once with a knapsack dynamic program over the capacities 0 to ``seq_len`` and reads several
  best ones off its table, each used as often as it may before the prices are stale.
* Rounding: configurations are only used whole and never beyond what is left, so nothing is
  covered twice; where a configuration wants a length that is used up, its room stays open. What
  remains is packed best-fit-decreasing into the open rooms and new sequences, on the histogram
  too (sequences of equal room are one entry with a count). Every round of prices is a place to
  stop; the plan is rounded from the last one that gives the fewest sequences.

The plan is a table of (length, first number, count, ...) runs: piece number k of its length
belongs to one run, and gets its sequence and place by arithmetic. Pieces are numbered within
(length, input task) when they are made and staged, and a small prefix sum over the tasks makes
the numbers run through; no group of equal lengths meets in one task, and texts and ids are
never shuffled. Only the histogram (<= ``seq_len`` rows) reaches the driver; the plan goes back
as a broadcast whose size depends on ``seq_len`` and the number of rounds.

Edge cases: null or empty text is the end id alone; an empty table gives an empty result; rows
that repeat are packed like any others; very long texts give many pieces. Other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import staged, text_slices, texts_of
from .encoding import encoder, word_tokenizer


@dataclass(frozen=True)
class Packing:
    seq_len: int = 4096
    end_id: int = 1
    tokenizer: str | None = None  # path of a vocabulary file; the word tokenizer if none
    rounds: int = 200             # pricings at most
    per_round: int = 400          # configurations read off each table at most
    step: float = 0.1             # share of the remaining words covered at one set of prices
    rest: float = 0.03            # share of the pieces left to rounding
    rate: float = 0.02            # of the multiplicative update
    level: float = 0.02           # prices are rounded to powers of 1 + level, nearly
    tries: int = 40               # dead ends in a row before the prices are renewed
    open_room: float = 0.02       # of a sequence that a configuration may leave to rounding


PACKING = Packing()
PIECES = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, number bigint")


def pieces(docs: DataFrame, p: Packing = PACKING, with_ids: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per piece, numbered within (length, task); ``with_ids``
    adds the ids (little-endian 32-bit)."""
    path = p.tokenizer or word_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.uint32(p.end_id).tobytes()
        task, seen, step = TaskContext.get().partitionId(), np.zeros(p.seq_len + 1, np.int64), 4 * p.seq_len
        for b in text_slices(batches):
            of, piece, length, crc, number, ids = [], [], [], [], [], []
            for row, text in enumerate(texts_of(b.column("text"))):
                all_ids = encode(text) + end
                for k, at in enumerate(range(0, len(all_ids), step)):
                    part = all_ids[at:at + step]
                    n = len(part) // 4
                    of.append(row)
                    piece.append(k)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    number.append(seen[n])
                    seen[n] += 1
                    if with_ids:
                        ids.append(part)
            k = np.array(piece, np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(of)), pa.array(k), pa.array(k.astype(np.int64) * p.seq_len),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(k), task, np.int32)),
                 pa.array(number, pa.int64()), *([pa.array(ids, pa.binary())] if with_ids else [])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "number", *["ids"] * with_ids])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        cut, PIECES + ", ids binary" * with_ids)


def _best_fit(left: dict[int, int], seq_len: int,
              begun: list[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best-fit-decreasing on a histogram, into the room of the configurations ``begun`` and into new
    sequences: configurations with how often each is used."""
    rooms: list[int] = []                      # rooms of open bins, ascending, each once
    bins: dict[int, list[list]] = {}           # room -> [[configuration, count]]

    def put(room: int, config: dict[int, int], count: int) -> None:
        if room not in bins:
            bins[room] = []
            bisect.insort(rooms, room)
        bins[room].append([config, count])

    for config, count in begun:
        put(seq_len - sum(size * each for size, each in config.items()), config, count)
    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):               # open new bins, each with as many of this size as fit
                many = seq_len // size
                for each, count in ((many, n // many), (n % many, 1)):
                    if each and count:
                        put(seq_len - each * size, {size: each}, count)
                break
            room = rooms[at]
            entry = bins[room][-1]
            config, count = entry
            each = min(room // size, n)        # into one bin as many as fit
            used = min(count, n // each)
            if used == count:
                bins[room].pop()
            else:
                entry[1] -= used
            if not bins[room]:
                del bins[room]
                rooms.pop(at)
            put(room - each * size, config | {size: config.get(size, 0) + each}, used)
            n -= used * each
    return [(c, n) for group in bins.values() for c, n in group]


def _price(sizes: np.ndarray, value: np.ndarray, seq_len: int) -> list[np.ndarray]:
    """Knapsack over all capacities: the lengths with which each one's best value is reached (none:
    as good as one less)."""
    best = np.zeros(seq_len + 1)
    upto = np.searchsorted(sizes, np.arange(seq_len + 1), side="right")
    near: list[np.ndarray] = [np.empty(0, np.int64)] * (seq_len + 1)
    for c in range(1, seq_len + 1):
        k = upto[c]
        if k:
            v = best[c - sizes[:k]] + value[:k]
            top = v.max()
            if top >= best[c - 1]:
                best[c] = top
                near[c] = np.flatnonzero(v >= top - 1e-9)
                continue
        best[c] = best[c - 1]
    return near


def plan(histogram: dict[int, int], p: Packing = PACKING) -> list[tuple[dict[int, int], int]]:
    """Configurations (length -> how many) and how often each is used; covers the histogram exactly."""
    sizes = np.array(sorted(histogram), np.int64)
    total = np.array([histogram[int(s)] for s in sizes], np.int64)
    left, out, L = total.copy(), [], p.seq_len
    if len(sizes) and sizes[-1] == L:          # full pieces fill their sequences
        out.append(({L: 1}, int(left[-1])))
        left[-1] = 0
    price = np.ones(len(sizes))                # multiplier of each length
    rng = np.random.default_rng(0)
    stops = [(len(out), left.copy())]
    for _ in range(p.rounds):
        live = np.flatnonzero(left)
        if left.sum() <= p.rest * total.sum():
            break
        s = sizes[live]
        level = np.exp(p.level * np.round(np.log(price[live]) / p.level))  # equal prices leave a choice
        near = _price(s, s / L * level, L)
        spread, goal = np.zeros(len(live), np.int64), p.step * (left[live] * s).sum()
        found = dead = 0
        while found < p.per_round and dead < p.tries and (spread * s).sum() < goal:
            take, c = np.zeros(len(live), np.int64), L
            room = left[live] - spread
            while c > 0:
                if len(near[c]):
                    fit = near[c][room[near[c]] > take[near[c]]]
                    if not len(fit):
                        break                  # what the table wants is used up
                    # of equal prices the longest, as short ones fit anywhere; after a dead end any
                    i = fit[-1] if not dead else rng.choice(fit)
                    take[i] += 1
                    c -= s[i]
                else:
                    c -= 1
            used = np.flatnonzero(take)
            if c > p.open_room * L:            # a dead end: read another
                dead += 1
                continue
            dead = 0
            often = (room[used] // take[used]).min()
            often = int(max(1, min(often, goal / 8 // (take * s).sum())))
            spread += take * often
            out.append(({int(s[i]): int(take[i]) for i in used}, often))
            found += 1
        left[live] -= spread
        behind = left[live] / total[live]
        price[live] *= np.exp(p.rate * (behind - behind.mean()))  # the multiplicative update
        price[live] /= price[live].mean()
        if not found:
            break
        stops.append((len(out), left.copy()))
    # round at the last stop that needs the fewest sequences
    bound, kept, fewest = -(-int((total * sizes).sum()) // L), [], None
    for n, left in reversed(stops):
        rounded = _best_fit({int(sizes[i]): int(left[i]) for i in np.flatnonzero(left)}, L, out[:n])
        used = sum(count for _, count in rounded)
        if fewest is None or used < fewest:
            kept, fewest = rounded, used
        if fewest == bound:
            break
    return kept


def runs(configs: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The plan as runs of piece numbers: of a length, from ``lo`` on, ``each`` to a sequence, from
    sequence ``base`` on, at ``place``. Sorted by (length, lo)."""
    rows, given, base = [], {}, 0
    for config, count in configs:
        place = 0
        for size in sorted(config, reverse=True):
            each = config[size]
            lo = given.get(size, 0)
            rows.append((size, lo, each, base, place))
            given[size] = lo + each * count
            place += size * each
        base += count
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "lo", "each", "base", "place"), a.T))


def pack(docs: DataFrame, p: Packing = PACKING, with_ids: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` -> per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset (and ids)."""
    spark = docs.sparkSession
    made = staged(pieces(docs, p, with_ids), "packing-pieces")
    counts = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = staged(counts, "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = runs(plan(histogram, p))
    first = np.searchsorted(table["length"], np.arange(p.seq_len + 2))  # where each length's runs begin
    sent = spark.sparkContext.broadcast((table, first))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(F.col("length").alias("_length"), F.col("task").alias("_task"),
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = made.join(base, (F.col("length") == F.col("_length")) & (F.col("task") == F.col("_task")))
    rows = rows.withColumn("k", F.col("number") + F.col("before")).drop("_length", "_task", "before", "number", "task")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, begin = sent.value
        for b in batches:
            n, k = b.column("length").to_numpy(), b.column("k").to_numpy()
            run = np.empty(len(n), np.int64)
            for size in np.unique(n):
                at = n == size
                lo, hi = begin[size], begin[size + 1]
                run[at] = lo + np.searchsorted(t["lo"][lo:hi], k[at], side="right") - 1
            turn = k - t["lo"][run]
            keep = [b.column(c) for c in b.schema.names if c != "k"]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(t["base"][run] + turn // t["each"][run]),
                 pa.array(t["place"][run] + turn % t["each"][run] * n)],
                names=[*[c for c in b.schema.names if c != "k"], "sequence_id", "offset"])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return rows.select(*[x.split()[0] for x in schema.split(", ")], "k").mapInArrow(
        place, schema + ", sequence_id bigint, offset bigint")
