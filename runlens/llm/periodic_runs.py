"""Periodic run detection (operator 13): suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at
least ``copies * q`` and ``least`` words, that neither neighbouring word extends. The suffix tree of
the reversed prefixes (the automaton's links) is coloured: every node keeps the end of its last
occurrence. Appending word i walks the path from prefix i's node to the root, which consists of a
few segments of one colour each, and recolours it with i. A segment with colour e whose longest
string has s words says that the last s words also end at e: the last s + (i - e) words have the
period i - e. If s is at least ``copies - 1`` periods and the next word breaks the period, that is
a run; s is as long as it can be, so the run's start is maximal, and a smaller period would have given
a nearer colour. The segments are the paths of a link-cut tree (splay trees by depth), so an access costs
O(log n) amortised however deep the tree is.

Before that, words that cannot lie in a run go: with ``copies`` = 4 every word of a run stands in it
four times, so a word found less than four times in its text ends all stretches, and again within each
stretch that remains. That is exact: a neighbour that would extend a run would be part of it.

Edge cases: words are runs of characters other than ASCII blanks; a null or empty text has no word,
no run and the empty collapsed text. A null id stays null. Each row is handled by itself, so rows
that repeat give repeated results; an empty table gives an empty one. A text is handled in one
task, with memory in proportion to its words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, texts_of


@dataclass(frozen=True)
class Periods:
    copies: int = 4   # periods a run holds at least
    least: int = 6    # words a run holds at least


PERIODS = Periods()


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton: longest string and link of each state (0 the root), and the state of each prefix."""
    size, link, step, prefix = [0], [-1], [{}], []
    last = 0
    for c in words:
        new = len(size)
        size.append(size[last] + 1)
        link.append(0)
        step.append({})
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(size)
                size.append(size[p] + 1)
                link.append(link[q])
                step.append(step[q].copy())
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
        prefix.append(new)
    return size, link, prefix


class Paths:
    """Link-cut tree over the automaton's links; the root state stands for "none" and is in no path.

    A preferred path is one splay tree ordered by depth; ``colour`` is kept at its top node.
    """

    def __init__(self, link: list[int]):
        n = len(link)
        self.up = [max(x, 0) for x in link]
        self.left, self.right, self.colour = [0] * n, [0] * n, [-1] * n

    def _splay(self, x: int) -> None:
        up, left, right, colour = self.up, self.left, self.right, self.colour

        def turn(x: int) -> None:
            y = up[x]
            z = up[y]
            if left[y] == x:
                inner = left[y] = right[x]
                right[x] = y
            else:
                inner = right[y] = left[x]
                left[x] = y
            if inner:
                up[inner] = y
            up[y], up[x] = x, z
            if z and left[z] == y:
                left[z] = x
            elif z and right[z] == y:
                right[z] = x
            else:
                colour[x] = colour[y]

        while (y := up[x]) and (left[y] == x or right[y] == x):
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                turn(y if (left[z] == y) == (left[y] == x) else x)
            turn(x)

    def access(self, node: int, new: int) -> list[tuple[int, int]]:
        """Recolour the path from ``node`` to the root; (deepest node, old colour) of each segment on it."""
        up, right, colour = self.up, self.right, self.colour
        segments, below, x = [], 0, node
        while x:
            self._splay(x)
            old = colour[x]
            if old >= 0:
                segments.append((x, old))
            if right[x]:
                colour[right[x]] = old  # the part further down keeps its colour
            right[x] = below
            below, x = x, up[x]
        colour[below] = new
        self._splay(node)
        return segments


def runs_in(words: list[int], p: Periods = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of one stretch of word numbers."""
    size, link, prefix = automaton(words)
    paths, n, out = Paths(link), len(words), []
    for i, node in enumerate(prefix):
        for deepest, end in paths.access(node, i):
            period, same = i - end, size[deepest]
            length = same + period
            if same >= (p.copies - 1) * period and length >= p.least and (i + 1 == n or words[i + 1] != words[i + 1 - period]):
                out.append((i + 1 - length, length, period))
    return out


def stretches(words: np.ndarray, text: np.ndarray, p: Periods = PERIODS) -> tuple[np.ndarray, np.ndarray]:
    """Stretches that may hold runs, of word numbers and the (ascending) text each belongs to:
    places of the first words, and of the words after the last ones."""
    least = p.copies                # a run of period 1 has p.least words, which must not be fewer
    place, of, vocabulary = np.arange(len(words)), text, int(words.max(initial=0)) + 1
    while len(place):
        key = of * vocabulary + words[place]
        order = np.argsort(key)
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        many = np.diff(np.r_[first, len(key)])
        keep = np.empty(len(key), bool)
        keep[order] = np.repeat(many >= least, many)
        before = len(place)
        place, of = place[keep], of[keep]
        if not len(place):
            break
        of = np.cumsum(np.r_[False, (np.diff(place) != 1) | (np.diff(of) != 0)])
        long = np.bincount(of)[of] >= p.least
        place, of = place[long], of[long]
        if len(place) > 0.9 * before:  # what is left may hold runs; the automaton decides
            break
    if not len(place):
        return place, place
    new = np.r_[True, np.diff(of) != 0]
    return place[new], place[np.r_[new[1:], True]] + 1


def find(texts: list[list[bytes]], p: Periods = PERIODS) -> list[list[tuple[int, int, int]]]:
    """Runs of each text (a list of words) by start, then period."""
    if p.least < p.copies:
        raise ValueError("a run of period 1 must have at least `copies` words")
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    many = [len(t) for t in texts]
    words = np.fromiter((number[w] for t in texts for w in t), np.int64, sum(many))
    begins = np.cumsum([0, *many])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, stop in zip(*(x.tolist() for x in stretches(words, np.repeat(np.arange(len(texts)), many), p))):
        at = int(np.searchsorted(begins, start, side="right")) - 1
        shift = start - int(begins[at])
        found[at] += [(s + shift, length, q) for s, length, q in runs_in(words[start:stop].tolist(), p)]
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that a run repeats, i.e. those of a run after its first period."""
    if not runs:
        return words
    drop = bytearray(len(words))
    for start, length, period in runs:
        drop[start + period:start + length] = b"\1" * (length - period)
    return [w for w, d in zip(words, drop) if not d]


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def detect(docs: DataFrame, p: Periods = PERIODS) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, runs (array of start, length, period in words, by start, then
    period), collapsed (the words that no run repeats, joined by one blank)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            texts = [t.split() for t in texts_of(b.column("text"))]
            found = find(texts, p)
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in f] for f in found]
            kept = pa.array([b" ".join(collapsed(t, f)) for t, f in zip(texts, found)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind), kept.cast(pa.string())],
                                             names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, f"doc_id bigint, runs array<{RUN}>, collapsed string")
