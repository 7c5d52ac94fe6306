"""SimHash near-dedup (operator 12): segment-popcount embedding, grid range join, exact check.

A text's fingerprint has bit j set if more than half of its word shingles' XXH64 hashes have it. Texts
whose fingerprints differ in at most ``within`` = 3 bits are linked, and a component is all that links
reach.

Embedding: each segment of two bits is mapped to the number of its set bits (0 to 2). Fingerprints that
differ in d bits have embeddings whose Manhattan distance is at most d, so the distance is a lower
bound. Of the two halves of a pair (16 segments each) one differs in at most one bit, so there the
embeddings are equal or one step apart. That is a range join of radius 1 on an integer grid: grid points
whose coordinates have an even sum are cells. An even embedding lies in its own cell; an odd one enters
the (16 to 32) cells one step away, and its own point for those equal to it. A cell compares the embeddings
that lie in it with one another and with those that entered; what is met there is verified exactly by the
bits that differ, inside the join, so a join's rows are links and not candidates.

Crowds: a family of near copies may fill a cell. Where a cell holds more than ``crowd`` fingerprints, these
are first grouped by common centres, i.e. the fingerprints one bit away and themselves: all that share a
centre differ in at most two bits and are linked to the least of them, a star instead of all pairs. Cells
whose members then are one group are done, and in the others the grid join leaves out pairs of one group. So no link
that joins two components is lost and none is capped. Equal fingerprints are one node from the start.

Scale: fingerprints are shuffled as (cell, fingerprint) pairs of longs, about 26 a distinct fingerprint,
texts are not shuffled at all. Cells stay small until there are about 10^8 distinct fingerprints; beyond
that, random cell mates grow with the square and the half's 2-bit segments should be 1-bit ones.
The components are found by label rounds over written tables, never at the driver.

Edge cases: only A-Z are lowered; words are runs of characters other than ASCII blanks. A text of one or two
words has one shingle, its whole sequence; null, empty and blank texts have fingerprint zero, which is
linked like any other. A component is named by its least doc_id; null ids come last, so one whose ids
are all null has the name null (``label`` tells such components apart). Rows that repeat stay, each with its
component. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import staged, text_slices, texts_of
from .components import components


@dataclass(frozen=True)
class Fingerprinting:
    shingle: int = 3   # words
    seed: int = 42
    crowd: int = 16    # fingerprints that lie in one cell before they are grouped by centres first


FINGERPRINTING = Fingerprinting()
WITHIN = 3             # differing bits of a link; the grid below is made for it
_CHUNK = 1 << 16       # shingles whose bits are counted at once
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LOW_OF_EACH = 0x55555555
_HALF = 0xFFFFFFFF
_SEGMENTS = 16         # of a half, two bits each


def fingerprint(text: bytes, p: Fingerprinting = FINGERPRINTING) -> int:
    """SimHash of a text as an unsigned 64-bit number."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - p.shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        some = words[at:at + min(_CHUNK, n - at) + p.shingle - 1]
        shingles = map(b" ".join, zip(*(some[i:] for i in range(p.shingle)))) if len(words) >= p.shingle else [b" ".join(words)]
        h = np.fromiter(map(xxh64_intdigest, shingles, repeat(p.seed)), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, p: Fingerprinting = FINGERPRINTING) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, fp (the fingerprint's 64 bits as a long)."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            fps = np.array([fingerprint(t, p) for t in texts_of(b.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(make, "doc_id bigint, fp bigint")


def _points(fp: Column, half: int) -> Column:
    """(cell, home) of the cells that one half of a fingerprint lies in or enters."""
    bits = F.shiftrightunsigned(fp, 32) if half else fp.bitwiseAND(F.lit(_HALF))
    at = bits.bitwiseAND(F.lit(_LOW_OF_EACH)) + F.shiftright(bits, 1).bitwiseAND(F.lit(_LOW_OF_EACH))
    cell = lambda point, home: F.struct((point + F.lit(half << 33)).alias("cell"), F.lit(home).alias("home"))
    steps = []
    for i in range(_SEGMENTS):
        count = F.shiftrightunsigned(at, 2 * i).bitwiseAND(F.lit(3))
        steps += [F.when(count < 2, cell(at + F.lit(1 << 2 * i), False)), F.when(count > 0, cell(at - F.lit(1 << 2 * i), False))]
    odd = F.bit_count(bits) % 2 == 1
    return F.when(odd, F.array(cell(at, True), *steps)).otherwise(F.array(cell(at, True)))


def grid(nodes: DataFrame) -> DataFrame:
    """``nodes(fp)`` -> cell, fp, home: whether it lies in the cell or entered it from one step away."""
    points = F.array_compact(F.concat(_points(F.col("fp"), 0), _points(F.col("fp"), 1)))
    return nodes.select("fp", F.explode(points).alias("at")).select("at.cell", "fp", "at.home")


def stars(nodes: DataFrame) -> DataFrame:
    """``nodes(fp)`` -> a, b: links of fingerprints that share a centre at most one bit away to the least of them."""
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(int(x))) for x in (np.uint64(1) << np.arange(64, dtype=np.uint64)).view(np.int64)])
    near = nodes.select("fp", F.explode(flips).alias("centre"))
    least = near.groupBy("centre").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    return near.join(least, "centre").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()


def links(nodes: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``nodes(fp)`` -> a, b: all pairs at most ``WITHIN`` bits apart; with ``labels(node, label)``, those
    whose labels differ, as links between the labels (a fingerprint without one is its own)."""
    cells = grid(nodes)
    if labels is not None:
        cells = cells.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        # a cell in which all have one label has nothing to say
        mixed = cells.groupBy("cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("cell")
        cells = staged(cells, "simhash-cells").join(mixed, "cell", "left_semi")
    else:
        cells = cells.withColumn("label", F.col("fp"))
    home = cells.where("home").select("cell", F.col("fp").alias("fp_a"), F.col("label").alias("a"))
    other = cells.select("cell", F.col("fp").alias("fp_b"), F.col("label").alias("b"), "home")
    near = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= WITHIN
    once = ~F.col("home") | (F.col("fp_a") < F.col("fp_b"))
    pairs = home.join(other, (home["cell"] == other["cell"]) & (F.col("a") != F.col("b")) & once & near)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def crowded(nodes: DataFrame, p: Fingerprinting) -> DataFrame:
    """Fingerprints that lie in a cell with more than ``crowd`` others."""
    home = nodes.select("fp", F.explode(F.array(*[_points(F.col("fp"), h)[0]["cell"] for h in (0, 1)])).alias("cell"))
    full = home.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > p.crowd).select("cell")
    return home.join(full, "cell", "left_semi").select("fp").distinct()


def near_components(docs: DataFrame, p: Fingerprinting = FINGERPRINTING) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, fp, label (the component, one of its fingerprints), component_id (the
    least doc_id of the component)."""
    marked = staged(fingerprints(docs, p), "simhash-fingerprints")
    nodes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    crowd = staged(crowded(nodes.select("fp"), p), "simhash-crowd")
    groups = None if crowd.isEmpty() else components(stars(crowd))
    joined = components(links(nodes.select("fp"), groups))
    named = nodes.withColumn("group", F.col("fp"))
    if groups is not None:
        named = named.drop("group").join(groups.select(F.col("node").alias("fp"), F.col("label").alias("group")), "fp", "left")
        named = named.withColumn("group", F.coalesce("group", "fp"))
    named = named.join(joined.select(F.col("node").alias("group"), "label"), "group", "left")
    named = named.select("fp", "least", F.coalesce("label", "group").alias("label"))
    name = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = staged(named.join(name, "label").select("fp", "label", "component_id"), "simhash-labels")
    return marked.join(named, "fp").select("doc_id", "fp", "label", "component_id")
