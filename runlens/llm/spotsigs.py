"""Document fingerprints (operator 4): SpotSigs.

A signature is an anchor, a common word, with the chain of the next three content words (words
that are not common) after it; a fingerprint is the set of a text's signatures, 64 bits each.
Chains follow function words, so menus and boilerplate give few of them and prose many. Where
more than ``gap`` content words stand without an anchor (other languages, lists), each further
word is its own anchor, so no long stretch goes unseen; the rule is local, so copies keep their
signatures. A text too short for any chain has one signature, of its whole text.

Likeness is the Jaccard index of two fingerprints. ``near_pairs`` finds all pairs above a limit:
equal fingerprints are one class first; class representatives are partitioned by set length
(ranges such that a pair above the limit lies in the same or the next range), and within them
meet on the rarest signatures only (the prefix that a pair above the limit must share), and are
then compared with length pruning. ``with_next`` compares every text with its successor and
with an edited text made of both.

Edge cases: null text is empty; the empty text has the signature of the empty text. Texts are read
whole. Documents that share an id stand in order of their texts' hashes; a document without
an id is its own successor. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_hexdigest

from .common import staged, text_slices, texts_of
from .words import WORDS, folded


@dataclass(frozen=True)
class Spots:
    chain: int = 3
    gap: int = 12
    range_bytes: int = 4 << 20   # text of one range of ids
    max_ranges: int = 100_000    # whose borders the driver keeps


SPOTS = Spots()
_ANCHORS = np.sort(np.array([xxh3_64_intdigest(w) for w in WORDS], np.uint64))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def signatures(text: bytes, p: Spots = SPOTS) -> np.ndarray:
    """The sorted signatures of a text, each once; one at least."""
    words = folded(text)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    anchor = _ANCHORS[np.minimum(np.searchsorted(_ANCHORS, h), len(_ANCHORS) - 1)] == h
    content = np.flatnonzero(~anchor)
    if len(content) > p.chain - 1:
        # place among the content words of the first one after each word
        after = np.cumsum(~anchor)
        last = np.maximum.accumulate(np.where(anchor, after, 0))  # content words up to the last anchor
        spot = np.flatnonzero((anchor | (after - last > p.gap)) & (after + p.chain <= len(content)))
        if len(spot):
            sig = h[spot]
            for k in range(p.chain):
                sig = (sig ^ (sig >> np.uint64(29))) * _MIX + h[content[after[spot] + k]]
            return np.unique(sig)
    return np.array([xxh3_64_intdigest(text)], np.uint64)


def digest(sig: np.ndarray) -> str:
    """A fingerprint as a short string: number of signatures, and 128 bits over all of them."""
    return f"{len(sig)}-{xxh3_128_hexdigest(sig.tobytes())}"


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard index of two sorted sets; 0 without a look at them if their lengths rule it out."""
    if min(len(a), len(b)) < at_least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


NEXT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def with_next(docs: DataFrame, p: Spots = SPOTS) -> DataFrame:
    """``docs(doc_id, text)`` -> NEXT. The successor is the next document by ascending id, of the
    last one the first; the edited text is the document with its last floor(n / 2) code points
    replaced by the successor's first as many.

    Ids are cut into ranges of about ``range_bytes`` of text; the texts are shuffled once, to
    their ranges, and the first document of a range also goes to the range before.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = docs.where("doc_id is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(min(p.max_ranges, total // p.range_bytes + 1))
    cuts = known.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    cuts = np.unique(np.array(cuts, np.float64)).astype(np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="right").astype(np.int32))

    firsts = known.select("doc_id", range_of("doc_id").alias("r")).groupBy("r").agg(F.min("doc_id").alias("first")).collect()
    firsts = sorted((r["r"], r["first"]) for r in firsts)  # at most max_ranges
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def ranges_of(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, ids.to_numpy(), side="right")
        return pd.Series([[r, before[i]] if i in before else [r] for i, r in zip(ids.tolist(), own.tolist())])

    sent = known.select("doc_id", "text", F.posexplode(ranges_of("doc_id")).alias("guest", "r"))
    lone = docs.where("doc_id is null").select("doc_id", "text", F.lit(2).alias("guest"),
                                              F.pmod(F.xxhash64("text"), F.lit(n)).cast("int").alias("r"))
    # every range ends with a guest, so the last document of a range always finds its successor
    rows = (sent.unionByName(lone).repartition(max(n, 1), "r")
            .sortWithinPartitions("r", "guest", F.col("doc_id").asc_nulls_last(), F.xxhash64("text")))
    return rows.select("doc_id", "text", "guest").mapInArrow(lambda batches: _compare(batches, p), NEXT)


def _compare(batches: Iterator[pa.RecordBatch], p: Spots) -> Iterator[pa.RecordBatch]:
    def stream():
        for b in text_slices(batches):
            yield from zip(b.column("doc_id").to_pylist(), texts_of(b.column("text")), b.column("guest").to_pylist())

    out, size, held = [], 0, None  # held: (doc_id, text, its signatures) that waits for its successor
    for doc_id, raw, guest in stream():
        if held is None and guest == 1:
            continue                    # a further guest: the successor is known already
        sig = signatures(raw, p)
        if held is not None:
            out.append(_row(*held, raw, sig, p))
        if doc_id is None:              # these follow the guest of their range
            out.append(_row(doc_id, raw, sig, raw, sig, p))
        held = None if guest else (doc_id, raw, sig)
        size += len(raw)
        if size > (8 << 20):
            yield _table(out)
            out, size = [], 0
    if out:
        yield _table(out)


def _row(doc_id, raw: bytes, sig: np.ndarray, next_raw: bytes, next_sig: np.ndarray, p: Spots) -> tuple:
    text = raw.decode()
    half = len(text) // 2
    edited = (text[:len(text) - half] + next_raw[:4 * half].decode(errors="ignore")[:half]).encode()
    edited_sig = signatures(edited, p)
    return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), digest(sig), digest(edited_sig),
            likeness(sig, edited_sig), likeness(sig, next_sig))


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      names=[x.split()[0] for x in NEXT.split(", ")])


def near_pairs(docs: DataFrame, at_least: float = 0.8, p: Spots = SPOTS) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, text)`` -> (membership: doc_id, fingerprint; pairs: a, b, likeness of different
    fingerprints that are at least ``at_least`` alike, a < b)."""
    def prints(batches):
        for b in text_slices(batches):
            sigs = [signatures(t, p) for t in texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(map(digest, sigs)), pa.array([s.view(np.int64) for s in sigs], pa.list_(pa.int64()))],
                names=["doc_id", "fingerprint", "sigs"])

    made = staged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        prints, "doc_id bigint, fingerprint string, sigs array<bigint>"), "spotsigs")
    sets = made.groupBy("fingerprint").agg(F.first("sigs").alias("sigs")).withColumn("n", F.size("sigs"))
    each = sets.select("fingerprint", "n", F.explode("sigs").alias("sig"))
    rare = each.join(each.groupBy("sig").agg(F.count("*").alias("df")), "sig")
    # a pair above the limit shares one of its n - ceil(limit n) + 1 rarest signatures
    prefix = rare.groupBy("fingerprint", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("s"))
    prefix = prefix.select("fingerprint", "n", F.explode(F.expr(
        f"slice(s, 1, int(n - ceil({at_least} * n - 1e-9) + 1))")).alias("x")).select("fingerprint", "n", "x.sig")
    # length ranges [limit^-k, limit^-(k+1)): a pair above the limit is in the same or in the next one
    part = F.floor(F.log(F.col("n").cast("double")) / -np.log(at_least) + 1e-9)
    left = prefix.select(F.col("fingerprint").alias("a"), F.col("n").alias("na"), "sig", part.alias("part"))
    right = prefix.select(F.col("fingerprint").alias("b"), F.col("n").alias("nb"), "sig",
                          F.explode(F.array(part - 1, part, part + 1)).alias("part"))
    pairs = (left.join(right, ["sig", "part"])
             .where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= at_least * F.greatest("na", "nb")))
             .select("a", "b").distinct())
    pairs = (pairs.join(sets.select(F.col("fingerprint").alias("a"), F.col("sigs").alias("sa")), "a")
             .join(sets.select(F.col("fingerprint").alias("b"), F.col("sigs").alias("sb")), "b"))
    both = F.size(F.array_intersect("sa", "sb"))
    pairs = pairs.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("likeness"))
    return made.select("doc_id", "fingerprint"), pairs.where(F.col("likeness") >= at_least)
