"""MinHash near-dedup (operator 7): Order MinHash, verified by banded alignment.

Equal texts are one class first, by a hash of the text. A text is then its sequence of word k-mers
(five words in small letters), each labelled with its occurrence number in the text, so repeats
count. A sketch takes the ``picked`` least of them under its own hash function and keeps them in
text order; ``sketches`` such keys per text make the buckets. Two texts of similarity s meet in a
sketch with probability of about s^picked, so at 0.8 with 6 of 64 they meet in none of them once in 10^8.
Short texts fall short of that, as picking is without replacement. Those of up to ``doubled`` k-mers get
twice the sketches, and those of up to ``exact`` have their whole sequence as a key, and the sequence
without any one, two, ... k-mers, as many as a pair at the limit may leave unmatched on one side: what
a pair has in common is then a key of both texts, and none with a union of up to ``exact`` is missed.

Similarity of two texts is the ordered Jaccard index m / (n1 + n2 - m), m being the longest common
subsequence of their labelled k-mers inside a band of the diagonal wide enough for every pair at
the limit (a matched pair cannot lie further off than the k-mers that may stay unmatched). Labelled
k-mers match at most one place each, so alignment is a longest increasing run of places.

Pairs: a bucket's members are not compared with one another but with a few drawn members, first of
all its middle, the text that meets the most others over all sketches. After a round, classes are
the connected components of all links so far; a bucket whose texts are in one class is done. The texts
of the others change to buckets of their rarest k-mers (``by_rarest``), an exact prefix filter: what
texts share because many do (a passage, a template) brings them together no longer, unless it is nearly
all they have. There, too, the drawn members, having met all, leave, and the next round draws more and compares
texts of different classes only. It ends when every bucket is done or has had all such pairs
compared, so no link that would join two classes is lost, whatever the size of a bucket.

Scale: no bucket is gathered: drawing is by a hash and the bucket's size, pairs are
a join on the key, and each pair's k-mers join to it afterwards, if the counts of k-mers by place, an upper
bound of what two texts have in common, leave them near. Text hashes are 64 bits.

Edge cases: null text counts as empty; texts without a k-mer (fewer than five words) are near their
equals in words only; the empty texts are one class. A class is named by its least id; null ids
come last. Classes whose least ids are null or equal share that name and differ in their label.
Rows that repeat are in one class. Empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import staged, text_slices, texts_of
from .components import components


@dataclass(frozen=True)
class Sketching:
    k: int = 5
    picked: int = 6
    sketches: int = 64
    at_least: float = 0.8
    exact: int = 14       # k-mers of texts that meet by what they have in common
    doubled: int = 80     # k-mers of texts that get twice the sketches
    draws: int = 8        # per bucket in the second round, besides its middle; one in the first, then four times as many each
    seed: int = 11


SKETCHING = Sketching()
LENGTHS = 1.02  # longest to shortest text of a bucket by rarest k-mers
_CELLS = 1 << 20  # k-mers times sketches hashed at once
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def kmers(text: bytes, p: Sketching = SKETCHING) -> np.ndarray:
    """Hashes of the occurrence-labelled k-mers in text order; all words as one if they are fewer than k."""
    words = text.lower().split()
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(h):
        return h
    k = min(p.k, len(h))
    x = np.full(len(h) - k + 1, len(h) if len(h) < p.k else 0, np.uint64)
    for i in range(k):
        x = _stir(x + h[i:len(h) - k + 1 + i])
    order = np.argsort(x, kind="stable")     # equal k-mers stand together, in text order
    y = x[order]
    first = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
    if len(first) < len(y):
        nth = np.arange(len(y)) - np.repeat(first, np.diff(np.r_[first, len(y)]))
        x[order] = _stir(y + nth.astype(np.uint64) * _M2)
    return x


def sketch(x: np.ndarray, p: Sketching = SKETCHING) -> np.ndarray:
    """One key per sketch: the ``picked`` least k-mers of each hash function, in text order."""
    factors = _stir(np.arange(1, p.sketches + 1, dtype=np.uint64) + np.uint64(p.seed << 32)) | np.uint64(1)
    out = []
    for some in np.array_split(factors, min(p.sketches, 1 + p.sketches * len(x) // _CELLS)):
        key = some.copy()
        if len(x) > p.picked:
            v = x[None, :] * some[:, None]
            at = _least(v, p.picked)
        else:
            at = np.broadcast_to(np.arange(len(x)), (len(some), len(x)))
        for i in range(at.shape[1]):
            key = _stir(key + x[at[:, i]])
        out.append(key)
    return np.concatenate(out)


def _least(v: np.ndarray, many: int) -> np.ndarray:
    """Columns of the ``many`` least values of each row, ascending."""
    rows, n = v.shape
    if n > 8 * many:
        # few values are under a bound that about 4 * many of a row should pass
        r, c = np.nonzero(v < np.uint64(4 * many / n * 2.0 ** 64))
        if (np.bincount(r, minlength=rows) >= many).all():
            order = np.lexsort((v[r, c], r))
            first = np.searchsorted(r, np.arange(rows))
            return np.sort(c[order[first[:, None] + np.arange(many)]], axis=1)
    return np.sort(np.argpartition(v, many - 1, axis=1)[:, :many], axis=1)


@lru_cache
def _kept(n: int, out: int) -> np.ndarray:
    """Places that stay, one row per way to leave ``out`` of ``n`` away."""
    return np.array(list(combinations(range(n), n - out)), np.int64)


def bucket_keys(x: np.ndarray, p: Sketching = SKETCHING) -> np.ndarray:
    """All bucket keys of a text: its sketches, and for few k-mers the sequences it may share with a near text."""
    n, out = len(x), []
    if n <= p.exact:
        for away in range(int((1 - p.at_least) * n + 1e-9) + 1):
            at = _kept(n, away)
            key = np.full(len(at), p.seed, np.uint64)
            for i in range(at.shape[1]):
                key = _stir(key + x[at[:, i]])
            out.append(key)
    if n >= p.at_least * (p.exact + 1) - 1e-9:  # shorter ones have no near text with a larger union
        out.append(sketch(x, replace(p, sketches=2 * p.sketches) if n <= p.doubled else p))
    return np.concatenate(out)


def similarity(a: np.ndarray, b: np.ndarray, at_least: float) -> float:
    """Ordered Jaccard index of two sequences of labelled k-mers by banded alignment; 0 as soon as it
    must be below ``at_least``."""
    n, m = len(a), len(b)
    if not n and not m:
        return 1.0
    need = at_least * (n + m) / (1 + at_least)  # least length of the common subsequence
    if min(n, m) < need - 1e-9:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = n + m - 2 * need + 1                 # places that unmatched k-mers can shift a match by
    keep = np.abs(i - j) <= band
    i, j = i[keep], j[keep]
    if len(i) < need - 1e-9:
        return 0.0
    j = j[np.argsort(i)]
    if (j[1:] > j[:-1]).all():
        common = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            if at == len(tails):
                tails.append(x)
            else:
                tails[at] = x
        common = len(tails)
    return common / (n + m - common)


def counts(x: np.ndarray) -> bytes:
    """Number of k-mers (up to 255) by their last bits, in as many places as there are k-mers, or up to twice as many."""
    places = 1 << max(6, int(len(x) - 1).bit_length())
    return np.minimum(np.bincount((x & np.uint64(places - 1)).astype(np.int64), minlength=places), 255).astype(np.uint8).tobytes()


def may_be_near(a: bytes, b: bytes, n: int, m: int, at_least: float) -> bool:
    """False if the ``counts`` of two texts of ``n`` and ``m`` k-mers rule out that they are ``at_least`` alike: they have no
    more k-mers in common than the lesser count of each place."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    if x.max() == 255 or y.max() == 255:
        return True  # places that were not counted to the end
    common = int(np.minimum(x, y.reshape(-1, len(x)).sum(axis=0)).sum())
    return common >= at_least * (n + m) / (1 + at_least) - 1e-9


def _sequences(texts: DataFrame, p: Sketching) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            xs = [kmers(t, p) for t in texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("tid"), pa.array([x.view(np.int64) for x in xs], pa.list_(pa.int64())),
                 pa.array([len(x) for x in xs], pa.int32()), pa.array([counts(x) for x in xs], pa.binary())],
                names=["tid", "kmers", "n", "counts"])
    return texts.select("tid", "text").mapInArrow(make, "tid bigint, kmers array<bigint>, n int, counts binary")


def buckets(texts: DataFrame, p: Sketching = SKETCHING) -> DataFrame:
    """``texts(tid, text)`` -> tid, key: one row per text and bucket key; none for the empty text."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            xs = [kmers(t, p) for t in texts_of(b.column("text"))]
            of = np.array([i for i, x in enumerate(xs) if len(x)], np.int64)
            if len(of):
                keys = [bucket_keys(xs[i], p) for i in of]
                tids = b.column("tid").take(pa.array(np.repeat(of, [len(k) for k in keys])))
                yield pa.RecordBatch.from_arrays([tids, pa.array(np.concatenate(keys).view(np.int64))], names=["tid", "key"])
    return texts.select("tid", "text").mapInArrow(make, "tid bigint, key bigint")


def links(docs: DataFrame, p: Sketching = SKETCHING) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs(doc_id, text)`` -> (members: doc_id, tid; links: a, b between different texts, as many as
    join the classes; labels: tid, label of the texts that have a link)."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tid"))
    members = staged(docs.select("doc_id", "tid"), "omh-members")
    made = staged(buckets(docs, p).distinct(), "omh-buckets")
    sizes = made.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    live = staged(made.join(sizes, "key"), "omh-live")
    # how many texts a text meets over all sketches: the middle of a group meets the most
    weight = live.groupBy("tid").agg(F.sum("n").alias("weight"))
    live = staged(live.drop("n").join(weight, "tid").select("*", F.col("tid").alias("label"), F.lit(0).alias("n"), F.lit(0).alias("room")), "omh-live")
    sequences = staged(_sequences(docs.join(weight.select("tid"), "tid", "left_semi").dropDuplicates(["tid"]), p), "omh-kmers")
    found, asked, round_ = None, None, 0
    while True:
        # drawn are the member that meets the most, and about n others, in all buckets those of the least hash
        n = p.draws << 2 * (round_ - 1) if round_ else 1
        sizes = live.where(_short(p)).groupBy("key").agg(F.count("*").alias("size"), F.max_by("tid", F.struct("weight", "tid")).alias("middle"))
        least = F.pmod(F.xxhash64("tid", F.lit(round_)), F.lit(1 << 30)) / float(1 << 30) * F.col("size") < n
        drawn = live.where(_short(p)).join(sizes, "key").where(least | (F.col("tid") == F.col("middle")))
        drawn = staged(drawn.select("key", *[F.col(c).alias(f"rep_{c}") for c in ("tid", "label", "n", "room")]), "omh-drawn")
        enough = F.least("room", "rep_room") >= (F.col("n") + F.col("rep_n")) * _common(p)
        pairs = live.join(drawn, "key").where("tid <> rep_tid and label <> rep_label").where(enough)
        pairs = pairs.select(F.least("tid", "rep_tid").alias("a"), F.greatest("tid", "rep_tid").alias("b")).distinct()
        if asked is not None:
            pairs = pairs.join(asked, ["a", "b"], "left_anti")
        pairs = staged(pairs, "omh-pairs")
        asked = pairs if asked is None else asked.unionByName(pairs)
        new = staged(verified(pairs, sequences, p), "omh-links")
        if found is None or not new.isEmpty():
            found = new if found is None else found.unionByName(new)
            labels = components(found).withColumnRenamed("node", "tid")
        # a bucket is done when its texts are in one class; the drawn ones have met all others
        live = (live.drop("label").join(labels, "tid", "left").withColumn("label", F.coalesce("label", "tid"))
                .join(drawn.select("key", F.col("rep_tid").alias("tid")), ["key", "tid"], "left_anti"))
        live, round_ = staged(_split(live, p), "omh-live"), round_ + 1
        if round_ == 1:
            live = narrowed(live, sequences, p)
        if live.isEmpty():
            return members, found, labels


def _common(p: Sketching) -> float:
    """Least share of the k-mers of two near texts together that both have; rounded down."""
    return p.at_least / (1 + p.at_least) - 1e-6


def _short(p: Sketching) -> Column:
    """Texts that can have enough in common with one as long as they are."""
    return F.col("room") >= 2 * F.col("n") * _common(p)


def _split(live: DataFrame, p: Sketching) -> DataFrame:
    """The buckets that hold several classes, and a text that others must be compared with."""
    ends = live.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.bool_or(_short(p)).alias("any"))
    return live.join(ends.where("lo < hi and any").select("key"), "key")


def narrowed(live: DataFrame, sequences: DataFrame, p: Sketching = SKETCHING) -> DataFrame:
    """``live`` by its rarest k-mers, again as long as a tenth of the texts leave: what only they had in common with others
    does not count the next time."""
    before = None
    while True:
        texts = live.select("tid").distinct().count()
        if not texts or before and texts > 0.9 * before:
            return live
        before, live = texts, staged(_split(by_rarest(live, sequences, p), p), "omh-live")


def by_rarest(live: DataFrame, sequences: DataFrame, p: Sketching = SKETCHING) -> DataFrame:
    """``live(key, tid, weight, label, n, room)`` -> the same texts in buckets of their rarest k-mers, and only texts that can
    be near one of another class; ``n``: k-mers of the text, ``room``: those it can have in common with a text of another
    class when the bucket's is the first of them.

    Near texts of n <= m k-mers have at least s * (n + m) / (1 + s) of them in common (s = ``at_least``), so s * m and
    2s / (1 + s) * n. All k-mers have one order: by the number of texts, after those that no text of another class has. In
    the bucket of the first k-mer in it that both have, both have room for what they have in common. So no near pair of two
    classes is missed, and pairs without that room need no comparison; each has a member that is ``_short``, the shorter text.
    A bucket is of texts of about one length, and of those that have room to be the shorter one of a pair with them.
    """
    texts = live.select("tid", "weight", "label").distinct()
    held = staged(sequences.join(texts, "tid").select("tid", "weight", "label", "n", F.explode("kmers").alias("key")), "omh-held")
    shared = held.groupBy("key").agg(F.count("*").alias("texts"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    own = held.join(shared.where("lo < hi").select("key", "texts"), "key").groupBy("tid", "weight", "label", "n").agg(
        F.sort_array(F.collect_list(F.struct("texts", "key"))).alias("rarest"))
    own = own.select("tid", "weight", "label", "n", F.size("rarest").alias("all"), F.posexplode("rarest").alias("at", "kmer"))
    own = own.select("kmer.key", "tid", "weight", "label", "n", (F.col("all") - F.col("at")).alias("room"))
    longest = F.greatest("n", F.col("room") / _common(p) - F.col("n"))  # that it can be near, the shorter one of the two

    def length(n: Column) -> Column:
        return F.floor(F.log(n) / float(np.log(LENGTHS)))
    own = own.where(F.col("room") >= F.col("n") * (p.at_least - 1e-6))
    own = own.select("*", F.explode(F.sequence(length(F.col("n")), length(longest))).alias("length"))
    return own.select(F.xxhash64("key", "length").alias("key"), "tid", "weight", "label", "n", "room")


def verified(pairs: DataFrame, sequences: DataFrame, p: Sketching = SKETCHING) -> DataFrame:
    """``pairs(a, b)`` -> those at least ``at_least`` alike. Their k-mers are fetched for the pairs only that the much
    smaller ``counts`` of both texts do not rule out."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("xa", "xb", "na", "nb"))
            yield b.select(["a", "b"]).filter(pa.array([may_be_near(*r, p.at_least) for r in zip(*cols)], pa.bool_()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(c) for c in ("xa", "xb"))
            xs, ys = x.flatten().to_numpy().view(np.uint64), y.flatten().to_numpy().view(np.uint64)
            xe, ye = (np.r_[0, np.cumsum(c.value_lengths().to_numpy())] for c in (x, y))
            near = [similarity(xs[xe[i]:xe[i + 1]], ys[ye[i]:ye[i + 1]], p.at_least) >= p.at_least - 1e-9 for i in range(len(b))]
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    def with_both(pairs: DataFrame, texts: DataFrame, value: str) -> DataFrame:
        for side in "ab":
            of = texts.select(F.col("tid").alias(side), F.col("n").alias(f"n{side}"), F.col(value).alias(f"x{side}"))
            pairs = pairs.join(of, side)
        return pairs

    j = with_both(pairs, sequences, "counts").where(F.least("na", "nb") >= p.at_least * F.greatest("na", "nb") - F.lit(1e-9))
    pairs = staged(j.select("a", "b", "xa", "xb", "na", "nb").mapInArrow(compare, "a bigint, b bigint"), "omh-may")
    if pairs.isEmpty():
        return pairs
    asked = pairs.select(F.explode(F.array("a", "b")).alias("tid")).distinct()
    j = with_both(pairs, sequences.join(asked, "tid", "left_semi"), "kmers")
    return j.select("a", "b", "xa", "xb").mapInArrow(check, "a bigint, b bigint")


def classes(docs: DataFrame, p: Sketching = SKETCHING) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, tid (hash of its text), class_id (least id of its class), label
    (the class itself: ids may be null or shared, so two classes can have one class_id)."""
    members, _, labels = links(docs, p)
    named = members.join(labels, "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return named.join(least, "label").select("doc_id", "tid", "class_id", "label")


def one_each(docs: DataFrame, p: Sketching = SKETCHING) -> DataFrame:
    """One document of each class, columns unchanged: the one with the least id (null ids last), then with
    the least text hash; of rows that repeat, one."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "tid")
    kept = classes(docs, p).groupBy("label").agg(F.min_by(F.struct("doc_id", "tid"), order).alias("one"))
    kept = kept.select(F.col("one.doc_id").alias("_id"), F.col("one.tid").alias("_tid"))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid"))
    rows = rows.join(kept, F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (F.col("tid") == F.col("_tid")))
    return rows.dropDuplicates(["_id", "_tid"]).select("row.*")
