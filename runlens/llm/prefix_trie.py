"""Conversation prefix trie (operator 11): subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns; it is known by its depth and a 128-bit hash of the
(place, turn) pairs on its path. That hash is an exclusive-or, so it is a running aggregate and a conversation
of any length is hashed by row-balanced ranges; the parent's hash is the node's without its last turn. Once made,
a node is named by its smallest member and its depth, two longs.

Totals over subtrees come from contraction rounds, each of them a few joins on written tables:
* rake: leaves go, each adding its total to its parent;
* compress: a node with one child goes if its parent and that child stay (it must come before both in the
  round's order and the child must be no leaf); its value is added to its parent, which gets the child.
The order prefers depths with few trailing zero bits, which halves a plain chain each round, and every
second round a hash of the node and the round instead, so no shape of tree resists. A tree of any depth is
done in a number of rounds that grows with the logarithm of its nodes. Then the compressed nodes are expanded
in the opposite order: a node's total is its value when it went and the total of the child it had.

Scale: texts are read once and reduced to hashes and word counts; only these are shuffled. A node with very
many children (the root) is a hot key of joins that have one row on its side, which Spark splits, and of
aggregates that combine before the shuffle. The ids that end at a node stream in order through one hash
(SHA-256 has no parts), without being held.

Edge cases: turns go by ``turn`` (null first), ties by a hash of role and text; null role or text is empty.
Rows that repeat are turns of their own. Rows with a null conv_id belong to no conversation and are left
out. A conversation without turns is a member of the root only. No conversation: no node, not even the root.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import running
from .common import n_words, staged

EMPTY_SHA256 = sha256().hexdigest()


def positions(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> conv_id, pos (from 1), a, b (hashes of the turn), words."""
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.select("conv_id", "turn", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "role", "text").alias("b"),
                         n_words("text").alias("words"))
    placed = running(turns, ["conv_id"], ["turn", "a", "b"], sums={"pos": F.lit(1).cast("bigint")}, include_current=True)
    return staged(placed.select("conv_id", "pos", "a", "b", "words"), "trie-turns")


def with_shared_heads(turns: DataFrame, every: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Rebuild each conversation c: first its h = crc32(c) % ``heads`` first turns are those of conversation
    c - c % ``every`` (SQL's remainder, so towards zero; all if it has fewer), then come its own after its first h. ``turns`` as made by
    ``positions`` -> (turns, conversations: conv_id, also of those that are left without a turn)."""
    h = lambda c: F.crc32(F.col(c).cast("string")) % heads
    base = F.col("conv_id") - F.col("conv_id") % every
    of = staged(turns.groupBy("conv_id").agg(F.max("pos").alias("n")), "trie-conversations")
    # a base has its id's own multiple of `every`; its first turns are few and join every conversation of its block
    lengths = of.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    of = of.withColumn("base", base).join(lengths, "base", "left")
    of = of.select("conv_id", "base", F.least(h("conv_id"), F.coalesce("base_n", F.lit(0))).alias("head"))
    first = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    shared = of.where("head > 0").join(first, "base").where("pos <= head").select("conv_id", "pos", "a", "b", "words")
    own = turns.where(F.col("pos") > h("conv_id")).join(of, "conv_id")
    own = own.select("conv_id", (F.col("pos") - h("conv_id") + F.col("head")).alias("pos"), "a", "b", "words")
    return shared.unionByName(own), of.select("conv_id")


def digests_of_ends(members: DataFrame, keys: list[str]) -> DataFrame:
    """``members(*keys, conv_id)`` -> *keys, ends_sha256: the hash of each group's ids, ascending and joined by
    commas, made while they stream by."""
    schema = members.select(*keys, F.lit("").alias("ends_sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []

        def flush() -> pa.RecordBatch:
            columns = zip(*[(*k, d) for k, d in done])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[*keys, "ends_sha256"])

        types = [pa.int64()] * len(keys) + [pa.string()]
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy() for k in keys]
            first = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])
            ids = b.column("conv_id").to_numpy()
            for start, stop in zip(first.tolist(), [*first[1:].tolist(), b.num_rows]):
                key = tuple(int(c[start]) for c in cols)
                if key != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest, text = key, sha256(), ""
                else:
                    text = ","
                digest.update((text + ",".join(map(str, ids[start:stop].tolist()))).encode())
            if len(done) > 10_000:
                yield flush()
                done = []
        if now is not None:
            done.append((now, digest.hexdigest()))
            yield flush()

    return members.repartition(*keys).sortWithinPartitions(*keys, "conv_id").select(*keys, "conv_id").mapInArrow(run, schema)


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """``turns(conv_id, pos, a, b, words)``, ``conversations(conv_id)`` -> one row per node: conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    length = turns.groupBy("conv_id").agg(F.max("pos").alias("m"))
    term = lambda lane: F.xxhash64(F.lit(lane), "pos", "a", "b")
    paths = running(turns, ["conv_id"], ["pos"], xors={"k1": term(1), "k2": term(2)}, include_current=True)
    paths = staged(paths.select("conv_id", F.col("pos").alias("depth"), "k1", "k2", F.col("k1").bitwiseXOR(term(1)).alias("p1"),
                                F.col("k2").bitwiseXOR(term(2)).alias("p2"), "words"), "trie-paths")
    made = paths.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
                                                  F.min(F.struct("p1", "p2", "words")).alias("r"))
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("bigint")
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs",
                       F.lit(None).cast("bigint").alias("p1"), F.lit(None).cast("bigint").alias("p2"), zero.alias("words"))
    made = staged(made.select("depth", "k1", "k2", "conv_id", "n_convs", "r.p1", "r.p2", "r.words").unionByName(root), "trie-hashed")

    ends = conversations.join(length, "conv_id", "left").select("conv_id", F.coalesce("m", F.lit(0)).alias("depth"))
    last = paths.select("conv_id", "depth", "k1", "k2").join(ends.where("depth > 0"), ["conv_id", "depth"])
    last = last.select("depth", "k1", "k2", "conv_id").unionByName(
        ends.where("depth = 0").select("depth", zero.alias("k1"), zero.alias("k2"), "conv_id"))
    ended = digests_of_ends(last, ["depth", "k1", "k2"])

    above = made.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                        F.col("conv_id").alias("parent_conv_id"))
    nodes = made.join(above, ["depth", "p1", "p2"], "left").join(ended, ["depth", "k1", "k2"], "left")
    nodes = staged(nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "words",
                                F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")), "trie-nodes")
    kids = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")) \
        .agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = staged(nodes, "trie-nodes")
    own = {"saved_tokens": (F.col("n_convs") - 1) * F.col("words"), "n_leaves": (F.col("n_children") == 0).cast("bigint")}
    totals = subtree_totals(nodes.select(
        F.struct("conv_id", "depth").alias("id"), F.when(F.col("depth") > 0, F.struct(F.col("parent_conv_id").alias("conv_id"),
                                                                                     (F.col("depth") - 1).alias("depth"))).alias("parent"),
        F.col("n_children").alias("kids"), *[v.alias(k) for k, v in own.items()]), list(own))
    totals = totals.select("id.conv_id", "id.depth", *own)
    return nodes.join(totals, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                                          "saved_tokens", "ends_sha256")


def _turn_of(node: str, round_: int) -> Column:
    """Where a node comes in a round's order; nodes that come before their neighbours may be compressed."""
    lot = F.xxhash64(F.lit(round_), f"{node}.conv_id", f"{node}.depth")
    if round_ % 2:
        return F.struct(F.lit(0).cast("bigint").alias("bit"), lot.alias("lot"))
    depth = F.col(f"{node}.depth")
    return F.struct(depth.bitwiseAND(-depth).alias("bit"), lot.alias("lot"))


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """``tree(id, parent, kids, *values)``, one root with a null parent -> id and each value's sum over the node's
    subtree. ``id`` and ``parent`` are structs of conv_id and depth, ``kids`` the number of children."""
    tree, raked, compressed, round_ = staged(tree, "trie-live"), [], [], 0
    while tree.where("parent is not null").limit(1).count():
        up = tree.select(F.col("id").alias("parent"), F.col("parent").alias("above"), F.col("kids").alias("up_kids"),
                         *[F.col(v).alias(f"up_{v}") for v in values])
        seen = tree.join(up, "parent", "left")
        leaf = (F.col("kids") == 0) & F.col("parent").isNotNull()
        turn = _turn_of("parent", round_)
        splice = ((F.col("kids") > 0) & (F.col("up_kids") == 1) & F.col("above").isNotNull() & (turn < _turn_of("id", round_))
                  & ((F.col("above.depth") == 0) | (turn < _turn_of("above", round_))))
        seen = staged(seen.withColumn("leaf", leaf).withColumn("splice", F.coalesce(splice, F.lit(False))), "trie-seen")
        leaves, spliced = seen.where("leaf"), seen.where("splice")
        raked.append(leaves.select("id", *values))
        compressed.append(spliced.select(F.col("parent").alias("id"), F.col("id").alias("child"),
                                         *[F.col(f"up_{v}").alias(v) for v in values]))
        none = [F.lit(0).cast("bigint").alias(f"add_{v}") for v in values]
        told = leaves.select(F.col("parent").alias("id"), *[F.col(v).alias(f"add_{v}") for v in values],
                             F.lit(1).alias("fewer"), F.lit(False).alias("gone"))
        told = told.unionByName(spliced.select(F.col("above").alias("id"), *[F.col(f"up_{v}").alias(f"add_{v}") for v in values],
                                               F.lit(0).alias("fewer"), F.lit(False).alias("gone")))
        told = told.unionByName(spliced.select(F.col("parent").alias("id"), *none, F.lit(0).alias("fewer"), F.lit(True).alias("gone")))
        told = told.groupBy("id").agg(*[F.sum(f"add_{v}").alias(f"add_{v}") for v in values], F.sum("fewer").alias("fewer"),
                                      F.max("gone").alias("gone"))
        stay = seen.where("not leaf").join(told, "id", "left").where(~F.coalesce("gone", F.lit(False)))
        tree = staged(stay.select("id", F.when(F.col("splice"), F.col("above")).otherwise(F.col("parent")).alias("parent"),
                                  (F.col("kids") - F.coalesce("fewer", F.lit(0))).alias("kids"),
                                  *[(F.col(v) + F.coalesce(f"add_{v}", F.lit(0))).alias(v) for v in values]), "trie-live")
        round_ += 1
    # what is left is the root; later rounds' nodes are known before earlier ones', which hang on them
    known = [tree.select("id", *values)]
    for leaves, spliced in zip(reversed(raked), reversed(compressed)):
        done = reduce(DataFrame.unionByName, known)
        total = spliced.join(done.select(F.col("id").alias("child"), *[F.col(v).alias(f"t_{v}") for v in values]), "child")
        total = total.select("id", *[(F.col(v) + F.col(f"t_{v}")).alias(v) for v in values])
        known += [staged(total, "trie-totals"), leaves]
    return reduce(DataFrame.unionByName, known)
