import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from runlens.llm import prefix_trie as P
from runlens.llm import queries

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType()), T.StructField("pos", T.StringType()), T.StructField("depth", T.StringType())])


def expected(rows, every=20, heads=4):
    """The trie with sets of members, and sums over subtrees by walking every path."""
    signed = lambda x: x - (x >> 63 << 64)
    tie = lambda role, text: signed(xxh64_intdigest(text.encode(), xxh64_intdigest(role.encode(), 42)))
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, tie(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        path = tuple(own.get(abs(c) // every * every * (1 if c > 0 else -1), [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, ids in members.items():
        if node:
            children[node[:-1]] += 1
    for node, ids in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(ids) - 1) * len(node[-1][1].encode().split()) if node else 0
            leaves[node[:d]] += not children[node]
    return sorted((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), children[node], leaves[node], saved[node],
                   hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, ids in members.items())


def run(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/conversations.parquet")
    return queries.QUERIES["op11_prefix_trie"](spark, str(path))


def talk(c, turns):
    return [(c, i, "user" if i % 2 == 0 else "assistant", t, "p", "d") for i, t in enumerate(turns)]


def test_branching_and_deep_chains(spark, tmp_path):
    rnd, rows = random.Random(3), []
    for c in range(120):
        rows += talk(c, [rnd.choice(["a b", "c", "d e f"]) for _ in range(rnd.randint(1, 6))])
    deep = [f"turn {i % 7}" for i in range(150)]
    rows += talk(200, deep) + talk(201, deep) + talk(202, deep[:90] + ["other"] * 40)
    rows += [r for c in range(300, 330) for r in talk(c, deep[:c - 299])]      # a comb: one ends at each depth
    got = run(spark, rows, tmp_path)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(expected(rows), key=lambda r: r[:2])


def test_edges(spark, tmp_path):
    rows = [(None, 1, "user", "lost", "", ""), (7, None, "user", "first", "", ""), (7, 1, None, None, "", ""), (7, 1, "user", "tie", "", ""),
            (7, 1, "user", "tie", "", ""), (7, 2, "assistant", "", "", ""), (27, 5, None, "été 你好 \x1c", "", ""), (-5, 0, "user", "minus", "", ""),
            (-20, 0, "user", "base", "", ""), (40, 0, "user", "x " * 30_000, "", ""), (41, 0, "user", "gone", "", "")]
    rows += [(c, 0, "user", "same", "", "") for c in range(60, 75)]
    got = run(spark, rows, tmp_path)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(expected(rows), key=lambda r: r[:2])


def test_empty(spark, tmp_path):
    assert run(spark, [], tmp_path).collect() == []


@pytest.mark.parametrize("shape", ["chain", "star", "random", "comb"])
def test_contraction(spark, shape):
    """Subtree totals of single trees, whatever their shape and depths."""
    rnd, n = random.Random(len(shape)), 80
    up = {i: {"chain": i - 1, "star": 0, "random": rnd.randrange(i), "comb": i - 1 if i % 2 else i - 2 if i > 1 else 0}[shape] for i in range(1, n)}
    kids = defaultdict(int)
    depth = {0: 0}
    for i, p in up.items():
        kids[p] += 1
        depth[i] = depth[p] + 1
    value = {i: rnd.randint(0, 9) for i in range(n)}
    want = dict(value)
    for i in range(n - 1, 0, -1):
        want[up[i]] += want[i]
    kind = "id struct<conv_id:bigint,depth:bigint>, parent struct<conv_id:bigint,depth:bigint>, kids bigint, v bigint"
    rows = [((i, depth[i]), (up[i], depth[up[i]]) if i else None, kids[i], value[i]) for i in range(n)]
    got = P.subtree_totals(spark.createDataFrame(rows, kind), ["v"])
    assert {r["id"]["conv_id"]: r["v"] for r in got.collect()} == want
