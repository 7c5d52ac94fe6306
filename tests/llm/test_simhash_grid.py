import random

import pytest
from xxhash import xxh64_intdigest

from runlens.llm import queries
from runlens.llm import simhash_grid as S

from .conftest import EDGE_ROWS


def plain(text):
    """The fingerprint bit by bit."""
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> j & 1 for h in hashes) > len(hashes)) << j for j in range(64))


def reach(fps):
    """Component (a set of fingerprints) of each, by comparing all pairs."""
    left, out = set(fps), {}
    while left:
        todo, group = [left.pop()], set()
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 3}
            left -= near
            todo += near
        out |= dict.fromkeys(group, frozenset(group))
    return out


def expected(rows):
    fps = [plain(t) for _, t in rows]
    at, least = reach(fps), {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[at[f]] = min(i, least.get(at[f], i))
    return sorted(((i, f"{f:016x}", least.get(at[f])) for (i, _), f in zip(rows, fps)), key=repr)


def test_fingerprint(texts):
    for t in list(texts.values())[:60] + ["", "one", "One TWO", "ÉTÉ été x", " a  b\tc\nd ", None]:
        assert S.fingerprint((t or "").encode()) == plain(t)
    long = " ".join(f"w{i % 977} v{i % 31}" for i in range(70_000))  # more than one chunk
    assert S.fingerprint(long.encode()) == plain(long)


def test_embedding_is_a_lower_bound(spark):
    """Pairs within three bits meet: one of them lies in a cell that the other lies in or enters."""
    rnd = random.Random(5)
    pairs = []
    for _ in range(300):
        a = rnd.choice([rnd.getrandbits(64), 0, 2 ** 64 - 1, rnd.getrandbits(64) & rnd.getrandbits(64)])
        b = a
        for j in rnd.sample(range(64), rnd.randint(0, 3)):
            b ^= 1 << j
        pairs.append((a, b))
    signed = lambda x: x - (x >> 63 << 64)
    df = spark.createDataFrame([(signed(x),) for x in {y for p in pairs for y in p}], "fp long")
    home, cells = {}, {}
    for r in S.grid(df).collect():
        cells.setdefault(r["fp"], set()).add(r["cell"])
        if r["home"]:
            home.setdefault(r["fp"], set()).add(r["cell"])
    for a, b in pairs:
        a, b = signed(a), signed(b)
        assert home[a] & cells[b] or home[b] & cells[a]


@pytest.mark.parametrize("crowd", [1, 16, 10 ** 6])
def test_components_of_planted_families(spark, crowd):
    """Dense families, chains of links and lone fingerprints, with and without the centres."""
    rnd = random.Random(crowd)
    flip = lambda x, n: x ^ sum(1 << j for j in rnd.sample(range(64), n))
    fps = [rnd.getrandbits(64) for _ in range(300)] + [0, 2 ** 64 - 1, 1, 2 ** 64 - 2]
    centre = rnd.getrandbits(64)
    fps += [flip(centre, rnd.randint(0, 6)) for _ in range(400)]
    for _ in range(5):
        x = rnd.getrandbits(64)
        for _ in range(30):
            fps.append(x := flip(x, rnd.choice([3, 3, 4])))
    fps = sorted(set(fps))
    signed = lambda x: x - (x >> 63 << 64)
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    p = S.Fingerprinting(crowd=crowd)
    held = S.crowded(nodes, p)
    groups = None if held.isEmpty() else S.components(S.stars(held))
    label = {x: signed(x) for x in fps}
    for table in [t for t in (groups, S.components(S.links(nodes, groups))) if t is not None]:
        new = {r["node"]: r["label"] for r in table.collect()}
        label = {x: new.get(y, y) for x, y in label.items()}
    at = reach(fps)
    by_label = {}
    for x, y in label.items():
        by_label.setdefault(y, set()).add(x)
    assert {frozenset(g) for g in by_label.values()} == set(at.values())
    assert (crowd == 10 ** 6) == (groups is None)


@pytest.mark.parametrize("at", ["sf0.001", "sf0.01"])
def test_query_equals_all_pairs(spark, sf, at):
    path = sf.rsplit("/", 1)[0] + "/" + at
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op12_simhash_grid"](spark, path)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_edges(spark, edge, empty):
    got = S.near_components(edge).selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0'))", "component_id")
    assert sorted(map(tuple, got.collect()), key=repr) == expected([(r[0], r[1]) for r in EDGE_ROWS])
    assert S.near_components(empty).collect() == []
