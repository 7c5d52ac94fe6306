import random
from collections import Counter, defaultdict

import pytest

from runlens.llm import mixing

from .conftest import EDGE_ROWS, doc, schema


def water(sizes, weights, total, cap):
    """Plain loop: share by weight, clamp, share the excess again until none is above."""
    target, free = {}, set(sizes)
    left = total
    while free:
        level = left / sum(weights[s] for s in free)
        over = [s for s in free if level * weights[s] >= cap * sizes[s]]
        if not over:
            return target | {s: level * weights[s] for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= cap * sizes[s]
            free.remove(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_match_the_loop(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02d}": rng.choice([1, 10, 100, 5000]) * rng.randint(1, 9) for i in range(rng.randint(1, 12))}
    df = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, n long, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    want = water(sizes, weights, 1.5 * sum(sizes.values()), 2)
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_taken_comes_near_target_and_repeats(spark):
    rng = random.Random(5)
    rows = [doc(i, "w " * (rng.randint(1, 80) if i % 50 else 900), source=rng.choice("aaab") + str(i % 2)) for i in range(3000)]
    df = spark.createDataFrame(rows, schema()).repartition(5)
    p = mixing.Mix(rows_per_range=200)
    a, b = ({r["doc_id"]: r["epochs"] for r in mixing.repetitions(x, p).collect()} for x in (df, df.repartition(2)))
    assert a == b
    got = mixing.repetitions(df, p).collect()
    taken = Counter()
    for r in got:
        assert 0 <= r["epochs"] <= 2
        taken[r["source"]] += r["epochs"] * r["size"]
    for s, t, n in {(r["source"], r["target"], r["source_size"]) for r in got}:
        assert abs(taken[s] - t) <= 0.01 * n


def test_mix_repeats_rows_with_their_columns(edge):
    out = mixing.mix(edge).collect()
    epochs = {(r["doc_id"], r["source"], r["text_key"]): r["epochs"] for r in mixing.repetitions(edge).collect()}
    assert len(out) == sum(r["n"] * r["epochs"] for r in mixing.repetitions(edge).collect())
    assert out[0].asDict().keys() == edge.first().asDict().keys()
    assert len(epochs) == len({r[:4] for r in EDGE_ROWS})
    both = defaultdict(int)
    for r in out:
        both[r["doc_id"], r["text"]] += 1
        assert r["row"] == "r" and r["text"]
    assert both[5, EDGE_ROWS[4][1]] % 2 == 0  # rows that repeat are drawn together


def test_empty(empty):
    assert mixing.mix(empty).count() == 0 and mixing.repetitions(empty).count() == 0
