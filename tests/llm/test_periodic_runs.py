import hashlib
import random
import zlib

import pytest

from runlens.llm import periodic_runs as P
from runlens.llm import queries

from .conftest import EDGE_ROWS


def brute(words, copies=4, least=6):
    """Runs by comparing the words at every distance; the smallest period of a stretch counts."""
    n, found = len(words), {}
    for q in range(1, n // copies + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(least, copies * q):
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def some_words(rnd):
    letters, n, out = rnd.choice([1, 2, 2, 3, 4, 8]), rnd.randint(0, 60), []
    while len(out) < n:
        if rnd.random() < .5:
            out += [rnd.randrange(letters) for _ in range(rnd.randint(1, 5))] * rnd.randint(1, 7)
        out += [rnd.randrange(letters) for _ in range(rnd.randint(0, 9))]
    return [b"%d" % x for x in out]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    texts = [some_words(rnd) for _ in range(400)]
    assert P.find(texts) == [brute(t) for t in texts]


def test_other_limits():
    rnd = random.Random(9)
    texts = [some_words(rnd) for _ in range(200)]
    p = P.Periods(copies=3, least=3)
    assert P.find(texts, p) == [brute(t, 3, 3) for t in texts]
    with pytest.raises(ValueError):
        P.find(texts, P.Periods(copies=4, least=3))


@pytest.mark.parametrize("root, copies", [(1, 30_000), (2, 9_000), (700, 20), (2_500, 5)])
def test_long_periods(root, copies):
    rnd = random.Random(root)
    unit = [b"%d" % rnd.randrange(300) for _ in range(root)] if root > 2 else [b"a", b"b"][:root]
    words = [b"before", *unit * copies, b"after"]
    assert P.find([words]) == [[(1, root * copies, root)]]
    assert P.collapsed(words, P.find([words])[0]) == [b"before", *unit, b"after"]


def rebuilt(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc_id, text):
    words = rebuilt(doc_id, text)
    runs = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(kept)).hexdigest())


def test_query_equals_brute_force(spark, sf, documents):
    got = queries.QUERIES["op13_periodic_runs"](spark, sf)
    few = {r["doc_id"]: r["text"] for r in documents.where("length(text) < 6000").collect()}
    rows = {r["doc_id"]: tuple(r) for r in got.collect()}
    assert len(rows) == documents.count()
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in few) > 5
    for i, text in few.items():
        assert rows[i] == expected(i, text)


def test_edges(spark, edge, empty, tmp_path):
    rows = [r for r in EDGE_ROWS if r[0] != 6]
    many = edge.sparkSession.createDataFrame(rows, edge.schema)
    many.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((expected(r[0], r[1]) for r in rows), key=key)
    assert P.detect(edge).count() == len(EDGE_ROWS)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.QUERIES["op13_periodic_runs"](spark, f"{tmp_path}/none").collect() == []
