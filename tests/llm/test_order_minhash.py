import random
from collections import defaultdict

import numpy as np
import pytest

from runlens.llm import components as C
from runlens.llm import order_minhash as O

from .conftest import EDGE_ROWS, doc, schema


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute(rows, p=O.SKETCHING):
    """Class (least id) of each id, from all pairs of different texts."""
    texts = sorted({t or "" for _, t in rows})
    x = [O.kmers(t.encode(), p) for t in texts]
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [set(k.tolist()) for k in x]
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * max(len(sets[i]), len(sets[j])) * 0.9 and sets[i] and \
                    O.similarity(x[i], x[j], p.at_least) >= p.at_least - 1e-9:
                up[top(i)] = top(j)
    at = {t: top(i) for i, t in enumerate(texts)}
    least = defaultdict(lambda: None)
    for i, t in rows:
        k = at[t or ""]
        if i is not None and (least[k] is None or i < least[k]):
            least[k] = i
    return {(i, t): least[at[t or ""]] for i, t in rows}


def check(df, rows):
    got = defaultdict(set)
    for r in df.select("doc_id", "text").distinct().collect():
        got[r["doc_id"]].add(r["text"])
    out = O.classes(df).collect()
    assert len(out) == len(rows)
    want = brute(rows)
    by_id = defaultdict(set)
    for (i, _), c in want.items():
        by_id[i].add(c)
    for r in out:
        assert r["class_id"] in by_id[r["doc_id"]]


def edited(rng, text, share):
    w = text.split()
    for _ in range(max(1, int(share * len(w)))):
        i = rng.randrange(len(w))
        kind = rng.random()
        if kind < 0.4:
            w[i] = f"new{rng.randrange(10**6)}"
        elif kind < 0.7:
            w.insert(i, f"more{rng.randrange(10**6)}")
        elif len(w) > 8:
            del w[i]
    return " ".join(w)


@pytest.mark.parametrize("seed", range(20))
def test_alignment_against_plain_lcs(seed):
    rng = random.Random(seed)
    a = " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))
    b = edited(rng, a, rng.choice([0.02, 0.1, 0.5])) if a and rng.random() < 0.8 else a
    x, y = O.kmers(a.encode()), O.kmers(b.encode())
    assert len(set(x.tolist())) == len(x)            # occurrence labels make them distinct
    m = lcs(x.tolist(), y.tolist())
    want = m / (len(x) + len(y) - m) if len(x) + len(y) else 1.0
    assert O.similarity(x, y, 0.0) == pytest.approx(want)
    got = O.similarity(x, y, 0.8)
    assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def test_sketch_picks_the_least_in_text_order():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 2 ** 63, (40, 300)).astype(np.uint64) * np.uint64(2)
    assert (O._least(v, 6) == np.sort(np.argsort(v, axis=1)[:, :6], axis=1)).all()
    v[:, 7:] = np.uint64(2 ** 64 - 1)                # ties beyond the bound fall back to a full selection
    assert (O._least(v, 6) < 7).all()
    x = rng.integers(0, 2 ** 63, 500).astype(np.uint64)
    assert (O.sketch(x) == O.sketch(x)).all() and (O.sketch(x) != O.sketch(x[::-1])).mean() > 0.9  # order counts


def test_collision_rate_follows_similarity():
    rng = random.Random(3)
    hits = 0
    for i in range(60):
        a = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
        b = edited(rng, a, 0.01)
        x, y = O.kmers(a.encode()), O.kmers(b.encode())
        if O.similarity(x, y, 0.8) >= 0.8:
            hits += 1
            assert (O.sketch(x) == O.sketch(y)).any()
    assert hits > 40


def test_documents_match_brute_force(documents, texts):
    rng = random.Random(1)
    rows = list(texts.items())
    rows += [(1000 + 50 * k + i, edited(rng, texts[k], 0.012)) for k in range(6) for i in range(12)]  # groups of near copies
    rows += [(5000 + i, texts[i % 7]) for i in range(40)]                                             # exact copies
    df = documents.sparkSession.createDataFrame([doc(*r) for r in rows], schema()).repartition(4)
    check(df, rows)


def test_chain_of_texts_is_one_class(spark):
    """Each text is near its neighbours only; the class needs links that no single drawn text has."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[5 * i:5 * i + 100])) for i in range(40)]
    df = spark.createDataFrame([doc(*r) for r in rows], schema())
    assert {r["class_id"] for r in O.classes(df).collect()} == {0}
    assert O.one_each(df).count() == 1


def test_edges(spark, edge, empty):
    check(edge, [r[:2] for r in EDGE_ROWS])
    out = O.one_each(edge)
    assert out.columns == edge.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(kept) == len(set(kept)) and {1, 3, 4, 6, 7, 8, 10} <= {k[0] for k in kept}
    assert not {2, 5, 11} & {k[0] for k in kept}
    assert O.classes(empty).count() == 0 and O.one_each(empty).count() == 0


def test_short_texts_against_brute_force(spark):
    """All pairs of few k-mers that the contract calls near share a key, and are one class: 8 and 9 words, 9 and 10."""
    rng = random.Random(5)
    near = 0
    for words in range(5, 23):
        for _ in range(40):
            a = [f"w{rng.randrange(10**6)}" for _ in range(words)]
            b = list(a)
            for _ in range(rng.choice([1, 1, 2])):
                at = rng.choice([0, len(b), rng.randrange(len(b))])
                b = b[:at] + ["new"] + b[at:] if rng.random() < 0.6 else b[:at] + b[at + 1:]
            x, y = O.kmers(" ".join(a).encode()), O.kmers(" ".join(b).encode())
            if len(x) and len(y) and O.similarity(x, y, 0.8) >= 0.8 - 1e-9:
                near += 1
                assert np.intersect1d(O.bucket_keys(x), O.bucket_keys(y)).size, (a, b)
    assert near > 100
    text = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, text("a", 8)), (2, text("a", 9)), (3, text("b", 9)), (4, text("b", 10)), (5, "x " + text("c", 8)),
            (6, text("c", 8)), (7, text("d", 7)), (8, text("d", 8)), (9, text("e", 13)), (10, "x " + text("e", 12))]
    df = spark.createDataFrame([doc(*r) for r in rows], schema())
    got = {r["doc_id"]: r["class_id"] for r in O.classes(df).collect()}
    assert got == {i: c for (i, _), c in brute(rows).items()}
    assert got[2] == 1 and got[4] == 3 and got[6] == 5 and got[8] == 8


def test_classes_without_an_id_of_their_own(spark):
    """Unlike texts with null ids, or with one id, are classes of their own: none may take another with it."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [doc(None, a), doc(None, a), doc(None, b), doc(7, c), doc(7, d), doc(8, d + " more"), doc(None, c)]
    df = spark.createDataFrame(rows, schema()).repartition(3)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in O.one_each(df).collect()) == [(0, a), (0, b), (7, c), (7, d)]
    label = {(r["doc_id"], r["tid"]): r["label"] for r in O.classes(df).collect()}
    assert len(label) == 6 and len(set(label.values())) == 4


def test_components(spark):
    rng = random.Random(0)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)]
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r["node"]: r["label"] for r in C.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {i for a, b in pairs if a != b for i in (a, b)}
    assert got == {i: top(i) for i in linked}


@pytest.mark.parametrize("seed", range(20))
def test_counts_rule_out_no_near_pair(seed):
    """The bound from counts is never below the similarity, whatever the lengths; it rules out texts that differ."""
    rng = random.Random(seed)
    ruled_out = 0
    for _ in range(30):
        words = rng.choice([3, 8, 60, 63, 64, 70, 130, 150, 300, 600])
        a = " ".join(rng.choice([f"w{rng.randrange(40)}", f"w{rng.randrange(10**6)}"]) for _ in range(words))
        x, y = O.kmers(a.encode()), O.kmers(edited(rng, a, rng.choice([0.005, 0.01, 0.03, 0.06])).encode())
        may = O.may_be_near(O.counts(x), O.counts(y), len(x), len(y), 0.8)
        assert may or O.similarity(x, y, 0.8) < 0.8
        assert may == O.may_be_near(O.counts(y), O.counts(x), len(y), len(x), 0.8)
        ruled_out += not may
    assert ruled_out
    full = np.arange(400, dtype=np.uint64) << np.uint64(20)  # all in one place, more than a byte counts
    assert O.may_be_near(O.counts(full), O.counts(full), 400, 400, 0.8)


def test_kmers_are_fetched_for_few_pairs(spark, monkeypatch):
    """Texts that share many words and sketches but are not near are ruled out before their k-mers are joined to them."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in range(5 + i % 3, 150, 25):
            w[at] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join([*base[:149], f"end{i}"])) for i in range(20)]
    made = defaultdict(int)
    plain = O.staged

    def counted(df, name):
        out = plain(df, name)
        made[name] += out.count()
        return out
    monkeypatch.setattr(O, "staged", counted)
    check(spark.createDataFrame([doc(*r) for r in rows], schema()), rows)
    assert made["omh-pairs"] > 500 and made["omh-may"] < made["omh-pairs"] / 3


def test_texts_that_share_a_template_are_not_all_compared(spark, monkeypatch):
    """Texts at about 0.65 by a common passage: pairs grow with the texts, not with their square, and near ones are found."""
    rng = random.Random(9)
    own = lambda i, n: [f"own{i}x{k}" for k in range(n)]
    template = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(template + own(i, 20))) for i in range(300)]
    rows += [(1000 + i, " ".join(template + own(i, 18) + ["end"])) for i in range(0, 300, 10)]  # near one of the others only
    made = defaultdict(int)
    plain = O.staged

    def counted(df, name):
        out = plain(df, name)
        made[name] += out.count()
        return out
    monkeypatch.setattr(O, "staged", counted)
    rng.shuffle(rows)
    check(spark.createDataFrame([doc(*r) for r in rows], schema()), rows)
    assert made["omh-pairs"] < 330 * 329 / 2 / 3


def test_rarest_kmers_miss_no_near_pair(spark):
    """Near texts of two classes share a bucket in which both have room for what they have in common."""
    rng = random.Random(10)
    texts = []
    for words in [5, 6, 9, 10, 20, 40, 80, 150]:
        for _ in range(6):
            a = " ".join(rng.choice([f"w{rng.randrange(30)}", f"w{rng.randrange(10**6)}"]) for _ in range(words))
            texts += [a, edited(rng, a, 0.005), edited(rng, a, 0.01), edited(rng, a, 0.03), a + " more", "less " * (words // 30) + a]
    texts = list(dict.fromkeys(texts))
    x = [O.kmers(t.encode()) for t in texts]
    seq = spark.createDataFrame([(i, k.view(np.int64).tolist(), len(k)) for i, k in enumerate(x)], "tid long, kmers array<long>, n int")
    label = [i - i % 3 if i % 2 else i for i in range(len(texts))]
    live = spark.createDataFrame([(0, i, 1, label[i], 0, 0) for i in range(len(x))], "key long, tid long, weight long, label long, n int, room int")
    at = defaultdict(dict)
    for r in O.by_rarest(live, seq).collect():
        at[r["tid"]][r["key"]] = (r["n"], r["room"], r["label"])
    near = 0
    for i in range(len(x)):
        for j in range(i):
            if label[i] != label[j] and O.similarity(x[i], x[j], 0.8) >= 0.8 - 1e-9:
                near += 1
                both = [(at[i][k], at[j][k]) for k in at[i].keys() & at[j].keys()]
                assert any(min(a[1], b[1]) * 9 >= 4 * (a[0] + b[0]) and max(9 * a[1] - 8 * a[0], 9 * b[1] - 8 * b[0]) >= 0 for a, b in both), (texts[i], texts[j])
    assert near > 100
