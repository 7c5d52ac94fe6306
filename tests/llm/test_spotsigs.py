import hashlib

import pytest

from runlens.llm import spotsigs as S

from .conftest import doc, schema


def naive(text):
    """Signatures by the rule, word by word: tuples of anchor and chain."""
    words = S.folded((text or "").encode())
    common = set(S.WORDS)
    content = [i for i, w in enumerate(words) if w not in common]
    out, since = set(), 0
    for i, w in enumerate(words):
        if w in common:
            since = 0
        else:
            since += 1
            if since <= S.SPOTS.gap:
                continue
        chain = [words[j] for j in content if j > i][:S.SPOTS.chain]
        if len(chain) == S.SPOTS.chain:
            out.add((w, *chain))
    return out or {text or ""}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_signatures_are_those_of_the_rule(texts):
    some = [t for t in list(texts.values())[:60]] + ["", "one", "the the the", "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2]
    for t in some:
        assert len(S.signatures(t.encode())) == len(naive(t))
    a, b = some[0], some[0][:len(some[0]) // 2] + some[1]
    assert S.likeness(S.signatures(a.encode()), S.signatures(b.encode())) == pytest.approx(jaccard(naive(a), naive(b)))


@pytest.mark.parametrize("range_bytes", [4 << 20, 20_000])
def test_next_and_edited(documents, texts, range_bytes):
    got = {r["doc_id"]: r for r in S.with_next(documents.repartition(4), S.Spots(range_bytes=range_bytes)).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    for i, doc_id in enumerate(ids):
        a, b = texts[doc_id], texts[ids[(i + 1) % len(ids)]]
        half = len(a) // 2
        edited = a[:len(a) - half] + b[:half]
        r = got[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(jaccard(naive(a), naive(edited)))
        assert r["near_next"] == pytest.approx(jaccard(naive(a), naive(b)))
        assert r["fingerprint"] == S.digest(S.signatures(a.encode()))


def test_edges(edge, empty, spark):
    got = S.with_next(edge, S.Spots(range_bytes=1000)).collect()
    assert len(got) == edge.count()
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["n_chars"] == 0 and by[1][0]["near_next"] == 1  # null and empty text are equal
    assert [r["near_next"] for r in by[None]] == [1, 1]             # without an id: its own successor
    assert by[4][0]["near_next"] == 1 and by[4][0]["fingerprint"] == by[5][0]["fingerprint"]
    assert S.with_next(empty).count() == 0
    one = S.with_next(spark.createDataFrame([doc(1, "the cat sat")], schema())).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"the ca" + b"the c").hexdigest()


def test_near_pairs_match_all_pairs(spark, texts):
    rows = [doc(i, t) for i, t in texts.items()]
    rows += [doc(10_000 + i, t + " and one more line of words") for i, t in list(texts.items())[:40]]
    df = spark.createDataFrame(rows, schema()).repartition(3)
    members, pairs = S.near_pairs(df)
    prints = {r["doc_id"]: r["fingerprint"] for r in members.collect()}
    sets = {prints[r[0]]: set(S.signatures(r[1].encode()).tolist()) for r in rows}
    names = sorted(sets)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1:] if jaccard(sets[a], sets[b]) >= 0.8}
    got = {(r["a"], r["b"]): r["likeness"] for r in pairs.collect()}
    assert set(got) == want and len(want) > 10
    assert all(v == pytest.approx(jaccard(sets[a], sets[b])) for (a, b), v in got.items())
