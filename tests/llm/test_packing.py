import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from runlens.llm import packing
from runlens.llm.encoding import encoder, word_tokenizer

from .conftest import EDGE_ROWS


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(word_tokenizer())
    t.encode_special_tokens = True
    return t


ODD = ["", "Ünïcödé ﬁ É´s it's IT'S ''s", "\x1c a\x85b \xa0c Ⅷ ½² İstanbul ΣΑΣ 你好,世界", "<|startoftext|>x <|endoftext|>",
       "é é x Å", "'LL 'D don''t #'s !!! 123 a1b2 _x_ Ãß ''t", "a" * 5000, "   ﻿"]


def test_ids_are_the_tokenizers(tokenizer, texts):
    encode = encoder(word_tokenizer())
    for text in ODD + list(texts.values()):
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def expected(tokenizer, rows, seq_len):
    out = Counter()
    for doc_id, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), seq_len)):
            part = ids[at:at + seq_len]
            out[doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    return out


@pytest.mark.parametrize("seq_len", [4096, 64])
def test_pieces_and_places(tokenizer, documents, texts, edge, seq_len):
    p = packing.Packing(seq_len=seq_len)
    for df, rows in ((documents.repartition(5), texts.items()), (edge, [r[:2] for r in EDGE_ROWS])):
        got = packing.pack(df, p).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected(tokenizer, rows, seq_len)
        rooms = defaultdict(list)
        for r in got:
            rooms[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in rooms.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= seq_len
        bound = -(-sum(r["length"] for r in got) // seq_len)
        assert len(rooms) <= bound * 1.02 + 2


def test_ids_travel_with_their_pieces(tokenizer, edge):
    for r in packing.pack(edge, packing.Packing(seq_len=128), with_ids=True).where("doc_id = 8").collect():
        ids = tokenizer.encode(dict(x[:2] for x in EDGE_ROWS)[8], add_special_tokens=False).ids + [1]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["start"]:r["start"] + r["length"]]


@pytest.mark.parametrize("seed", range(8))
def test_plan_covers_the_histogram(seed):
    rng = np.random.default_rng(seed)
    L = int(rng.choice([16, 100, 512]))
    h = {int(s): int(rng.integers(1, 400)) for s in rng.choice(np.arange(1, L + 1), int(rng.integers(1, L // 2)), replace=False)}
    configs = packing.plan(h, packing.Packing(seq_len=L))
    got = Counter()
    for c, n in configs:
        assert 0 < sum(s * k for s, k in c.items()) <= L
        for s, k in c.items():
            got[s] += k * n
    assert got == Counter(h)
    used = sum(n for _, n in configs)
    assert used <= sum(n for _, n in packing._best_fit(dict(h), L))  # never more than best-fit-decreasing alone
    t = packing.runs(configs)
    for s in h:  # runs of a length are gapless from 0
        lo = t["lo"][t["length"] == s]
        assert lo[0] == 0 and (np.diff(lo) > 0).all()


def test_program_packs_most_of_a_large_histogram():
    rng = np.random.default_rng(0)
    h = Counter(np.clip(rng.lognormal(6, 1, 20_000).astype(int), 1, 4096).tolist())
    configs = packing.plan(dict(h))
    bound = -(-sum(s * n for s, n in h.items()) // 4096)
    assert sum(n for _, n in configs) <= bound + 3


def test_empty(empty):
    assert packing.pack(empty).count() == 0
    assert packing.plan({}) == []
