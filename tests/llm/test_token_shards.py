import random
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from runlens.llm import token_shards as T
from runlens.llm.encoding import word_tokenizer

from .conftest import EDGE_ROWS
from .test_packing import expected


def test_best_fit_decreasing_matches_a_plain_search():
    rng = random.Random(1)
    for _ in range(200):
        most = rng.choice([7, 8, 63, 64])
        sizes = [rng.randint(1, most) for _ in range(rng.randint(0, 60))]
        plain = []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            room = lambda b: most - sum(sizes[j] for j in b)
            fits = [b for b in plain if room(b) >= sizes[i]]
            min(fits, key=room).append(i) if fits else plain.append([i])
        got = T.best_fit_decreasing(sizes, most)
        assert len(got) == len(plain) and sorted(i for b in got for i in b) == list(range(len(sizes)))
        assert sorted(sum(sizes[i] for i in b) for b in got) == sorted(sum(sizes[i] for i in b) for b in plain)


def test_round_trip(documents, texts, edge):
    t = Tokenizer.from_file(word_tokenizer())
    t.encode_special_tokens = True
    for p in (T.SHARDS, T.Shards(seq_len=128, group_tokens=5000, id_bytes=4)):
        for df, rows in ((documents.repartition(3), texts.items()), (edge, [r[:2] for r in EDGE_ROWS])):
            shards = T.write(df, p)
            got = T.segments(shards, p).collect()
            assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected(t, rows, p.seq_len)
            rooms = defaultdict(list)
            for r in got:
                rooms[r["shard"], r["row"]].append((r["offset"], r["length"]))
            for places in rooms.values():
                at = 0
                for offset, length in sorted(places):
                    assert offset == at
                    at += length
                assert at <= p.seq_len


def test_binary_layout(documents):
    p = T.Shards(seq_len=256, group_tokens=20_000)
    s = T.write(documents.limit(30), p).first()
    ids = np.frombuffer(s["ids"], "<u2").reshape(s["n_rows"], 256)
    per_row, cu, resets = (np.frombuffer(s[c], "<i4") for c in ("segments", "cu_seqlens", "resets"))
    assert len(cu) == per_row.sum() + s["n_rows"] and len(resets) == per_row.sum() == len(s["doc_ids"])
    at = seg = 0
    for row, n in enumerate(per_row):
        ends = cu[at:at + n + 1]
        assert ends[0] == 0 and (np.diff(ends) > 0).all() and (resets[seg:seg + n] == ends[:-1]).all()
        assert (ids[row, ends[-1]:] == p.pad_id).all()
        positions = T.position_ids(resets[seg:seg + n], 256)
        assert all((positions[a:b] == np.arange(b - a)).all() for a, b in zip(ends, ends[1:]))
        at, seg = at + n + 1, seg + n


def test_empty(empty):
    assert T.segments(T.write(empty)).count() == 0
