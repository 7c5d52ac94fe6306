from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from runlens.llm import token_attribution as A

from .conftest import EDGE_ROWS

ODD = ["", "\n\n\n", "a\n \n  b\n", "π你好😀\n😀\r\n x", "'s it's\n's", "x" * 3000, " lead", "tail \n", "a\n\n\n\nb", "\x1c\x85 \xa0y"]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def naive(tokenizer, text, sections):
    out = [0] * len(sections)
    for s, e in tokenizer.encode(text, add_special_tokens=False).offsets:
        over = [min(e, b) - max(s, a) for a, b in sections]
        if max(over) > 0:
            out[over.index(max(over))] += 1
        else:
            out[max([k for k, (a, _) in enumerate(sections) if a < e] or [0])] += 1
    return out


def test_lines_match_the_tokenizers_offsets(tokenizer, documents, texts, edge):
    for df, rows in ((documents, texts.items()), (edge, [r[:2] for r in EDGE_ROWS])):
        got, totals = defaultdict(list), {}
        for r in A.attribute(df).collect():
            got[r["doc_id"]].append((r["section"], r["start"], r["n_chars"], r["n_tokens"]))
            totals[r["doc_id"]] = r["doc_tokens"]
        seen = defaultdict(int)
        for doc_id, _ in rows:
            seen[doc_id] += 1
        for doc_id, text in rows:
            if seen[doc_id] > 1:
                continue
            text = text or ""
            sections = A.lines(text)
            mine = sorted(got[doc_id])
            assert [(s, s + n) for _, s, n, _ in mine] == sections
            assert [m[3] for m in mine] == naive(tokenizer, text, sections)
            assert sum(m[3] for m in mine) == totals[doc_id]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_and_cuts_inside_words(tokenizer, text):
    thirds = [(0, len(text) // 3), (len(text) // 3, 2 * len(text) // 3), (2 * len(text) // 3, len(text))]
    for sections in (A.lines(text), thirds):
        raw = text.encode()
        got = A.attributed(*A.spans(text, raw, A.token_sizes(text)), sections)
        assert got.tolist() == naive(tokenizer, text, sections)


def test_border_rule():
    import numpy as np
    #        0-4 crosses 3: most in the first; 4-8 even between 3-6 and 6-9: the first; 9-10 in a gap
    got = A.attributed(np.array([0, 4, 9, 12]), np.array([4, 8, 10, 13]), [(0, 3), (3, 6), (6, 9), (11, 14)])
    assert got.tolist() == [1, 1, 1, 1]


def test_empty(empty):
    assert A.attribute(empty).count() == 0
