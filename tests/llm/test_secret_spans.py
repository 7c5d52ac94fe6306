import hashlib
import re
import zlib
from collections import Counter

from runlens.llm import secret_spans as S

from .conftest import EDGE_ROWS, doc, schema

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def base62(n):
    d = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    return "".join(d[n // 62 ** i % 62] for i in range(5, -1, -1))


BODY = "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7cF0"
GOOD = BODY + base62(zlib.crc32(BODY.encode()))
PLANTED = [
    "PassWord = 'hunter22'", "api_key:abcdef APIKEY=\"abc123.4\"", "token: token=token=abcdefg secret=ab secret = abcdef",
    "tokentoken=aaaaaa", "passwd:  \x20 x/y+z==", "ſecret=abcdef toKen=abcdef",  # long s and Kelvin sign are no ASCII letters
    "AKIA" + "A" * 16 + " AKIA" + "B" * 15 + " AKIAAKIA" + "0" * 20, "é" * 9 + "deadbeef" * 3 + "g" + "0" * 23, "0" * 100,
    f"ghp_{GOOD} ghp_{BODY}000000 npm_{GOOD} x ghp_{GOOD}z", f"token=ghp_{GOOD}", "pässword=é token=\n=abcdef", "secret" * 2000,
]


def test_spans_match_a_plain_search(texts):
    for text in PLANTED + list(texts.values()):
        raw = text.encode()
        got = S.in_code_points(raw, S.spans(raw))
        assert [x for x in got if x[2] in S.KINDS[:3]] == base(text)
        assert got == sorted(got, key=lambda x: (x[0], S.KINDS.index(x[2])))


def test_checksums_decide():
    raw = PLANTED[9].encode()
    assert [(raw[s:e].decode(), k) for s, e, k in S.spans(raw) if k in ("github", "npm")] == [
        (f"ghp_{GOOD}", "github"), (f"npm_{GOOD}", "npm")]
    assert [k for _, _, k in S.spans(PLANTED[10].encode())] == ["assign", "github"]


def test_digests(spark, edge, empty):
    rows = [doc(100 + i, t) for i, t in enumerate(PLANTED)] + EDGE_ROWS
    got = S.digests(S.scan(spark.createDataFrame(rows, schema()).repartition(3))).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    by = {r["doc_id"]: r for r in got}
    for i, text in enumerate(PLANTED):
        want, r = base(text), by[100 + i]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[2] == k for x in want) for k in S.KINDS[:3]]
    assert by[1]["spans"] == "" and S.digests(S.scan(empty)).count() == 0
