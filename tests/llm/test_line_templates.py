import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from xxhash import xxh3_64_intdigest

from runlens.llm import line_templates as L
from runlens.llm import queries

from .conftest import EDGE_ROWS, doc, schema


def templates(line: bytes, p=L.TREE) -> list[bytes]:
    """The templates of a line, its own first; none for a short line."""
    tokens = line.split()
    n = len(tokens)
    if n < p.min_tokens:
        return []
    if re.search(rb"[0-9]", line):
        masked = re.sub(rb"\S*[0-9]\S*", b"<*>", line).split()

        def few(kept: list[bytes]) -> bool:
            constant = sum(t != b"<*>" for t in kept)
            return constant < p.min_constant or 2 * constant < len(kept)

        if few(masked):
            return [b"= " + b" ".join(tokens)]
        tokens = masked
    else:
        def few(kept: list[bytes]) -> bool:
            return False
    out = [b" ".join(tokens)]
    if n >= p.min_open:
        rest = n - p.depth
        a, b = p.depth + rest // 3, p.depth + 2 * rest // 3
        # the borders of the open stretch follow from n, which the key holds
        for k, (lo, hi) in enumerate(((p.depth, a), (a, b), (b, n)), 1):
            if not few(tokens[:lo] + tokens[hi:]):
                out.append(b"%d %d " % (n, k) + b" ".join([*tokens[:lo], b"*", *tokens[hi:]]))
    return out


def plain_records(tokens, p):
    """First token -> words of the chosen stretches, by whole-number loops."""
    m, half = 1 << 64, []
    for i in range(len(tokens) - p.stretch + 1):
        k = sum(xxh3_64_intdigest(t.encode()) * pow(L._BASE, j, m) for j, t in enumerate(tokens[i:i + p.stretch]))
        k = (k + p.stretch * 0xA24BAED4963EE407 + L._STRETCH * 0x9FB21C651E98DF25) % m
        k = (k ^ k >> 32) * 0xD6E8FEB86659FD93 % m
        half.append(k ^ k >> 29)
    chosen = {min(range(i, i + p.spread), key=lambda j: half[j]) for i in range(len(half) - p.spread + 1)}
    return {i: tuple(tokens[i:i + p.stretch]) for i in chosen}


def naive(rows, p=L.TREE):
    """Per row the dropped lines and the tokens left of each other line, by counting in plain dictionaries."""
    big = 1 << 62
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    key = [(big if i is None else i, signed(xxhash.xxh64_intdigest((t or "").encode(), 42))) for i, t in rows]
    words = lambda x: re.findall(r"[^\x20\x09-\x0D]+", x)
    lines = [(t or "").split("\n") for _, t in rows]
    taken = [plain_records(words(t or ""), p) for _, t in rows]
    docs, texts = defaultdict(set), defaultdict(set)
    for i, of in enumerate(lines):
        for line in of:
            made = templates(line.encode(), p)
            for t in made:
                docs[t].add(i)
            if made and len(words(line)) >= p.long_tokens:
                texts[made[0]].add(i)
        for r in taken[i].values():
            texts[r].add(i)

    def passage(t, i):
        first = min(key[j] for j in texts[t]) if t in texts else None
        return first and first[1] != key[i][1]

    def often(t, i):
        return len(docs[t]) >= p.min_docs and key[i] != min(key[j] for j in docs[t])

    out = []
    for i, of in enumerate(lines):
        at = np.cumsum([0] + [len(words(x)) for x in of])
        gone, state = set(), [""] * int(at[-1])
        for k, r in taken[i].items():
            if passage(r, i):
                state[k:k + p.stretch] = ["p"] * p.stretch
        for n, line in enumerate(of):
            made = templates(line.encode(), p)
            if made and made[0] in texts and len(docs[made[0]]) < p.min_docs and passage(made[0], i):
                state[at[n]:at[n + 1]] = ["p"] * len(words(line))
        for n, line in enumerate(of):
            if any(often(t, i) for t in templates(line.encode(), p)):
                gone.add(n)
                state[at[n]:at[n + 1]] = ["l"] * len(words(line))
        runs = sum(1 for k, x in enumerate(state) if x == "p" and (not k or state[k - 1] != "p"))
        if runs > 1 and 2 * state.count("p") > len(state) - state.count("l"):
            state = ["" if x == "p" else x for x in state]
        gone |= {n for n in range(len(of)) if at[n] < at[n + 1] and all(state[at[n]:at[n + 1]])}
        left = [[w for w, x in zip(words(line), state[at[n]:at[n + 1]]) if not x] for n, line in enumerate(of) if n not in gone]
        out.append((sorted(gone), left))
    return out


def tokens_by_line(text):
    return [re.findall(r"[^\x20\x09-\x0D]+", x) for x in (text or "").split("\n")]


def check(df, rows, p=L.TREE):
    got = defaultdict(list)
    for r in L.without_templates(df, p).select("row.doc_id", "row.text", "dropped", "text").collect():
        assert r["dropped"] is not None or r[1] == r[3]
        got[r[0], r[1]].append((r["dropped"] or [], r[3]))
    assert sum(map(len, got.values())) == len(rows)
    for (doc_id, text), (gone, left) in zip(rows, naive(rows, p)):
        for lines, kept in got[doc_id, text]:
            assert lines == gone and (kept is None) == (text is None)
            assert text is None or tokens_by_line(kept) == (left or [[]])


def test_templates():
    short, line = b"a b c 4", b"user 17 logged in from host h9 with key alpha beta gamma delta at 10:33 today"
    assert templates(short) == []
    own, *open_ = templates(line)
    assert own.startswith(b"user <*> logged in from host <*> with") and len(open_) == 3
    other = line.replace(b"alpha beta", b"omega psi")      # one open stretch covers the change
    assert len(set(templates(other)) & set(templates(line))) >= 1
    assert not set(templates(line.replace(b"user", b"root"))) & set(templates(line))  # leading tokens are the path
    assert not set(templates(line + b" x")) & set(templates(line))                    # and the token count


def test_documents_match_brute_force(documents, texts):
    for p in (L.TREE, L.Tree(min_docs=2, min_tokens=3, min_open=6)):
        check(documents.repartition(3), list(texts.items()), p)


def test_planted_and_edges(spark, edge, empty):
    banner = "call 555-{} now to get the very best offers in town before they all are gone"
    rows = [doc(100 + i, f"own words of number{i} here alone\n{banner.format(1000 + i)}\n\n  \nx") for i in range(8)]
    rows += [doc(None, banner.format(7)), doc(105, rows[5][1])] + EDGE_ROWS
    df = spark.createDataFrame(rows, schema()).repartition(4)
    check(df, [r[:2] for r in rows])
    out = {(r["doc_id"], r["n_chars"]): r["text"] for r in L.drop_templates(df).collect()}
    assert any(k[0] == 100 and "555" in t for k, t in out.items())       # the first keeps it
    assert not any(k[0] in range(101, 108) and "555" in t for k, t in out.items())
    assert L.drop_templates(df).columns == df.columns
    assert all(n is None or n == len(t) for (_, n), t in out.items())
    assert L.drop_templates(empty).count() == 0
    assert L.drop_templates(edge).count() == len(EDGE_ROWS)


def test_rows_of_numbers_stay(spark):
    """Rows that differ in their numbers are data; the same row in many documents recurs like any line."""
    wide = " ".join(["{0}{1}"] * 14)
    kinds = ["{0} 3{1} 7 {0}4 1.{1}", "Oslo {0} 3{1} 7 {0}4", "New York City {0} {1} 7 {0}4 {1}5", "a b c {0} {1} 7 8 9 1 2 3 4 5 6", wide]
    rows = [doc(i, "\n".join([k.format(i, 7 * i) for k in kinds] + ["1 2 3 4 5 6"])) for i in range(10)]
    out = {r["doc_id"]: r["text"] for r in L.drop_templates(spark.createDataFrame(rows, schema()).repartition(3)).collect()}
    assert out[0] == rows[0][1]
    assert all(out[i] == rows[i][1].removesuffix("\n1 2 3 4 5 6") for i in range(1, 10))
    assert templates(b"job 17 of host h9 done in 3.5 s") == [b"job <*> of host <*> done in <*> s"]


def test_long_passage_in_few_documents(spark, tmp_path):
    """A passage of 50 words that 2, 3 or 5 documents share stays in the first only; copies of a document stay whole."""
    passage = {k: " ".join(f"{k}{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(50)) for k in "pqr"}
    rows = [doc(10 * n + i, f"own words {n} {i}\n{passage[k]}\nend of {n} {i}") for k, n in zip("pqr", (2, 3, 5)) for i in range(n)]
    short = " ".join(passage["p"].split()[:20])
    rows += [doc(90, f"one {short}"), doc(91, f"one {short}"), doc(92, f"two\none {short}"), doc(None, passage["q"])]
    copy = " ".join(f"c{'abcdefghij'[i % 10]}" for i in range(60))
    rows += [doc(93, copy), doc(94, copy)]
    spark.createDataFrame(rows, schema()).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["dropped_lines"] for r in queries.QUERIES["op6_line_templates"](spark, str(tmp_path)).collect()}
    assert got == {10 * n + i: "1" if i else "" for n in (2, 3, 5) for i in range(n)} | {None: "0", 90: "", 91: "", 92: "", 93: "", 94: ""}


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(7))


def prose(rng, n):
    return [word(rng) for _ in range(n)]


def test_passage_inside_longer_lines(spark):
    """51 words that 2, 3, 5 or 8 documents have inside longer lines, or over a line end, go from all but the first;
    no 50 words in a row remain that an earlier document has. Near copies of a whole text stay for the near-dedup."""
    rng = random.Random(4)
    rows, shared, first = [], {}, {}
    for g, n in enumerate((2, 3, 5, 8)):
        shared[g] = prose(rng, 51)
        if n == 5:
            shared[g].insert(20, "\n")
        for i in range(n):
            text = " ".join(prose(rng, rng.randrange(60, 120)) + shared[g] + prose(rng, rng.randrange(60, 120)))
            rows.append(doc(None if n == 8 and i > 4 else 100 * g + i, f"{word(rng)} own\n{text}\nend {word(rng)}"))
    copied = [prose(rng, 150) for _ in range(3)]
    changed = [[*x[:70], "changed", *x[71:]] for x in copied]
    near = [doc(900, "\n".join(map(" ".join, copied))), doc(901, "\n".join(map(" ".join, changed)))]
    again = doc(902, near[0][1])
    df = spark.createDataFrame(rows + near + [again], schema()).repartition(5)
    check(df, [r[:2] for r in rows + near + [again]])
    out = {r["row"]["text"]: r for r in L.without_templates(df).collect()}
    for r in near:
        assert out[r[1]]["text"] == r[1] and out[r[1]]["dropped"] is None
    for g, passage in shared.items():
        passage = [w for w in passage if w != "\n"]
        mine = [r for r in rows if passage[0] in r[1]]
        whole = [r for r in mine if passage[0] in out[r[1]]["text"] and out[r[1]]["text"] == r[1]]
        assert len(whole) == 1 and (whole[0][0] == 100 * g)
        for r in mine:
            if r is not whole[0]:
                left, own = out[r[1]]["text"].split(), [w for w in r[1].split() if w not in set(passage)]
                assert [w for w in left if w not in set(passage)] == own     # nothing but the passage went
                assert sum(w in set(passage) for w in left) <= 51 - L.TREE.stretch


def records(tokens):
    _, key, kind, place = L.keys_of([b" ".join(tokens)])
    return place[kind == L.RECORD], key[kind == L.RECORD]


def test_records_meet_in_any_fifty_shared_tokens():
    rng = random.Random(8)
    for n in (50, 51, 80):
        for _ in range(30):
            passage = [w.encode() for w in prose(rng, n)]
            a, b = ([w.encode() for w in prose(rng, rng.randrange(40))] + passage + [w.encode() for w in prose(rng, rng.randrange(40))]
                    for _ in range(2))
            assert np.intersect1d(records(a)[1], records(b)[1]).size
    same = [b"tie"] * 500
    assert len(set(records(same)[1].tolist())) == 1 and not records(same[:49])[0].size


def test_keys_are_the_templates(documents, texts):
    """Two lines of the whole fixture share a key exactly if they share a template."""
    lines = sorted({x.encode() for t in texts.values() for x in t.split("\n")} | {b"", b"a", b"1 2 3 4 5", b"x 1 y 2 z 3 and more words of it 4 5"})
    row, key, kind, place = L.keys_of(lines)
    got, want = defaultdict(set), defaultdict(set)
    for r, k, kd in zip(row.tolist(), key.tolist(), kind.tolist()):
        if kd != L.RECORD:
            got[k].add(r)
    for i, line in enumerate(lines):
        for t in templates(line):
            want[t].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and not place[kind != L.RECORD].any()
    empty = L.keys_of([])
    assert all(len(x) == 0 for x in empty)
