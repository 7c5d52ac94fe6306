import math
import re
import tracemalloc
from collections import Counter, defaultdict
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runlens.llm import quality
from runlens.llm.words import WORDS, folded

from .conftest import EDGE_ROWS, doc, schema


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in lines
            lines.add(x)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_figures(documents, edge, texts):
    for df in (documents, edge):
        for r in quality.judge(df).select("row.text", *FIELDS, "kept").collect():
            assert tuple(r[f] for f in FIELDS) == base(r["text"])
            assert not (r["base_failed"] and r["kept"])
    assert quality.judge(edge).count() == len(EDGE_ROWS)


def test_distance():
    rng = np.random.default_rng(1)
    p, q = rng.dirichlet([0.4] * 9, 20), rng.dirichlet([0.4] * 9, 20)
    got = quality.distance(p, q)
    for a, b, d in zip(p, q, got):
        m = (a + b) / 2
        kl = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m) if v > 0)
        assert d == pytest.approx(np.sqrt((kl(a) + kl(b)) / 2))
    assert quality.distance(np.array([[1.0, 0]]), np.array([[0, 1.0]]))[0] == 1
    assert quality.distance(p, p).max() < 1e-7


def test_histograms_and_folding():
    assert folded("Été, THE-cat's\tÊTRE".encode()) == ["été".encode(), b"the", b"cat", b"s", "être".encode()]
    chars, words = quality.histograms([b"Ab 1.\n#", "é你😀π".encode(), b""])
    assert chars.tolist() == [[1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 1], [0] * 7 + [1, 1, 1, 1, 0], [0] * 12]  # the last: marks alone
    _, words = quality.histograms([b"The dog, the cat"])
    assert words[0, WORDS.index(b"the")] == 2 and words[0, -1] == 2


def test_junk_goes_and_prose_stays(spark, documents):
    """Symbols in every word of a text of a known language are rejected; the text itself is kept."""
    good = [r for r in documents.where("lang = 'en' and length(text) between 1500 and 4000").collect()
            if not base(r["text"])[5] and base(r["text"])[2] == 0 and " | " not in r["text"]][:15]
    junk = [doc(10_000 + r["doc_id"], " ".join(w + "%%#" for w in r["text"].split())) for r in good]
    df = documents.select("doc_id", "text", "lang").union(spark.createDataFrame(junk, schema()).select("doc_id", "text", "lang"))
    kept = {r["doc_id"] for r in quality.keep(df).collect()}
    assert {r["doc_id"] for r in good} <= kept
    assert not kept & {r[0] for r in junk}


def test_references_are_whole_corpus_means(documents, texts):
    ref = {r["lang"]: r for r in quality.references(documents.repartition(4)).collect()}
    langs = documents.select("doc_id", "lang").collect()
    for lang, r in ref.items():
        mine = [texts[x["doc_id"]].encode() for x in langs if x["lang"] == lang]
        chars, words = quality.histograms(mine)
        assert r["n_chars_docs"] == len(mine)
        assert r["chars"] == pytest.approx(quality._shares(chars).mean(axis=0), abs=2e-6)
        assert r["words"] == pytest.approx(quality._shares(words).mean(axis=0), abs=2e-6)


def class_of(word, c):
    """Character class of ``c``; word: the word it stands in, or none."""
    if word and not re.search(r"[0-9A-Za-z\x80-\U0010FFFF]", word):
        return 11
    o = ord(c)
    if o >= 128:
        return 7 if 0x80 <= o < 0x280 else 8 if o < 0x800 else 9 if o < 0x10000 else 10
    for chars, k in ((" ", 0), (r"[a-z]", 2), (r"[A-Z]", 3), (r"[0-9]", 4), (r"[.,;:!?'\"()-]", 5), (r"[!-~]", 6)):
        if re.fullmatch(chars, c):
            return k
    return 1


def shares(keys):
    n = Counter(keys)
    return {k: v / n.total() for k, v in n.items()}


def divergence(p, q):
    total = 0.0
    for x in (p, q):
        for k, v in x.items():
            if v > 0:
                total += v * math.log2(v / ((p.get(k, 0) + q.get(k, 0)) / 2))
    return math.sqrt(max(total, 0) / 2)


def mean(all_shares):
    out = Counter()
    for x in all_shares:
        for k, v in x.items():
            out[k] += v / len(all_shares)
    return out


def merged(p):
    out = Counter()
    for k, v in p.items():
        out["script" if k in (0, 2, 3, 7, 8, 9, 10) else k] += v
    return out


def plain_verdicts(rows, rules=quality.RULES):
    """(row number) -> kept, margin: by plain loops over (text, lang); margin: how far the nearest limit is."""
    figures = []
    for text, lang in rows:
        text = text or ""
        kinds = [class_of(part if not part[0] in " \t\n\v\f\r" else "", c)
                 for part in re.findall(r"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text) for c in part]
        words = [w if w in WORDS_SET else None for w in folded(text.encode())]
        figures.append((lang, {"char": (len(kinds), shares(kinds)), "word": (len(words), shares(words))}))
    wanted = {"char": rules.min_chars, "word": rules.min_sample_words}
    ref, many = {}, {}
    for kind in wanted:
        for lang in {x[1] for x in rows}:
            of = [f[kind][1] for k, f in figures if k == lang and f[kind][0]]
            ref[kind, lang], many[kind, lang] = mean(of), len(of)
    pooled = mean([f["char"][1] for _, f in figures if f["char"][0]])
    d, spread = {}, defaultdict(list)
    for i, (lang, f) in enumerate(figures):
        for kind, least in wanted.items():
            n, p = f[kind]
            own = many[kind, lang] >= rules.min_reference_docs
            if n < least or not own and kind == "word":
                continue
            d[i, kind] = divergence(p, ref[kind, lang]) if own else divergence(merged(p), merged(pooled))
            if own:
                spread[kind, int(2 * math.log2(n))].append(d[i, kind])
    out = []
    for i, (lang, f) in enumerate(figures):
        bad, margin = base(rows[i][0])[5], 1.0
        for kind in wanted:
            if (i, kind) not in d:
                continue
            n = f[kind][0]
            limit = getattr(rules, f"{kind}_limit") + getattr(rules, f"{kind}_noise") / math.sqrt(n)
            if many[kind, lang] >= rules.min_reference_docs:
                like = sorted(spread[kind, int(2 * math.log2(n))])
                low, high = (like[math.ceil(q * len(like)) - 1] for q in (0.25, 0.75))
                fence = min(limit, high + getattr(rules, f"{kind}_fence") * (high - low))
                limit = (len(like) * fence + rules.prior_docs * limit) / (len(like) + rules.prior_docs)
            bad |= d[i, kind] > limit
            margin = min(margin, abs(d[i, kind] - limit))
        out.append((not bad, margin))
    return out


WORDS_SET = set(WORDS)


def test_verdicts_against_plain_loops(spark, sf, documents):
    """``kept`` against plain loops; distances are counted in steps of 1/2,000, so a document nearer to its limit may differ."""
    few = [doc(20_000 + i, t, "xx") for i, t in enumerate(
        [r["text"] for r in documents.limit(3).collect()] + [" ".join(["word", "|", "$$"] * 100 + [str(i) for i in range(300)])])]
    few += [doc(30_000, None), doc(30_001, ""), doc(30_002, "| " * 300), doc(30_003, "a b " * 20)]
    df = documents.select("doc_id", "text", "lang").union(spark.createDataFrame(few, schema()).select("doc_id", "text", "lang"))
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in df.collect()]
    want = dict(zip([r[0] for r in rows], plain_verdicts([r[1:] for r in rows])))
    got = {r["doc_id"]: r["kept"] for r in quality.judge(df.repartition(5)).select("row.doc_id", "kept").collect()}
    sure = {i for i, (_, margin) in want.items() if margin > 0.003}
    assert len(sure) > 0.9 * len(want) and all(got[i] == want[i][0] for i in sure)
    assert not got[20_003] and sum(got[20_000 + i] for i in range(3)) >= 2  # a language of four documents is judged


def test_labelled_junk(spark):
    """Of labelled junk that the base rule leaves at most a tenth stays, of clean documents 99 in a hundred."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    r = quality.judge(docs).where("not base_failed").select("row.doc_id", "kept").join(labels, "doc_id")
    share = {x["quality"]: x["k"] for x in r.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[0] <= 0.10 and share[1] >= 0.99


def test_guards_and_empty(spark, edge, empty):
    assert quality.judge(empty).count() == 0
    few = quality.judge(edge).select("row.doc_id", "n_words", "char_distance", "word_distance").collect()
    assert all(r["word_distance"] is None for r in few)  # too few documents for a reference of the language
    assert {r["doc_id"] for r in few if r["char_distance"] is not None} == {6, 7, 10, 11}  # 200 code points or more
    out = quality.keep(edge)
    assert out.columns == edge.columns


def test_memory_of_a_worker(spark, documents):
    """A batch of 16 MB of text takes few times that in a Python worker, and carries each text once."""
    text = "the quick brown fox jumps over the lazy dog | " * 44
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 8_000, "text": [text] * 8_000})
    docs = MagicMock()
    quality.references(docs)
    step = docs.select.return_value.mapInArrow.call_args[0][0]
    tracemalloc.start()
    try:
        assert len(list(step(iter([batch])))) == 1
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()
    plan = quality.judge(documents)._jdf.queryExecution().optimizedPlan()
    assert plan.child().output().length() == 1 + 5  # the row and the reference's columns
