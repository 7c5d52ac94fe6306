"""Each stage against a plain version of its rule, on what the stage before kept."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from runlens.llm import line_templates, packing
from runlens.llm.common import staged

from .conftest import EDGE_ROWS, doc, schema
from .test_line_templates import naive as naive_lines
from .test_line_templates import tokens_by_line
from .test_order_minhash import brute, edited
from .test_quality import base


@pytest.fixture(scope="module")
def kept(spark, sf, documents, texts):
    """Rows after each stage, begun from the documents and some planted copies."""
    rng = random.Random(2)
    first = documents.first()
    lang = {r["doc_id"]: r["lang"] for r in documents.collect()}
    more = [(2000 + i, edited(rng, texts[i], 0.01), lang[i], "src1", None) for i in range(20)] + \
           [(3000 + i, texts[i], lang[i], "src1", None) for i in range(20)]
    docs = documents.select(*first.asDict()).union(spark.createDataFrame(more, documents.schema)).repartition(4)
    out = [("documents", docs.collect())]
    for name, stage in P.STAGES:
        docs = staged(stage(spark, docs, sf), f"test-{name}")
        out.append((name, docs.collect()))
    return dict(out)


def test_quality_rules(kept):
    before, after = Counter(kept["documents"]), Counter(kept["quality_rules"])
    assert not after - before                            # rows are kept as they are
    for r in before - after:
        text = r["text"]
        prose = not base(text)[5] and base(text)[2] * 10 < base(text)[0] and text.count(" | ") * 10 < base(text)[0]
        assert not prose or r["lang"] != "en", text[:200]  # clean documents stay
    assert all(not base(r["text"])[5] for r in after)


def test_line_dedup(kept):
    rows = [(r["doc_id"], r["text"]) for r in kept["quality_rules"]]
    want = Counter()
    for (doc_id, text), (_, left) in zip(rows, naive_lines(rows, line_templates.TREE)):
        if any(left):
            want[doc_id, tuple(map(tuple, left))] += 1
    assert Counter((r["doc_id"], tuple(map(tuple, tokens_by_line(r["text"])))) for r in kept["line_dedup"]) == want
    changed = {(r["doc_id"], r["text"]) for r in kept["line_dedup"]} - set(rows)
    assert changed and all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"] if (r["doc_id"], r["text"]) in changed)


def test_near_dedup(kept):
    rows = [(r["doc_id"], r["text"]) for r in kept["line_dedup"]]
    classes = brute(rows)
    assert Counter(r["doc_id"] for r in kept["near_dedup"]) == Counter(set(classes.values()))
    assert len(kept["near_dedup"]) < len(rows)
    assert set(kept["near_dedup"]) <= set(kept["line_dedup"])


def test_mix_sources(kept):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    before = {r["doc_id"]: r for r in kept["near_dedup"]}
    times = Counter(r["doc_id"] for r in kept["mix_sources"])
    assert all(before[r["doc_id"]] == r for r in kept["mix_sources"]) and max(times.values()) <= 2
    total, taken = defaultdict(int), 0
    for r in before.values():
        total[r["source"]] += size(r["text"])
        taken += times[r["doc_id"]] * size(r["text"])
    assert taken == pytest.approx(1.5 * sum(total.values()), rel=0.05)


def test_pack_sequences(kept):
    pieces = Counter((r["doc_id"], r["piece"]) for r in kept["pack_sequences"])
    docs = Counter(r["doc_id"] for r in kept["mix_sources"])
    assert {i for i, _ in pieces} == set(docs) and all(n == docs[i] for (i, _), n in pieces.items())
    rooms = defaultdict(int)
    for r in kept["pack_sequences"]:
        rooms[r["sequence_id"]] += r["length"]
    assert max(rooms.values()) <= 4096
    assert len(rooms) <= -(-sum(rooms.values()) // packing.PACKING.seq_len) + 2


def test_edges_go_through(spark, sf):
    """Nulls, empty and long texts, repeated rows and clashing columns pass every stage; so does an empty table."""
    prose = [doc(100 + i, f"the cat number {i} sat on a mat and looked at the dog for {i} days " * 8) for i in range(5)]
    for rows in (EDGE_ROWS + prose, []):
        docs = spark.createDataFrame(rows, schema())
        for name, stage in P.STAGES:
            before = docs.columns
            docs = staged(stage(spark, docs, sf), f"edge-{name}")
            assert name == "pack_sequences" or docs.columns == before
        assert docs.count() == 0 or rows


def test_run(spark, sf):
    out = P.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 100
