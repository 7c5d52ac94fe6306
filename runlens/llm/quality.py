"""Quality rules (operator 2): distribution divergence from language references.

Every document gives two histograms: code points by character class (those of blank-delimited marks,
words without a letter or digit, are a class of their own), and words by common word (with one bin
for all others). The reference of a language is the mean histogram of its documents (whole corpus,
each document with the same weight, so a long one cannot set it). A document is rejected if the
Jensen-Shannon distance (base 2, 0 to 1) of either histogram from its language's reference is above
the limit for its length. Guards: a histogram counts only if the document has the minimum length for it.

Limits come from the spread of the distances of all documents of like length (half octaves of the
number of code points or words): upper quartile plus ``char_fence`` or ``word_fence`` quartile ranges. This spread counts as
many documents as there are, and a fixed limit + noise / sqrt(length) as ``prior_docs`` more, so a
length with few documents has about the fixed one, with no step between. The fixed limit is also the
most, so that junk which makes up a large part of a length cannot widen its own limit. A language with fewer than
``min_reference_docs`` documents has no reference to speak of: its documents are compared with the
mean of all documents, all letters and blanks taken as one class (scripts differ in these), under
the fixed limit, and their words are not compared.

Beside the method stand the base figures and rule (see ``judge``).

Scale: three passes over the texts with two small aggregates between them: one row per language and
task, and counts of distances in steps of 1/2,000 per band (at most 2 x 64 x 2,001 rows, whatever
the corpus; whole counts, so reruns agree). Only the limits, one per kind and band, go through the
driver. The reference table is staged, so Spark sees its size when it plans the join: small, it is
broadcast and the texts are never shuffled; otherwise it is an ordinary join.

Edge cases: null or empty text: no words, base_failed. A null language is a language of its own.
An empty table gives an empty result. Repeated rows are judged alike. Texts of any length are read
whole. All columns of the input are carried in a struct, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEADS, joined, staged, sums, text_slices, texts_of
from .words import WORDS, folded


@dataclass(frozen=True)
class Rules:
    min_words: int = 50           # base rule
    max_repeat_percent: int = 50  # base rule
    min_chars: int = 200          # guard of the character classes
    min_sample_words: int = 25    # guard of the common words
    min_reference_docs: int = 20  # below: compared with all documents
    char_fence: float = 3.0       # quartile ranges above the upper quartile
    word_fence: float = 6.0       # wider, as sound texts quote other languages
    prior_docs: int = 20          # weight of the fixed limits
    char_limit: float = 0.20
    char_noise: float = 1.2
    word_limit: float = 0.18
    word_noise: float = 2.0


RULES = Rules()

N_CLASSES = 12
_MARKS = 11  # class of all code points of words without a letter or digit
_SCRIPT = [0, 2, 3, 7, 8, 9, 10]  # blanks and letters
_SCALE = 1_000_000  # histogram shares are summed as whole millionths: the sum has no order


def _classes() -> np.ndarray:
    """Class of each lead byte: blank, line end or control, small, capital, digit, sentence mark,
    other ASCII, Latin letter of two bytes, other two bytes, three bytes, four bytes."""
    c = np.full(256, 6, np.int64)
    c[:32], c[127], c[32] = 1, 1, 0
    for chars, k in (("abcdefghijklmnopqrstuvwxyz", 2), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3), ("0123456789", 4),
                     (".,;:!?'\"()-", 5)):
        c[[ord(x) for x in chars]] = k
    c[0xC2:0xCA], c[0xCA:0xE0], c[0xE0:0xF0], c[0xF0:] = 7, 8, 9, 10
    return c


_CLASS = _classes()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True
_BIN = {w: i for i, w in enumerate(WORDS)}
N_BINS = len(WORDS) + 1
_PLAIN = _BLANK.copy()  # blanks and ASCII marks
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = True
_SLICE = 1 << 19        # text bytes handled at once: about six arrays of eight bytes a byte of text
_STEPS = 2_000          # distances are counted in steps of this part of one
N_BANDS = 64


def marks(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each byte, whether it is part of a word without a letter or digit."""
    if not len(data):
        return np.zeros(0, bool)
    blank = _BLANK[data]
    start = np.ones(len(data), bool)
    start[1:] = blank[1:] != blank[:-1]
    start[ends[:-1][ends[:-1] < len(data)]] = True
    at = np.flatnonzero(start)
    plain = np.logical_and.reduceat(_PLAIN[data], at) & ~blank[at]
    return np.repeat(plain, np.diff(np.append(at, len(data))))


def band(n: np.ndarray) -> np.ndarray:
    """Half octave of a length."""
    return np.minimum(2 * np.log2(np.maximum(n, 1)), N_BANDS - 1).astype(np.int64)


def histograms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per text the counts of character classes and of common words."""
    data, ends = joined(texts)
    of = np.repeat(np.arange(len(texts)), np.diff(ends))
    lead = LEADS[data]
    kind = np.where(marks(data, ends), _MARKS, _CLASS[data])
    chars = np.bincount(of[lead] * N_CLASSES + kind[lead], minlength=len(texts) * N_CLASSES)
    other = N_BINS - 1
    words = np.empty((len(texts), N_BINS), np.int64)
    get = _BIN.get
    for i, t in enumerate(texts):
        w = folded(t)
        words[i] = np.bincount(np.fromiter((get(x, other) for x in w), np.int64, len(w)), minlength=N_BINS)
    return chars.reshape(len(texts), N_CLASSES), words


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row Jensen-Shannon distance of two histograms (base 2)."""
    m = (p + q) / 2

    def part(a: np.ndarray) -> np.ndarray:
        return np.where(a > 0, a * np.log2(np.divide(a, m, out=np.ones_like(a), where=a > 0)), 0).sum(axis=1)

    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)  # 64 bits: a clash needs luck of n^2 / 2^64
    key = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def base_figures(texts: list[bytes]) -> dict[str, np.ndarray]:
    data, ends = joined(texts)
    out = {"word_chars": sums(LEADS[data] & ~_BLANK[data], ends), "n_symbols": sums(_SYMBOL[data], ends)}
    words, dup, repeated = [], [], []
    for t in texts:
        w = t.split()
        words.append(len(w))
        repeated.append(repeat_words(w))
        lines = [x for x in t.split(b"\n") if x and not x.isspace()] if b"\n" in t else []
        dup.append(len(lines) - len(set(lines)))
    return out | {"n_words": np.array(words, np.int64), "n_dup_lines": np.array(dup, np.int64),
                  "n_repeat_words": np.array(repeated, np.int64)}


def references(docs: DataFrame) -> DataFrame:
    """``docs(text, lang)`` -> lang, n_chars_docs, n_words_docs, chars, words: mean shares."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str | None, np.ndarray] = {}
        for b in text_slices(batches, max_bytes=_SLICE):
            texts, langs = texts_of(b.column("text")), b.column("lang").to_pylist()
            for i, (c, w) in enumerate(zip(*histograms(texts))):
                one = found.setdefault(langs[i], np.zeros(2 + N_CLASSES + N_BINS, np.int64))
                if n := c.sum():
                    one[0] += 1
                    one[2:2 + N_CLASSES] += c * _SCALE // n
                if n := w.sum():
                    one[1] += 1
                    one[2 + N_CLASSES:] += w * _SCALE // n
            if len(found) > 10_000:  # a task with very many languages hands them over in pieces
                yield _rows(found)
                found = {}
        if found:
            yield _rows(found)

    def _rows(found: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()),
                                           pa.array([v.tolist() for v in found.values()], pa.list_(pa.int64()))],
                                          names=["lang", "v"])

    per = docs.select("lang", "text").mapInArrow(partial, "lang string, v array<bigint>")
    n = 2 + N_CLASSES + N_BINS
    per = per.groupBy("lang").agg(*[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(n)])
    mean = [F.col(f"s{i}") / F.greatest(F.col("s0" if i < 2 + N_CLASSES else "s1"), F.lit(1)) / _SCALE for i in range(2, n)]
    return per.select("lang", F.col("s0").alias("n_chars_docs"), F.col("s1").alias("n_words_docs"),
                      F.array(*mean[:N_CLASSES]).alias("chars"), F.array(*mean[N_CLASSES:]).alias("words"))


def distances(b: pa.RecordBatch, chars: np.ndarray, words: np.ndarray, rules: Rules) -> dict[str, tuple[np.ndarray, ...]]:
    """char and word: length, distance from the reference, whether it counts, whether the document has its own
    language's reference. ``b`` has the reference's columns."""
    def column(name: str) -> np.ndarray:
        return b.column(name).flatten().to_numpy().reshape(b.num_rows, -1)

    def own(kind: str) -> np.ndarray:
        return b.column(f"n_{kind}s_docs").to_numpy(zero_copy_only=False) >= rules.min_reference_docs

    n, share, of_all, mine = chars.sum(axis=1), _shares(chars), column("all_chars"), own("char")
    d = distance(share, column("chars"))
    if not mine.all():
        one = [np.column_stack([np.delete(x, _SCRIPT, axis=1), x[:, _SCRIPT].sum(axis=1)]) for x in (share, of_all)]
        d = np.where(mine, d, distance(*one))
    out = {"char": (n, d, n >= rules.min_chars, mine)}
    n, mine = words.sum(axis=1), own("word")
    return out | {"word": (n, distance(_shares(words), column("words")), (n >= rules.min_sample_words) & mine, mine)}


def limits(rows: DataFrame, rules: Rules) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """char and word: per band the number of documents of languages with a reference, and the fence of their distances."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, max_bytes=_SLICE):
            bins = []
            for k, (n, d, counts, mine) in enumerate(distances(b, *histograms(texts_of(b.column("text"))), rules).values()):
                use = counts & mine
                bins.append((k * N_BANDS + band(n[use])) * (_STEPS + 1) + np.rint(d[use] * _STEPS).astype(np.int64))
            at, many = np.unique(np.concatenate(bins), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(many)], names=["at", "many"])

    found = rows.mapInArrow(counted, "at bigint, many bigint").groupBy("at").agg(F.sum("many").alias("many"))
    table = np.zeros(2 * N_BANDS * (_STEPS + 1), np.int64)
    for r in found.collect():  # bounded: bands x steps
        table[r["at"]] = r["many"]
    table = table.reshape(2, N_BANDS, _STEPS + 1).cumsum(axis=2)
    docs = table[:, :, -1]
    low, high = ((table >= np.ceil(q * docs)[:, :, None]).argmax(axis=2) / _STEPS for q in (0.25, 0.75))
    return {kind: (docs[k], high[k] + getattr(rules, f"{kind}_fence") * (high[k] - low[k])) for k, kind in enumerate(("char", "word"))}


FIGURES = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
           "base_failed boolean, char_distance double, word_distance double, kept boolean")


def judge(docs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """``docs`` -> ``row`` (all columns as a struct), n_words, word_chars (code points in words),
    n_symbols, n_dup_lines (lines with a word that equal an earlier one), n_repeat_words,
    base_failed (too few words, or too many in repeated three-word windows), char_distance and
    word_distance (null where a guard holds), kept."""
    reference = staged(references(docs), "quality-reference")
    docs_of = F.greatest(F.sum("n_chars_docs"), F.lit(1))
    of_all = reference.agg(F.array(*[F.coalesce(F.sum(F.col("chars")[i] * F.col("n_chars_docs")) / docs_of, F.lit(0.0))
                                     for i in range(N_CLASSES)]).alias("all_chars")).first()["all_chars"]  # one row
    ref = reference.select(F.col("lang").alias("_lang"), *[c for c in reference.columns if c != "lang"],
                           F.array(*[F.lit(x) for x in of_all]).alias("all_chars"))
    rows = docs.select(F.struct("*").alias("row"), F.col("lang"), F.col("text"))
    rows = rows.join(ref, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("lang", "_lang")
    spread = limits(rows.drop("row"), rules)
    rows = rows.drop("text")  # the row has it
    text_at = [c.lower() for c in docs.columns].index("text")

    def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("text", b.column("row").field(text_at))

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(with_text(batches), max_bytes=_SLICE):
            texts = texts_of(b.column("text"))
            f = base_figures(texts)
            out = {}
            for kind, (n, d, counted, mine) in distances(b, *histograms(texts), rules).items():
                fixed = getattr(rules, f"{kind}_limit") + getattr(rules, f"{kind}_noise") / np.sqrt(np.maximum(n, 1))
                many, fence = (x[band(n)] for x in spread[kind])
                limit = np.where(mine, (many * np.minimum(fence, fixed) + rules.prior_docs * fixed) / (many + rules.prior_docs), fixed)
                out[kind] = pa.array(d, mask=~counted), counted & (d > limit)
            failed = (f["n_words"] < rules.min_words) | (100 * f["n_repeat_words"] > rules.max_repeat_percent * f["n_words"])
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), *[pa.array(f[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                 pa.array(failed), out["char"][0], out["word"][0], pa.array(~failed & ~out["char"][1] & ~out["word"][1])],
                names=["row", *[x.split()[0] for x in FIGURES.split(", ")]])

    row_type = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(verdicts, f"row {row_type}, {FIGURES}")


def keep(docs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """The documents that pass, columns unchanged."""
    return judge(docs, rules).where("kept").select("row.*")
