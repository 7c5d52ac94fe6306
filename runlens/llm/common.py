"""Shared helpers of the training-data operators: words, Arrow text access, staged tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import checkpoint_path

#: A word is a run of characters other than ASCII blanks. ``bytes.split()`` splits on exactly these.
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes handled at once inside a task; bounds the numpy temporaries of the operators.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a new folder in the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs the tasks of the current step only, and numbers drawn
    from partition ids are fixed once the table is committed.
    """
    spark = df.sparkSession
    path = checkpoint_path(spark, f"runlens-llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text: str) -> Column:
    """Number of words of a text column; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices that hold about ``max_bytes`` of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        end = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            base = end[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(end, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null: empty."""
    return [x or b"" for x in pc.cast(column, pa.binary()).to_pylist()]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts after one another, and the n + 1 borders between them."""
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    return np.frombuffer(b"".join(texts), np.uint8), ends


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between each two borders."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends[1:]] - total[ends[:-1]]


#: True for the bytes that begin a code point.
LEADS = (np.arange(256) & 0xC0) != 0x80


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else int(LEADS[np.frombuffer(text, np.uint8)].sum())
