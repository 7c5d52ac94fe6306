"""Order-dependent helpers that stay distributed when one key holds a large share of the rows.

A window ``partitionBy(key).orderBy(seq)`` puts every row of a key into one task. When a key
may hold a third of the table, that task would sort a third of the data alone. These helpers
split each key into chunks of consecutive ``seq`` (``floor(seq / chunk)``), compute within
chunks in parallel, and carry what crosses chunk borders through a per-chunk summary table that
is ``chunk`` times smaller than the input.

``running`` does without a chunk rule: it deals the rows out by sampled ranges of (key, order), so a
part holds about the same number of rows however they are spread over keys and time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.session import checkpoint_path

DEFAULT_CHUNK = 1 << 20  # rows of consecutive seq per chunk when seq is dense


def _chunk(order: str, chunk: int) -> Column:
    return F.floor(F.col(order) / F.lit(chunk)).cast("bigint")


def _join_back(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with their chunk's summary; null keys and a null chunk (null order) match themselves,
    as they form a window partition of their own."""
    names = [*keys, "_chunk"]
    s = summary.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(names)],
                       *[c for c in summary.columns if c not in names])
    same = [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(names)]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return rows.join(s, on, "left").drop(*[f"_s{i}" for i in range(len(names))])


def lag_by(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str,
           chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """``lag(value) over (partition by keys order by order)`` computed chunk-parallel.

    ``order`` must be unique within ``keys`` and numeric. The first row of a chunk takes the
    last value of the nearest earlier non-empty chunk of the same key.
    """
    keys = list(keys)
    c = df.withColumn("_chunk", _chunk(order, chunk))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(order)
    c = c.withColumn(out, F.lag(value).over(inner)).withColumn("_first", F.row_number().over(inner) == 1)
    # Per chunk: the last value (by order). Summary rows = input rows / chunk.
    summ = c.groupBy(*keys, "_chunk").agg(F.max_by(F.col(value), F.col(order)).alias("_last"))
    prev = Window.partitionBy(*keys).orderBy("_chunk")
    summ = summ.select(*keys, "_chunk", F.lag("_last").over(prev).alias("_carry"))
    j = _join_back(c, summ, keys)
    return j.withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col(out))) \
            .drop("_chunk", "_first", "_carry")


def running_sum_by(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], values: dict[str, Column],
                   include_current: bool = False, chunk: int = DEFAULT_CHUNK,
                   chunk_col: Column | None = None) -> DataFrame:
    """Running sums ``sum(v) over (partition by keys order by order rows ... )`` chunk-parallel.

    ``values`` maps output name -> numeric column. With ``include_current=False`` the sum covers
    strictly earlier rows (``unbounded preceding .. -1``), which is 0 for the first row.
    ``order`` may be several columns; then ``chunk_col`` must give a chunk number that is
    non-decreasing in that order (e.g. the day of a timestamp that leads the order).
    """
    keys = list(keys)
    order = [order] if isinstance(order, str) else list(order)
    c = df.withColumn("_chunk", chunk_col if chunk_col is not None else _chunk(order[0], chunk))
    for name, v in values.items():
        c = c.withColumn(f"_v_{name}", v.cast("double"))
    end = Window.currentRow if include_current else -1
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    for name in values:
        c = c.withColumn(f"_in_{name}", F.coalesce(F.sum(f"_v_{name}").over(inner), F.lit(0.0)))
    summ = c.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select(*keys, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0.0)).alias(f"_o_{n}")
                                          for n in values])
    j = _join_back(c, summ, keys)
    for name in values:
        j = j.withColumn(name, F.col(f"_in_{name}") + F.col(f"_o_{name}"))
    drop = ["_chunk"] + [f"_{p}_{n}" for n in values for p in ("v", "in", "o")]
    return j.drop(*drop)


def last_non_null_before(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str,
                         chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """``last(value, ignorenulls) over (partition by keys order by order rows unbounded preceding
    and 1 preceding)`` computed chunk-parallel: the as-of carry of the latest non-null value.

    Used for as-of joins: union the "right" rows (value set) with the "left" rows (value null)
    into one ordered sequence per key and read the carried value on the left rows.
    """
    keys = list(keys)
    c = df.withColumn("_chunk", _chunk(order, chunk))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn(out, F.last(F.col(value), ignorenulls=True).over(inner))
    carry_w = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # one aggregate lists every chunk and its last non-null value (rows with a null value get a
    # null ordering key, which max_by skips; a chunk without values yields null)
    has = F.col(value).isNotNull()
    chunks = c.groupBy(*keys, "_chunk").agg(F.max_by(F.col(value), F.when(has, F.col(order))).alias("_lv"))
    chunks = chunks.select(*keys, "_chunk", F.last("_lv", ignorenulls=True).over(carry_w).alias("_carry"))
    j = _join_back(c, chunks, keys)
    return j.withColumn(out, F.coalesce(F.col(out), F.col("_carry"))).drop("_chunk", "_carry")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a folder of its own and read back, so that what follows does not compute it again."""
    path = checkpoint_path(df.sparkSession, f"{name}/{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out anew by size, for costly work per row on rows that a few tasks read (a file with one row group is
    one task's, however large). Dealt by the whole row, so no key is hot; Spark splits a part of many equal rows."""
    return df.hint("rebalance", *df.columns)


def ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``_part``, its number among ``parts`` sampled ranges of (keys, order), ascending, nulls
    first. Rows equal in all of them share a part.

    The result is a written table: borders come from a sample, so a second evaluation might draw others.
    Drawing the sample evaluates ``df`` once more; give an expensive one as ``written``.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column] | None = None,
            xors: dict[str, Column] | None = None, last: dict[str, Column] | None = None,
            include_current: bool = False, parts: int | None = None) -> DataFrame:
    """Running aggregates per key in ``order``, by rows: ``sums`` (0 when there is no earlier row), ``xors`` (0)
    and ``last`` (the latest non-null value; null), over the earlier rows or, with ``include_current``,
    up to the row itself. ``order`` must be unique within a key, or its ties alike in all values.

    Two levels: a window inside each (part, key), and what a key brings along from its earlier parts. Only
    the first key of a part can have any, so that table has a row per part at most and is broadcast.
    """
    keys, order = list(keys), list(order)
    kinds = {"sum": sums or {}, "xor": xors or {}, "last": last or {}}
    named = [(kind, name) for kind, values in kinds.items() for name in values]
    held = df.select("*", *[kinds[kind][name].alias(f"_v_{name}") for kind, name in named])
    held = ranges(held, keys, order, parts)

    def over(kind: str, value: Column, window) -> Column:
        if kind == "last":
            return F.last(value, ignorenulls=True).over(window)
        return F.coalesce((F.sum(value) if kind == "sum" else F.bit_xor(value)).over(window), F.lit(0))

    end = Window.currentRow if include_current else -1
    inner = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    rows = held.select("*", *[over(kind, F.col(f"_v_{name}"), inner).alias(f"_in_{name}") for kind, name in named])
    total = {"sum": F.sum, "xor": F.bit_xor,
             "last": lambda v: F.max_by(v, F.when(v.isNotNull(), F.struct(*order)))}
    parts_of = held.groupBy(*keys, "_part").agg(*[total[kind](F.col(f"_v_{name}")).alias(f"_t_{name}") for kind, name in named])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_part"))
    carried = parts_of.select(*keys, "_part", nth.alias("_nth"),
                              *[over(kind, F.col(f"_t_{name}"), before).alias(f"_c_{name}") for kind, name in named])
    carried = F.broadcast(carried.where("_nth > 1").drop("_nth"))
    same = F.col("_part") == F.col("_cp")
    for i, k in enumerate(keys):
        carried = carried.withColumnRenamed(k, f"_k{i}")
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = rows.join(carried.withColumnRenamed("_part", "_cp"), same, "left")
    out = []
    for kind, name in named:
        here, there = F.col(f"_in_{name}"), F.col(f"_c_{name}")
        out.append({"sum": here + F.coalesce(there, F.lit(0)), "xor": here.bitwiseXOR(F.coalesce(there, F.lit(0))),
                    "last": F.coalesce(here, there)}[kind].alias(name))
    return rows.select(*[c for c in df.columns if c not in {n for _, n in named}], *out)
