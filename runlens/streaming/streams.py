"""Arrival folders, file sources and change-log sinks for Structured Streaming, and the low-latency form of M2.

The restartable forms of M1-M6 are in ``live.py``; the scheduled retention (M7) works on the tables of
``sources/store.py``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import checkpoint_path

DEFAULT_SLICES = 4


def _fresh(spark: SparkSession, kind: str, name: str) -> str:
    return checkpoint_path(spark, f"{kind}/{name}-{uuid.uuid4().hex}")


def landing(df: DataFrame, name: str, order: str = "seq", slices: int = DEFAULT_SLICES, cuts: list | None = None,
            path: str | None = None) -> str:
    """Write ``df`` as ``slices`` appends split by ranges of ``order`` (an arrival folder), or by the given
    ``cuts`` (a slice holds the values up to its cut); ``path`` adds to a folder that exists.

    The slices are written one after the other, so file modification times (the file source's
    arrival order) follow ``order``; only ``slices - 1`` boundary values come to the driver.
    """
    path = path or _fresh(df.sparkSession, "landing", name)
    if cuts is None:
        cuts = df.approxQuantile(order, [i / slices for i in range(1, slices)], 0.0001)
    bounds = [None, *cuts, None]
    for lo, hi in zip(bounds, bounds[1:]):
        part = df
        if lo is not None:
            part = part.filter(F.col(order) > F.lit(lo))
        if hi is not None:
            upto = F.col(order) <= F.lit(hi)
            # rows without an order value arrive with the first slice
            part = part.filter(upto if lo is not None else upto | F.col(order).isNull())
        part.write.mode("append").parquet(path)
    return path


def files_per_slice(spark: SparkSession, path: str, slices: int = DEFAULT_SLICES) -> int:
    """Files of a micro-batch so that an arrival folder takes at most ``slices`` of them."""
    return max(1, -(-len(spark.read.parquet(path).inputFiles()) // slices))


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_changes(stream: DataFrame, name: str, output_mode: str = "update") -> str:
    """Run ``stream`` to completion (``availableNow``) into a change-log table; return its path."""
    spark = stream.sparkSession
    table = _fresh(spark, "tables", name)
    ckpt = _fresh(spark, "streams", name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    q = (stream.writeStream.outputMode(output_mode).option("checkpointLocation", ckpt)
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    return table


def latest(spark: SparkSession, table: str, keys: list[str], schema_cols: list[str]) -> DataFrame:
    """Newest version of every key in a change-log table."""
    log = spark.read.parquet(table)
    if not keys:
        return log.groupBy().agg(F.max_by(F.struct(*schema_cols), F.col("batch_id")).alias("r")).select("r.*")
    g = log.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in schema_cols if c not in keys]), F.col("batch_id")).alias("r"))
    return g.select(*keys, "r.*")


def late_arrivals(events: DataFrame, delayed: int = 50) -> DataFrame:
    """``events`` with ``arrival``, the number of the slice that brings a row: eight days each, and one row in
    ``delayed`` only with the last slice."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return events.withColumn("arrival", F.when(F.col("event_id") % delayed == 7, 4).otherwise(F.least(F.floor(day / 8), F.lit(3))).cast("int"))


def first_seen_within_watermark(polled: DataFrame, delay: str = "40 days") -> DataFrame:
    """M2, low-latency form: emit an id the first time it arrives (arrival order), keeping ids in
    state only for the watermark delay (``dropDuplicatesWithinWatermark``)."""
    return (polled.filter(F.col("id").isNotNull()).withColumn("event_time", F.col("ts").cast("timestamp"))
            .withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["id"]))
