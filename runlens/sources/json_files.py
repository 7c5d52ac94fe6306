"""Webhook deliveries from folders of JSON lines, read in batch or as a stream; lines that cannot be used go to a
quarantine table with their file and the reason (SURVEY 2.1).

A line is one delivery ``{"delivery_id": ..., "event_type": ..., "payload": {...}}``. Files are read with the schema below
in PERMISSIVE mode: a line that is no JSON, or has another type in a field, keeps its text in the corrupt-record
column instead of failing the job. Blank lines are no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.versioned import Store
from ..streaming import live

CORRUPT = "_corrupt_record"
DELIVERY = f"delivery_id bigint, event_type string, payload string, {CORRUPT} string"
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_deliveries(spark: SparkSession, path: str) -> DataFrame:
    """All lines of a folder, usable or not."""
    return _named(spark.read.schema(DELIVERY).options(**_OPTIONS).json(path))


def stream_deliveries(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The same as a stream that takes in files as they arrive."""
    return _named(spark.readStream.schema(DELIVERY).options(**_OPTIONS).option("maxFilesPerTrigger", files_per_trigger).json(path))


def reason() -> Column:
    """Why a line cannot be used; null for one that can."""
    return (F.when(F.col(CORRUPT).isNotNull(), "not json").when(F.col("delivery_id").isNull(), "no delivery id")
             .when(F.col("payload").isNull(), "no payload"))


def usable(lines: DataFrame) -> DataFrame:
    return lines.where(reason().isNull()).select("delivery_id", "event_type", "payload")


def quarantined(lines: DataFrame) -> DataFrame:
    """file, reason, record (the line's text, where it was no JSON) of the lines that cannot be used."""
    return lines.withColumn("reason", reason()).where("reason is not null").select("file", "reason", F.col(CORRUPT).alias("record"))


def runs_from_files(lines: DataFrame, store: Store, checkpoint: str, **options) -> StreamingQuery:
    """M1 from JSON files: the run table and the table ``quarantine``, published together."""
    tables = {"runs": live.Table(lambda r: live.RUNS.fold(usable(r)), live.RUNS.keys, live.RUNS.values), "quarantine": live.Table(quarantined)}
    return live.start(lines, store, "runs_from_files", tables, checkpoint, **options)
