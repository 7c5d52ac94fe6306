"""Mixing sources to target weights (operator 1): capped water-filling, seeded repetitions.

Targets. Each source weighs 5, 2, 1, repeating in code point order of its name (null last). A
total of words is shared by weight; no source goes beyond ``max_epochs`` times its own size, and
what it cannot take is shared again among the rest by weight until no source is above. The fixed
point is found in one pass: with the sources ordered by cap / weight, the clamped ones are a
prefix, and the water level is (total - caps of the prefix) / (weights of the rest). These
windows run over one row per source, never over documents.

Repetitions. A source at 1.3 epochs gives every document once and a seeded part of them once
more. The part is taken in the order of a seeded hash until the words asked for are reached, in
two strata so that one huge document cannot miss the target: documents above ``1 /
large_share`` of their source's words are decided first, and the rest makes good what they left.
A document is in if half of it fits. The running sums run per (source, hash range) with ranges
of about ``rows_per_range`` documents, so a source that holds a third of all rows is spread.

Edge cases: a null or wordless text has size 0 and epochs 0; a source without words has target
0; an empty table gives an empty result. Rows that repeat (same id, source and text) are drawn
together, each with the same epochs. Null ids and sources are ordinary values. Other columns
are carried by ``mix`` whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import n_words, staged


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)
    total_share: float = 1.5      # of the words of all documents
    max_epochs: int = 2
    seed: str = "mix-1"
    large_share: int = 200        # a document above 1/200 of its source is decided first
    rows_per_range: int = 2_000


MIX = Mix()


def source_targets(sizes: DataFrame, p: Mix = MIX) -> DataFrame:
    """``sizes(source, n, size)`` -> one row per source: n_docs, source_size, target."""
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"),
                                      F.sum(F.col("n") * F.col("size")).alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in p.weights]),
                          (F.row_number().over(by_name) - 1) % len(p.weights) + 1)
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(float(p.max_epochs)) * F.col("source_size"))
    everything = W.partitionBy()
    first = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = first.rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumns({
        "total": F.lit(p.total_share) * F.sum("source_size").over(everything),
        "caps_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # a source is clamped if the level that it and all later ones would share is above its own cap
    level = (F.col("total") - F.col("caps_before")) / F.col("weight_left")
    per = per.withColumn("level", level).withColumn("clamped", F.col("level") * F.col("weight") >= F.col("cap"))
    water = F.min(F.when(~F.col("clamped"), F.struct("caps_before", "level"))).over(everything)
    return per.withColumn("water", water["level"]).select(
        "source", "n_docs", "source_size",
        F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("weight") * F.col("water")).alias("target"))


def units(docs: DataFrame) -> DataFrame:
    """Documents without their texts: doc_id, source, text_key, n (rows that repeat), size."""
    return (docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), n_words("text").alias("size"))
            .groupBy("doc_id", "source", "text_key").agg(F.count("*").alias("n"), F.max("size").alias("size")))


def repetitions(docs: DataFrame, p: Mix = MIX) -> DataFrame:
    """``docs(doc_id, text, source)`` -> doc_id, source, text_key, n, size, source_size, target,
    epochs (how often the mix takes each of the n rows)."""
    d = staged(units(docs), "mix-units")
    targets = staged(source_targets(d, p), "mix-targets").withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    draw = F.md5(F.concat(F.lit(p.seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    eighth = F.conv(F.substring("draw", 1, 8), 16, 10).cast("bigint")  # 0 .. 2^32 - 1
    d = (d.join(targets, same).drop("_source")
         .withColumns({"draw": draw, "words": F.col("n") * F.col("size"),
                       "whole": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                       .otherwise(F.lit(0)).cast("bigint"),
                       "ranges": F.floor(F.col("n_docs") / p.rows_per_range) + 1})
         .withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
         .withColumn("part", F.when(F.col("words") * p.large_share > F.col("source_size"), F.lit(-1))
                     .otherwise(F.shiftright(eighth * F.col("ranges"), 32)).cast("bigint")))
    inside = W.partitionBy("source", "part").orderBy("draw", "doc_id", "text_key").rowsBetween(W.unboundedPreceding, -1)
    d = staged(d.withColumn("before", F.coalesce(F.sum("words").over(inside), F.lit(0))), "mix-ranges")

    # large documents: at most ``large_share`` of a source
    large = d.where("part = -1")
    size = large.groupBy(F.col("source").alias("_source")).agg(F.sum("words").alias("large_words"))
    large = large.join(size, same).drop("_source").withColumn(
        "more", (F.col("before") + F.col("words") / 2 <= F.col("wanted") / F.col("source_size") * F.col("large_words"))
    ).drop("large_words")
    taken = large.groupBy(F.col("source").alias("_source")).agg(
        F.sum(F.when(F.col("more"), F.col("words")).otherwise(F.lit(0))).alias("large_taken"))

    # the rest: words of the hash ranges before, plus those before within the range
    earlier = W.partitionBy("_source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ranges = (d.where("part >= 0").groupBy(F.col("source").alias("_source"), F.col("part").alias("_part"))
              .agg(F.sum("words").alias("part_words"))
              .withColumn("range_before", F.coalesce(F.sum("part_words").over(earlier), F.lit(0))).drop("part_words"))
    ranges = ranges.join(taken.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    small = (d.where("part >= 0").join(ranges, same & (F.col("part") == F.col("_part")))
             .withColumn("more", F.col("range_before") + F.col("before") + F.col("words") / 2
                         <= F.col("wanted") - F.coalesce(F.col("large_taken"), F.lit(0)))
             .drop("_source", "_part", "range_before", "large_taken"))
    epochs = F.when(F.col("size") > 0, F.least(F.lit(p.max_epochs), F.col("whole") + F.col("more").cast("bigint")))
    return large.unionByName(small).select(
        "doc_id", "source", "text_key", "n", "size", "source_size", "target",
        F.coalesce(epochs, F.lit(0)).cast("bigint").alias("epochs"))


def mix(docs: DataFrame, p: Mix = MIX) -> DataFrame:
    """The documents as the mix takes them: each row as often as its epochs say, columns unchanged."""
    r = repetitions(docs, p).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
                                    F.col("text_key").alias("_key"), "epochs").where("epochs > 0")
    rows = docs.select(F.struct("*").alias("row"))
    j = rows.join(r, F.col("row.doc_id").eqNullSafe(F.col("_id")) & F.col("row.source").eqNullSafe(F.col("_source"))
                  & (F.xxhash64("row.text") == F.col("_key")))
    copies = F.explode(F.sequence(F.lit(1), F.col("epochs")))
    return j.select("row", copies.alias("_copy")).select("row.*")
