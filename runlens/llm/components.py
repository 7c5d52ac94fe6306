"""Connected components of a link table, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs -> node, label (least node of its component), nodes with a link only.

    Each round gives a node the least label among itself and its neighbours, then follows that
    label's own label (pointer jumping), so long chains shrink by halves. Labels and links are
    written tables; only the number of changed labels reaches the driver. A node with very
    many links is a hot join key on the link side only, which Spark splits (skew join).
    """
    both = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .where("a <> b").distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("least")))
        hooked = near.join(labels, "node").select("node", F.least("label", "least").alias("hooked"), F.col("label").alias("old"))
        up = labels.select(F.col("node").alias("hooked"), F.col("label").alias("up"))
        new = staged(hooked.join(up, "hooked").select("node", F.least("hooked", "up").alias("label"),
                                                      (F.least("hooked", "up") != F.col("old")).alias("changed")), "labels")
        changed = new.where("changed").count()
        labels = new.select("node", "label")
        if not changed:
            return labels
