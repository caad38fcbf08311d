"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from embedspark.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: every linked node with the smallest node of its component.

    Each round takes the smallest label among the neighbours (a combined minimum) and then the label of
    that label, so chains shrink fast. Every round is a written table.
    """
    both = links.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    edges = written(both.union(both.select("dst", "src")).where("src is not null and dst is not null").distinct())
    labels = written(edges.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("label")))
    total = None
    while True:
        lower = (
            edges.join(labels.withColumnRenamed("node", "src"), "src")
            .groupBy(F.col("dst").alias("node"))
            .agg(F.min("label").alias("lower"))
        )
        stepped = labels.join(lower, "node").select("node", F.least("label", "lower").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = written(stepped.join(above, "label").select("node", F.least("label", "top").alias("label")))
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
