"""Connected components over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.shared import materialise


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, component): the smallest node that can be reached; a row for each node of a link.

    Each round every node takes the smallest label among its own and its neighbours' (summed up before the shuffle), then
    the label of its label, so labels travel twice as far each round. A round's labels are written and the next one starts
    from the file; only the number of changed labels comes to the driver.
    """
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links", few=True)
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels", few=True)
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "component")
        least = seen.unionByName(labels).groupBy("node").agg(F.min("component").alias("component"))
        further = labels.select(F.col("node").alias("component"), F.col("component").alias("_next"))
        jumped = least.join(further, "component", "left").select("node", F.least("component", F.coalesce("_next", "component")).alias("component"))
        old = labels.withColumnRenamed("component", "_old")
        step = materialise(jumped.join(old, "node").select("node", "component", (F.col("component") != F.col("_old")).alias("moved")), "labels", few=True)
        labels = step.select("node", "component")
        if not step.where("moved").limit(1).count():
            return labels
