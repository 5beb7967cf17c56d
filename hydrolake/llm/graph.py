"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolake.sources.shared import materialize


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component`` (the smallest node it reaches) for every node of a link.

    Each round every node takes the smallest label among its own and its
    neighbours', then the label of that label; labels go to the shared folder
    each round, and only the count of changes reaches the driver. Loops and
    repeated links change nothing; no links give no rows.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(links.select(F.col(b).alias("node"), F.col(a).alias("other")))
    edges = materialize(both.distinct(), "edges")
    labels = materialize(edges.groupBy("node").agg(F.min(F.least("node", "other")).alias("component")), "labels")
    while True:
        theirs = edges.join(labels.withColumnsRenamed({"node": "other", "component": "theirs"}), "other")
        low = theirs.groupBy("node").agg(F.min("theirs").alias("theirs"))
        met = labels.join(low, "node").select("node", F.col("component").alias("before"), F.least("component", "theirs").alias("component"))
        # A label is itself a node: take its label too.
        roots = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        after = met.join(roots, "component").select("node", F.least("component", "root").alias("component"), "before")
        after = materialize(after, "labels")
        changed = after.where("component != before").limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels
