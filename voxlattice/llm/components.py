"""Connected components of a link table by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    Each round takes the smallest label among a node and its neighbours, then the label's own label, until
    nothing changes. Hubs are pre-aggregated before each shuffle; rounds are written to the shared folder.
    """
    both = materialise(links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a))).where("u <> v").distinct(), "links")
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("component").alias("m"))
        step = labels.join(near, labels.node == near.u).select("node", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        up = step.select(F.col("node").alias("parent"), F.col("component").alias("above"))
        new = materialise(step.join(up, F.col("component") == F.col("parent")).select("node", "was", F.least("component", "above").alias("component")), "labels")
        changed = new.where("was <> component").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
