"""Connected components of a table of links, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_shared, materialise


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) of longs -> (node, component): the smallest node that each reaches.

    Every round gives a node the smallest label of its neighbours and then the
    label of its label, so paths shrink geometrically.  Rounds are written to
    the shared folder; only the number of changed labels reaches the driver.
    Null ends are ignored.  Nodes without links do not appear.
    """
    both = materialise(
        links.where("a is not null and b is not null and a <> b").select("a", "b")
        .union(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a is not null and b is not null and a <> b"))
        .distinct()
    )
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        offered = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy("a").agg(F.min("component").alias("offer"))
        )
        lowered = materialise(
            labels.join(offered, F.col("node") == F.col("a"))
            .select("node", F.col("component").alias("old"), F.least("component", "offer").alias("component"))
        )
        jump = lowered.select(F.col("node").alias("root"), F.col("component").alias("further"))
        new = materialise(
            lowered.join(jump, F.col("component") == F.col("root"))
            .select("node", "old", F.least("component", "further").alias("component"))
        )
        changed = new.where("component <> old").limit(1).count()
        delete_shared(lowered)
        delete_shared(labels)
        labels = new.drop("old")
        if not changed:
            return labels
