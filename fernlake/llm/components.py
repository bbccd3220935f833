"""Connected components of a link table by distributed label spreading.

Every node starts with the least label among itself and its neighbours; then
labels spread along links and jump to the label of their label until nothing
changes.  Each round is a few joins and pre-aggregated minima over the links,
written to the shared folder; nothing but a change count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlake.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of comparable values -> (node, label): the least node reachable, for every node with a link."""
    both = materialise(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:  # every round but the last lowers a label, so it ends
        # The least label next to each node, also offered to the node's own label: whole trees move at once.
        near = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "label").groupBy("node").agg(F.min("label").alias("near"))
        seen = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("best"))
        hooks = seen.where("best < label").select(F.col("label").alias("node"), "best").union(seen.select("node", "best")).groupBy("node").agg(F.min("best").alias("label"))
        hooks = materialise(hooks, "hooks")
        up = hooks.select(F.col("node").alias("label"), F.col("label").alias("above"))
        moved = materialise(hooks.join(up, "label", "left").select("node", F.least("label", F.coalesce("above", "label")).alias("label")), "labels")
        changed = moved.join(labels.withColumnRenamed("label", "before"), "node").where("label <> before").limit(1).count()
        labels = moved
        if not changed:
            return labels
