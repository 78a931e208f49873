"""Connected components of a link table, without bringing links or components together in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.operators.ordering import checkpointed, discard


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) for all `nodes` (node): the label is the smallest node that links (a, b) lead to.

    In every round a node takes the least label around it, and then the label of that label. Long chains so halve from
    round to round. A round's labels are written to the checkpoint folder; rounds end when no label has changed. Nodes
    without links take no part in the rounds.
    """
    both = checkpointed(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    linked = nodes.select("node").join(both.select(F.col("a").alias("node")), "node", "left_semi")
    labels = checkpointed(linked.select("node", F.col("node").alias("label")))
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("seen"))
        least = checkpointed(labels.join(around, "node", "left").select(
            "node", "label", F.least("label", F.coalesce("seen", "label")).alias("least")))
        # Of a changed label learn the node itself and the node that was its label until now.
        hook = least.where("least < label").groupBy(F.col("label").alias("node")).agg(F.min("least").alias("lower"))
        hooked = checkpointed(least.join(hook, "node", "left").select(
            "node", "label", F.least("least", F.coalesce("lower", "least")).alias("least")))
        further = hooked.select(F.col("node").alias("least"), F.col("least").alias("further"))
        jumped = checkpointed(hooked.join(further, "least").select("node", "label", F.least("least", "further").alias("new")))
        discard(labels, least, hooked)
        labels = checkpointed(jumped.select("node", F.col("new").alias("label")))
        changed = jumped.where("new < label").limit(1).count()
        discard(jumped)
        if not changed:
            found = checkpointed(nodes.select("node").join(labels, "node", "left").select(
                "node", F.coalesce("label", "node").alias("label")))
            discard(both, labels)
            return found
