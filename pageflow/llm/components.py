"""Connected components of an edge table, by spreading least labels and following them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageflow.llm.scratch import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (columns ``a, b``): the least node reachable.

    Each round a node takes the least label among its neighbours, then the label of its label,
    so paths shorten fast. Rounds are stored; the driver sees only how many labels changed.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = step.join(far, "label", "left").select("node", "old", F.least("label", "further").alias("label"))
        step = stored(step, "labels")
        if step.filter("label <> old").limit(1).count() == 0:
            return step.select("node", "label")
        labels = step.select("node", "label")
