"""Connected components of an edge table: least labels along edges, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penawar.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): root is the least node reachable; nodes without an edge don't occur.

    A round takes the least label of the neighbours, then the label of the label. Each round is
    written to the shared folder; only a count of changes reaches the driver."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a <> b").distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "cc-labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near")))
        step = labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = written(step.join(jump, "root").select("node", F.least("root", "far").alias("root"), "old"), "cc-labels")
        changed = new.where("root <> old").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels
