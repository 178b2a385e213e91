"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import scratch_table


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the least node of every node's component, for ``edges(a,
    b)``. Least labels go along the edges and then jump to the label of the
    label, so long chains halve; rounds end when no label changes. Minima are
    summed up on the map side, so the centre of a star is no hot task."""
    both = scratch_table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    label = scratch_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")),
                          f"{name}-labels")
    while True:
        near = (both.join(label.select(F.col("node").alias("b"), "root"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near")))
        step = label.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        jump = label.select(F.col("node").alias("new"), F.col("root").alias("far"))
        step = step.join(jump, "new", "left").select("node", "root", F.least("new", F.coalesce("far", "new")).alias("new"))
        step = scratch_table(step, f"{name}-labels")
        label = step.select("node", F.col("new").alias("root"))
        if step.where("root != new").limit(1).count() == 0:
            return label
