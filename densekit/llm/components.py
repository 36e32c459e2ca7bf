"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densekit.session import pin


def components(edges: DataFrame) -> DataFrame:
    """From edges `a`, `b` to (`node`, `root`): one root for all nodes of a component.

    Every round merges each node into the smallest of its neighbours and itself and keeps the edges
    between what is left. Node ids should be hashes: then in expectation a fixed share of the nodes goes
    in every round, whatever the shape of the graph. Each round writes its two small tables.
    """
    left, steps = pin(edges.select("a", "b").filter("a != b").distinct()), []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = pin(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select("node", F.least("node", "_m").alias("root")))
        steps.append(step)
        to_a, to_b = (step.withColumnsRenamed({"node": side, "root": f"_{side}"}) for side in "ab")
        merged = left.join(to_a, "a").join(to_b, "b").filter("_a != _b")
        left = pin(merged.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0]
    for step in steps[1:]:
        later = step.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        found = found.join(later, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    return found
