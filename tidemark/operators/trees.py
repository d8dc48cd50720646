"""Trees kept as nodes(id, parent)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import settled


def roots(nodes: DataFrame) -> DataFrame:
    """(id, root) of nodes(id, parent): the ancestor without a parent above each node, its own for a node without.

    From the roots down, one join for each level of the tree: a node meets its parent's row
    alone, so no ancestor gathers the nodes under it, and rows do not grow with the depth.
    Nodes whose line of parents leaves the table, or runs in a circle, have no root.
    """
    nodes = settled(nodes.select("id", "parent"))
    level = settled(nodes.where("parent is null").select("id", F.col("id").alias("root")))
    below = nodes.where("parent is not null")
    out = level
    while not level.isEmpty():
        above = level.withColumnRenamed("id", "parent")
        level = settled(below.join(above, "parent").select("id", "root"))
        out = out.unionByName(level)
    return out
