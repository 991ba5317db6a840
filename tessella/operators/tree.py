"""Groups reached by links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.runtime import materialize, release


def breadth_first(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth): every node reached from the roots along links (parent, node), with the fewest links to it.

    Links back to nodes already placed are dropped, so loops end. Each level is written to the shared folder, and the
    walk ends with the first level that has no new node; null ends of links are left out."""
    links = links.where("parent is not null and node is not null").select("parent", "node")
    placed = front = materialize(roots.where("node is not null").select("node", F.lit(0).cast("long").alias("depth")).distinct(), "placed")
    depth = 0
    while not front.isEmpty():
        depth += 1
        parents = front.select(F.col("node").alias("parent"))
        fresh = links.join(parents, "parent").select("node").distinct().join(placed, "node", "left_anti").select("node", F.lit(depth).cast("long").alias("depth"))
        front = materialize(fresh, "front")
        old, placed = placed, materialize(placed.union(front), "placed")
        release(old)
    return placed
