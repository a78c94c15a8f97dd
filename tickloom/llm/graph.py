"""Connected components of a large edge table, without a hub's neighbours meeting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of an edge (``a, b``): the smallest node of its component.

    Every node points to its smallest neighbour, or to itself if it is smaller than all; pointers
    are followed to their roots by doubling; edges are renamed to the roots, and those left start
    the next round. Minima combine on the map side; adaptive execution splits the
    lookups of a popular root. Null ends and loops are ignored; an empty table gives no nodes.
    """
    left = edges.select("a", "b").where("a <> b")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
            left.select(F.col("b").alias("node"), F.col("a").alias("near"))
        )
        up = stored(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("root")), "roots")
        moved = True
        while moved:
            # Three doublings before the pointers are stored again.
            up = stored(_doubled(_doubled(_doubled(up))), "roots")
            moved = not up.where("moved").isEmpty()
            up = up.select("node", "root")
        maps.append(up)
        a, b = up.select(F.col("node").alias("a"), F.col("root").alias("ra")), up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = left.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        left = stored(left, "edges")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))  # no edges, no rows
    label = maps[0].select("node", F.col("root").alias("label"))
    for up in maps[1:]:
        step = up.select(F.col("node").alias("label"), "root")
        label = label.join(step, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    return stored(label, "labels") if len(maps) > 1 else label


def _doubled(up: DataFrame) -> DataFrame:
    """Every pointer goes on to where its end points; ``moved`` says whether that was further."""
    over = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return up.select("node", "root").join(over, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved"))
