"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.session import store


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is the smallest node of its connected component.

    Each round points every node at its smallest neighbour, shortens these chains, renames the edges and drops those
    that became loops. A round at least halves the nodes of every component that is left, so rounds are logarithmic.
    Maps and edges are written to the shared folder each round, which cuts the lineage and survives lost executors.
    Null ends and loops are ignored; repeated edges count once; an empty table gives no rows.
    """
    a, b = F.col("a"), F.col("b")

    def tidy(e: DataFrame) -> DataFrame:
        return e.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()

    rest = store(tidy(edges.select("a", "b")), "edges")
    maps = []
    while not rest.isEmpty():
        both = rest.union(rest.select(b.alias("a"), a.alias("b")))
        parent = both.groupBy(a.alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label"))
        parent = store(parent, "parents")
        for _ in range(2):
            up = parent.select(F.col("node").alias("label"), F.col("label").alias("top"))
            parent = parent.join(up, "label").select("node", F.col("top").alias("label"))
        parent = store(parent, "parents")
        maps.append(parent)
        left, right = (parent.select(F.col("node").alias(x), F.col("label").alias(f"{x}_")) for x in "ab")
        named = rest.join(left, "a").join(right, "b").select(F.col("a_").alias("a"), F.col("b_").alias("b"))
        rest = store(tidy(named), "edges")
    if not maps:
        return rest.select(a.alias("node"), b.alias("label"))
    labels = maps[0]
    for later in maps[1:]:
        up = later.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = labels.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return labels
