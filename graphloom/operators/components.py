"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import drop, materialize


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every end of an edge; component is the smallest node reachable.

    Each round gives every node its smallest neighbour as parent (or itself),
    flattens these trees by pointer doubling and contracts the edges to the
    roots, so at least half of the live nodes go. Both steps are partial
    aggregations and equi-joins of written tables; hubs are pre-aggregated and
    the joins can be split by adaptive execution. Nothing reaches the driver
    but emptiness tests. Null ends and self-loops: a self-loop makes its node
    its own component, rows with a null end are ignored.
    """
    ends = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u is not null and v is not null")
    live = materialize(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    alone = live.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    first, maps = live, []
    live = live.filter("u <> v")
    while live.limit(1).count():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = materialize(both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("parent")), "cc-parents")
        while True:
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
            jumped = materialize(parents.join(above, "parent").select("node", F.col("root").alias("parent"), (F.col("root") != F.col("parent")).alias("moved")), "cc-parents")
            drop(parents)
            parents = jumped
            if not parents.filter("moved").limit(1).count():
                break
        parents = parents.drop("moved")
        maps.append(parents)
        a = parents.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        b = parents.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        contracted = live.join(a, "u").join(b, "v").filter("pu <> pv").select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v"))
        live = materialize(contracted.distinct(), "cc-edges")
    if not maps:
        return alone
    labels = maps[0].select("node", F.col("parent").alias("component"))
    for step in maps[1:]:
        up = step.select(F.col("node").alias("component"), F.col("parent").alias("root"))
        labels = labels.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    loops = first.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    return labels.unionByName(loops.join(maps[0].select("node"), "node", "left_anti"))
