"""Adjacency, traversal, paths and statistics over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.config import DEFAULTS
from graphloom.operators.components import connected_components
from graphloom.operators.induced import induced_edges
from graphloom.operators.lookup import containing
from graphloom.storage import materialize


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, nbr, type, weight, seq): both directions of every edge, a self-loop once."""
    forth = edges.select(F.col("u").alias("node"), F.col("v").alias("nbr"), "type", "weight", F.col("first_seq").alias("seq"))
    back = edges.filter("u <> v").select(F.col("v").alias("node"), F.col("u").alias("nbr"), "type", "weight", F.col("first_seq").alias("seq"))
    return forth.unionByName(back)


def first_neighbours(adj: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` adjacency entries of each node, with their place ``pos`` from 1.

    The rank limit is applied in every task before the shuffle, so a hub sends
    at most ``cap`` rows a task.
    """
    pos = F.row_number().over(Window.partitionBy("node").orderBy("seq", "nbr"))
    return adj.withColumn("pos", pos).filter(F.col("pos") <= cap)


def neighbours(adj: DataFrame, seeds: DataFrame, edge_types: list[str] | None = None, limit: int = 50) -> DataFrame:
    """(node, nbr, type, pos): the first ``limit`` neighbours of the seed nodes (column node) over edges of the given types."""
    own = adj.join(seeds.select("node").distinct(), "node", "left_semi")
    if edge_types is not None:
        own = own.filter(F.col("type").isin(edge_types))
    return first_neighbours(own, limit).select("node", "nbr", "type", "pos")


def subgraph_nodes(adj: DataFrame, seeds: DataFrame, hops: int = 1, max_nodes: int = DEFAULTS.max_nodes, cap: int = DEFAULTS.hub_cap) -> DataFrame:
    """(query_id, node, depth, ord): breadth-first neighbourhoods of many queries at once.

    ``seeds`` has (query_id, node, seed_rank). Each node passes on to its first
    ``cap`` adjacency entries, visited ones counting. Nodes are numbered by
    depth, the number of the node they were first reached from, and place; a
    query stops at ``max_nodes`` (one more if its seeds alone are as many).
    """
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "nbr"))), lambda x: x["nbr"])
    entries = materialize(first_neighbours(adj, cap).groupBy("node").agg(listed.alias("nbrs")), "bfs-entries")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("seed_rank", "node"))
    first = seeds.groupBy("query_id", "node").agg(F.min("seed_rank").alias("seed_rank"))
    seen = materialize(first.select("query_id", "node", F.lit(0).alias("depth"), rank.alias("ord")), "bfs-frontier")
    frontier = seen
    own = Window.partitionBy("query_id")
    for hop in range(1, hops + 1):
        # lists travel to the queries whole; there what a query has seen comes first, under number 0
        lists = frontier.select("query_id", "node", "ord").join(entries, "node").select("query_id", "ord", "nbrs")
        known = seen.select("query_id", F.lit(0).alias("ord"), F.array("node").alias("nbrs"))
        near = lists.unionByName(known).repartition("query_id").select("query_id", "ord", F.posexplode("nbrs").alias("pos", "node"))
        met = near.groupBy("query_id", "node").agg(F.min(F.struct("ord", "pos")).alias("by"))
        placed = met.withColumn("n_seen", F.sum(F.when(F.col("by.ord") == 0, 1).otherwise(0)).over(own)).withColumn("ord", F.row_number().over(own.orderBy("by", "node")))
        new = placed.filter(F.col("by.ord") > 0)
        inside = new.filter(F.col("ord") <= F.greatest(F.lit(max_nodes), F.col("n_seen") + 1))
        if hop > 1:  # a query that is full has ended
            inside = inside.filter(F.col("n_seen") < max_nodes)
        frontier = materialize(inside.select("query_id", "node", F.lit(hop).alias("depth"), "ord"), "bfs-frontier")
        seen = seen.unionByName(frontier)
    return seen


def _steps(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(query_id, node, nbr, type): edges, in either direction, from a left node of a query (query_id, node) to a right one of it.

    An edge meets the queries of the end that fewer have, so a hub of many queries isn't multiplied by its edges.
    """
    ends = left.select("query_id", "node", F.lit(True).alias("is_left")).unionByName(right.select("query_id", "node", F.lit(False).alias("is_left")))
    many = lambda m, node: m.groupBy(F.col("node").alias(node)).agg(F.count(F.lit(1)).alias(f"n_{node}"))
    ways = edges.select(F.col("u").alias("from"), F.col("v").alias("to"), "type").unionByName(edges.select(F.col("v").alias("from"), F.col("u").alias("to"), "type"))
    both = ways.join(many(left, "from"), "from").join(many(right, "to"), "to").withColumn("is_left", F.col("n_from") <= F.col("n_to"))
    one = both.withColumn("node", F.when(F.col("is_left"), F.col("from")).otherwise(F.col("to"))).join(ends, ["node", "is_left"])
    other = one.select("query_id", "from", "to", "type", F.when(F.col("is_left"), F.col("to")).otherwise(F.col("from")).alias("node"), (~F.col("is_left")).alias("is_left"))
    return other.join(ends, ["query_id", "node", "is_left"], "left_semi").select("query_id", F.col("from").alias("node"), F.col("to").alias("nbr"), "type")


def shortest_paths(members: DataFrame, edges: DataFrame, seeds: DataFrame, max_length: int, nodes: DataFrame | None = None) -> DataFrame:
    """(query_id, node, path): a shortest path from a seed to each member over edges among the query's members.

    Of paths of the same length the one from the earliest seed wins, then the
    first in order of its nodes. Seeds have (query_id, node, seed_rank). A round
    extends the paths of the frontier to members without one, over the edges
    between the two alone; ``max_length`` edges at most. With ``nodes`` there is
    ``described`` as by ``describe_paths``: a path's text grows with the path, so
    a member's name is looked up once and no path is taken apart.
    """
    own = members.select("query_id", "node").distinct()
    start = seeds.groupBy("query_id", "node").agg(F.min("seed_rank").alias("seed_rank")).join(own, ["query_id", "node"], "left_semi")

    def way(rank: Column, path: Column, described: Column) -> Column:
        return F.struct(rank.alias("seed_rank"), path.alias("path"), *([] if nodes is None else [described.alias("described")])).alias("way")

    def named(ways: DataFrame) -> DataFrame:
        if nodes is None:
            return ways
        names = nodes.select(F.col("node_id").alias("node"), _shown().alias("name"))
        return ways.join(names, "node", "left").select("query_id", "node", way(F.col("way.seed_rank"), F.col("way.path"), F.concat("way.described", F.coalesce("name", "node"))))

    found = materialize(named(start.select("query_id", "node", way(F.col("seed_rank"), F.array("node"), F.lit("")))), "paths")
    frontier = found
    for _ in range(max_length):
        free = materialize(own.join(found.select("query_id", "node"), ["query_id", "node"], "left_anti"), "path-ends")
        step = way(F.col("way.seed_rank"), F.concat("way.path", F.array("nbr")), F.lit(None) if nodes is None else F.concat("way.described", _arrow()))
        longer = frontier.join(_steps(edges, frontier, free), ["query_id", "node"]).select("query_id", F.col("nbr").alias("node"), step)
        frontier = materialize(named(longer.groupBy("query_id", "node").agg(F.min("way").alias("way"))), "paths")
        found = found.unionByName(frontier)
    return found.select("query_id", "node", F.col("way.path").alias("path"), *([] if nodes is None else [F.col("way.described").alias("described")]))


def _shown() -> Column:
    return F.substring(F.coalesce("name", "node_id"), 1, 40)


def _arrow() -> Column:
    return F.concat(F.lit(" --["), F.coalesce("type", F.lit("related")), F.lit("]--> "))


def describe_paths(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``described``: the path's node names, cut to 40 characters, with the edge types between them."""
    key = [c for c in paths.columns if c != "path"]
    steps = paths.select(*key, F.posexplode("path").alias("at", "step"), F.col("path").alias("_path"))
    steps = steps.withColumn("next", F.get("_path", F.col("at") + 1)).drop("_path")
    names = nodes.select(F.col("node_id").alias("step"), _shown().alias("name"))
    kinds = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), "type")
    steps = steps.withColumn("a", F.least("step", "next")).withColumn("b", F.greatest("step", "next"))
    told = steps.join(names, "step", "left").join(kinds, ["a", "b"], "left")
    part = F.when(F.col("next").isNull(), F.coalesce("name", "step")).otherwise(F.concat(F.coalesce("name", "step"), F.lit(" --["), F.coalesce("type", F.lit("related")), F.lit("]-->")))
    lines = told.select(*key, F.struct("at", part.alias("part")).alias("s")).groupBy(*key).agg(F.sort_array(F.collect_list("s")).alias("s"))
    text = lines.select(*key, F.array_join(F.transform("s", lambda x: x["part"]), " ").alias("described"))
    return paths.join(text, key)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, neighbours): a self-loop counts twice as degree and once as neighbour."""
    ends = edges.select(F.col("u").alias("node"), F.when(F.col("u") == F.col("v"), 2).otherwise(1).alias("d")).unionByName(edges.filter("u <> v").select(F.col("v").alias("node"), F.lit(1).alias("d")))
    return ends.groupBy("node").agg(F.sum("d").cast("bigint").alias("degree"), F.count(F.lit(1)).alias("neighbours"))


def top_brands(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """(name, degree) of the ``n`` brands of highest degree, ties in order of the node's place."""
    brands = nodes.filter("type = 'brand'").select("node_id", "name", "node_ord")
    ranked = brands.join(degrees(edges).withColumnRenamed("node", "node_id"), "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return ranked.orderBy(F.desc("degree"), "node_ord", "node_id").limit(n).select("node_id", "name", F.col("degree").cast("bigint").alias("degree"))


def average_product_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the mean degree of products, to 2 places; 0 without products."""
    own = nodes.filter("type = 'product'").select("node_id").join(degrees(edges).withColumnRenamed("node", "node_id"), "node_id", "left")
    return own.agg(F.bround(F.coalesce(F.sum("degree") / F.count(F.lit(1)), F.lit(0.0)), 2).alias("avg_product_degree"))


def statistics(nodes: DataFrame, edges: DataFrame, communities: DataFrame | None = None) -> DataFrame:
    """(metric, key, value): totals, counts by type, top brands, mean product degree and communities by level."""
    row = lambda df, metric, key, value: df.select(F.lit(metric).alias("metric"), key.alias("key"), value.cast("double").alias("value"))
    n, none = F.count(F.lit(1)), F.lit("")
    out = row(nodes.agg(n.alias("n")), "nodes_total", none, F.col("n")).unionByName(row(edges.agg(n.alias("n")), "edges_total", none, F.col("n")))
    out = out.unionByName(row(nodes.groupBy("type").agg(n.alias("n")), "nodes_by_type", F.col("type"), F.col("n"))).unionByName(row(edges.groupBy("type").agg(n.alias("n")), "edges_by_type", F.col("type"), F.col("n")))
    out = out.unionByName(row(top_brands(nodes, edges), "top_brands_by_degree", F.col("name"), F.col("degree"))).unionByName(row(average_product_degree(nodes, edges), "avg_product_degree", none, F.col("avg_product_degree")))
    if communities is not None:
        by = communities.groupBy("level").agg(F.countDistinct("community_id").alias("n"))
        out = out.unionByName(row(by, "communities", F.concat(F.lit("level_"), F.col("level").cast("string")), F.col("n")))
    return out


def format_statistics(stats: DataFrame) -> str:
    """A printable block of a ``statistics`` result, which has one row per type, brand and level."""
    found: dict[str, list[tuple[str, float]]] = {}
    for r in stats.orderBy("metric", F.desc("value"), "key").toLocalIterator():
        found.setdefault(r.metric, []).append((r.key, r.value))
    one = lambda m: found.get(m, [("", 0.0)])[0][1]
    kinds = lambda m: ", ".join(f"{k}: {v:,.0f}" for k, v in sorted(found.get(m, [])))
    lines = ["graph statistics", f"nodes {one('nodes_total'):,.0f}, edges {one('edges_total'):,.0f}", f"nodes by type: {kinds('nodes_by_type')}", f"edges by type: {kinds('edges_by_type')}"]
    if "communities" in found:
        lines.append(f"communities: {kinds('communities')}")
    lines += [f"average product degree: {one('avg_product_degree'):g}", "brands by degree:", *[f"  {v:,.0f}  {k}" for k, v in found.get("top_brands_by_degree", [])]]
    return "\n".join(lines)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of every node; the component is its smallest node."""
    found = connected_components(edges)
    return nodes.select(F.col("node_id").alias("node")).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes of the largest component, all nodes and its share (0 for an empty graph)."""
    sizes = components(nodes, edges).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    both = sizes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return both.select("largest", "total", F.when(F.col("total") > 0, F.col("largest") / F.col("total")).otherwise(0.0).alias("share"))


def weighted_edges(edges: DataFrame) -> DataFrame:
    """(u, v, w) with a missing weight as 1."""
    return edges.select("u", "v", F.coalesce("weight", F.lit(1.0)).alias("w"))




def query_nodes(nodes: DataFrame, adj: DataFrame, entities: DataFrame, max_seeds: int = 5, max_neighbours: int = 15) -> DataFrame:
    """(query_id, node, ord): nodes to draw for a query's entities (query_id, entity, entity_rank).

    Entities of three characters or more are looked for in all node names,
    ignoring case; the first ``max_seeds`` nodes in node order and the first
    ``max_neighbours`` of each are drawn.
    """
    asked = entities.filter(F.length("entity") >= 3).select("query_id", F.lower("entity").alias("needle")).distinct()
    held = containing(nodes.select("node_id", F.lower("name").alias("name"), "node_ord"), "name", asked)
    first = F.row_number().over(Window.partitionBy("needle").orderBy("node_ord", "node_id"))
    hits = held.withColumn("first", first).filter(F.col("first") <= max_seeds).join(asked, "needle").groupBy("query_id", "node_id").agg(F.min("node_ord").alias("node_ord"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("node_ord", "node_id"))
    seeds = hits.withColumn("seed", rank).filter(F.col("seed") <= max_seeds).select("query_id", F.col("node_id").alias("node"), "seed")
    entries = first_neighbours(adj.join(seeds.select("node").distinct(), "node", "left_semi"), max_neighbours)
    near = seeds.join(entries, "node").select("query_id", F.col("nbr").alias("node"), "seed", "pos")
    every = seeds.select("query_id", "node", "seed", F.lit(0).alias("pos")).unionByName(near).groupBy("query_id", "node").agg(F.min(F.struct("seed", "pos")).alias("place"))
    return every.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "node"))).select("query_id", "node", "ord")


#: Colours of node types and the look of a drawing.
TYPE_COLOURS = {"product": "#4a90d9", "brand": "#3cb371", "category": "#f5a623", "feature": "#9b59b6"}
OTHER_COLOUR, MAX_DRAWN, LABEL_CHARS, PRODUCT_SIZE, OTHER_SIZE = "#95a5a6", 150, 40, 18, 12


def drawing(nodes: DataFrame, edges: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames of the nodes and edges to draw for chosen nodes (query_id, node, ord): label, title, colour and size."""
    own = chosen.filter(F.col("ord") <= MAX_DRAWN).join(nodes, chosen["node"] == nodes["node_id"])
    name = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("node_id"))
    colour = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_COLOURS.items() for x in kv]), F.col("type")), F.lit(OTHER_COLOUR))
    shown = own.select("query_id", "node", F.substring(name, 1, LABEL_CHARS).alias("label"), F.concat(F.lit("["), "type", F.lit("] "), name).alias("title"), colour.alias("color"), F.when(F.col("type") == "product", PRODUCT_SIZE).otherwise(OTHER_SIZE).alias("size"))
    return shown, induced_edges(edges, shown, ("type",)).select("query_id", "u", "v", F.col("type").alias("title"))
