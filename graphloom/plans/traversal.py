"""Registered queries: graph queries, statistics and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import communities, graph, summaries
from graphloom.plans import inputs
from graphloom.plans.construction import query
from graphloom.plans.inputs import GRAPH, tables
from graphloom.storage import materialize

_SEEDS = "seeds AS (SELECT row_ord AS query_id, parent_asin AS node FROM catalog WHERE row_ord % 50 = 0)"


def bfs_sql(seeds: str, out: str, max_nodes: int = 1000) -> str:
    """Two capped hops from seeds (query_id, node, seed_rank)."""
    parts = [f"{out}_0 AS (SELECT query_id, node, 0 AS depth, row_number() OVER (PARTITION BY query_id ORDER BY seed_rank, node) AS ord FROM {seeds})"]
    seen = f"SELECT query_id, node, depth, ord FROM {out}_0"
    for hop in (1, 2):
        full = f"AND s.n_seen < {max_nodes}" if hop > 1 else ""
        parts.append(
            f"""{out}_near_{hop} AS (SELECT f.query_id, a.nbr AS node, min(f.ord * 1000 + a.pos) AS came FROM {out}_{hop - 1} f JOIN adj a ON a.node = f.node AND a.pos <= 30 GROUP BY 1, 2),
{out}_new_{hop} AS (SELECT n.*, row_number() OVER (PARTITION BY query_id ORDER BY came, node) AS number FROM {out}_near_{hop} n
  WHERE NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.query_id = n.query_id AND s.node = n.node)),
{out}_size_{hop} AS (SELECT query_id, count(*) AS n_seen FROM ({seen}) s GROUP BY 1),
{out}_{hop} AS (SELECT w.query_id, w.node, {hop} AS depth, s.n_seen + w.number AS ord FROM {out}_new_{hop} w JOIN {out}_size_{hop} s USING (query_id)
  WHERE w.number <= greatest({max_nodes} - s.n_seen, 1) {full})"""
        )
        seen += f" UNION ALL SELECT query_id, node, depth, ord FROM {out}_{hop}"
    return ",\n".join(parts) + f",\n{out} AS ({seen})"


_BFS = _SEEDS + ",\nseed_rows AS (SELECT query_id, node, 1 AS seed_rank FROM seeds),\n" + bfs_sql("seed_rows", "members")
INDUCED = "inside AS (SELECT a.query_id, e.u, e.v, e.type, e.weight FROM edges e JOIN members a ON a.node = e.u JOIN members b ON b.node = e.v AND b.query_id = a.query_id)"


def paths_sql(seeds: str) -> str:
    """Shortest paths of at most two edges inside ``inside``, as lists ``path``."""
    return f"""ways AS (SELECT query_id, u AS node, v AS nbr FROM inside UNION SELECT query_id, v, u FROM inside),
paths_0 AS (SELECT query_id, node, seed_rank, [node] AS path FROM {seeds}),
best_1 AS (SELECT p.query_id, w.nbr AS node, min({{'s': p.seed_rank, 'p': list_append(p.path, w.nbr)}}) AS way FROM paths_0 p JOIN ways w ON w.query_id = p.query_id AND w.node = p.node GROUP BY 1, 2),
paths_1 AS (SELECT query_id, node, way.s AS seed_rank, way.p AS path FROM best_1 b WHERE NOT EXISTS (SELECT 1 FROM paths_0 p WHERE p.query_id = b.query_id AND p.node = b.node)),
best_2 AS (SELECT p.query_id, w.nbr AS node, min({{'s': p.seed_rank, 'p': list_append(p.path, w.nbr)}}) AS way FROM paths_1 p JOIN ways w ON w.query_id = p.query_id AND w.node = p.node GROUP BY 1, 2),
paths_2 AS (SELECT query_id, node, way.s AS seed_rank, way.p AS path FROM best_2 b WHERE NOT EXISTS (SELECT 1 FROM paths_0 p WHERE p.query_id = b.query_id AND p.node = b.node)
  AND NOT EXISTS (SELECT 1 FROM paths_1 p WHERE p.query_id = b.query_id AND p.node = b.node)),
paths AS (SELECT query_id, node, path FROM paths_0 UNION ALL SELECT query_id, node, path FROM paths_1 UNION ALL SELECT query_id, node, path FROM paths_2),
path_steps AS (SELECT query_id, node, i AS spot, path[i] AS step, path[i + 1] AS next FROM (SELECT *, unnest(range(1, len(path) + 1)) AS i FROM paths) x),
told AS (SELECT s.query_id, s.node, string_agg(CASE WHEN s.next IS NULL THEN substr(coalesce(n.name, s.step), 1, 40) ELSE substr(coalesce(n.name, s.step), 1, 40) || ' --[' || coalesce(e.type, 'related') || ']-->' END, ' ' ORDER BY s.spot) AS described
  FROM path_steps s LEFT JOIN nodes n ON n.node_id = s.step LEFT JOIN edges e ON e.u = least(s.step, s.next) AND e.v = greatest(s.step, s.next) AND s.next IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {GRAPH}, {_SEEDS}, own AS (SELECT s.node, a.nbr, a.type, row_number() OVER (PARTITION BY s.node ORDER BY a.seq, a.nbr) AS pos FROM seeds s JOIN adj a ON a.node = s.node WHERE a.type IN ('similar_to', 'bought_together', 'has_brand')) SELECT node, nbr, type, pos::INTEGER AS pos FROM own WHERE pos <= 50")
def product_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return graph.neighbours(t.adj, inputs.seeds(t), ["similar_to", "bought_together", "has_brand"], 50)


@query(f"WITH {GRAPH}, {_BFS} SELECT query_id, node, depth::INTEGER AS depth, ord::INTEGER AS ord FROM members")
def subgraph_bfs_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return graph.subgraph_nodes(t.adj, inputs.seeds(t), 2).select("query_id", "node", "depth", "ord")


@query(f"WITH {GRAPH}, {_BFS}, {INDUCED} SELECT query_id, u, v, type FROM inside")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    members = materialize(graph.subgraph_nodes(t.adj, inputs.seeds(t), 2), "members")
    return graph.induced_edges(t.edges, members, ("type",))


@query(f"WITH {GRAPH}, {_BFS}, {INDUCED}, {paths_sql('seed_rows')} SELECT p.query_id, p.node, array_to_string(p.path, '>') AS path, t.described FROM paths p JOIN told t USING (query_id, node)")
def shortest_path_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    seeds = inputs.seeds(t)
    members = materialize(graph.subgraph_nodes(t.adj, seeds, 2), "members")
    return graph.shortest_paths(members, t.edges, seeds, 2, t.nodes).select("query_id", "node", F.array_join("path", ">").alias("path"), "described")


_CC = """part_edges AS (SELECT u, v FROM edges WHERE type IN ('bought_together', 'similar_to')),
ends AS (SELECT u AS node, v AS nbr FROM part_edges UNION ALL SELECT v, u FROM part_edges),
cc(node, label) USING KEY (node) AS (
  SELECT node_id, node_id FROM nodes WHERE type = 'product'
  UNION SELECT e.node, min(l.label) FROM ends e JOIN cc l ON l.node = e.nbr JOIN recurring.cc own ON own.node = e.node WHERE l.label < own.label GROUP BY e.node)"""


def _sparse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = tables(spark, sf_dir)
    return t.nodes.filter("type = 'product'"), t.edges.filter("type in ('bought_together', 'similar_to')")


@query(f"WITH RECURSIVE {GRAPH}, {_CC} SELECT node, label AS component FROM cc")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the products under co-purchase and similarity alone; the whole graph hangs together."""
    return graph.components(*_sparse(spark, sf_dir))


@query(f"WITH RECURSIVE {GRAPH}, {_CC}, sizes AS (SELECT label, count(*) AS n FROM cc GROUP BY 1) SELECT max(n)::BIGINT AS largest, sum(n)::BIGINT AS total, round(max(n) / sum(n), 6) AS share FROM sizes")
def largest_cc_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.largest_component(*_sparse(spark, sf_dir)).select("largest", "total", F.round("share", 6).alias("share"))


_DEGREE = "degree AS (SELECT node, sum(d)::BIGINT AS degree, count(*) AS neighbours FROM (SELECT u AS node, CASE WHEN u = v THEN 2 ELSE 1 END AS d FROM edges UNION ALL SELECT v, 1 FROM edges WHERE u <> v) x GROUP BY 1)"
_TOP = "top AS (SELECT node_id, name, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN degree ON node = node_id WHERE type = 'brand' ORDER BY degree DESC, node_ord, node_id LIMIT 10)"
_AVG = "mean AS (SELECT coalesce(round_even(sum(degree) / count(*), 2), 0) AS avg_product_degree FROM nodes LEFT JOIN degree ON node = node_id WHERE type = 'product')"


@query(f"WITH {GRAPH}, {_DEGREE}, {_TOP}, {_AVG} SELECT node_id, name, degree, avg_product_degree FROM top, mean")
def top_brands_by_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten brands of highest degree (the feature is the limit), with the mean product degree."""
    t = tables(spark, sf_dir)
    both = graph.top_brands(t.nodes, t.edges).join(F.broadcast(graph.average_product_degree(t.nodes, t.edges)))
    return both.orderBy(F.desc("degree"), "node_id")


@query(f"WITH {GRAPH} SELECT type, count(*)::BIGINT AS n FROM nodes GROUP BY type")
def node_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GRAPH} SELECT type, count(*)::BIGINT AS n FROM edges GROUP BY type")
def edge_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {GRAPH}, {_DEGREE}, {_TOP}, {_AVG}
    SELECT 'nodes_total' AS metric, '' AS key, count(*)::DOUBLE AS value FROM nodes UNION ALL SELECT 'edges_total', '', count(*) FROM edges
    UNION ALL SELECT 'nodes_by_type', type, count(*) FROM nodes GROUP BY type UNION ALL SELECT 'edges_by_type', type, count(*) FROM edges GROUP BY type
    UNION ALL SELECT 'top_brands_by_degree', name, degree FROM top UNION ALL SELECT 'avg_product_degree', '', avg_product_degree FROM mean"""
)
def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return graph.statistics(t.nodes, t.edges)


LABELS = "labels AS (SELECT node_id AS node, CASE WHEN type = 'product' THEN try_cast(substr(node_id, 3) AS BIGINT) % 29 ELSE length(node_id) % 29 END AS community FROM nodes)"
_MEMBERS = f"{LABELS}, members AS (SELECT l.community AS community_id, n.* FROM labels l JOIN nodes n ON n.node_id = l.node)"


def _groups(t: inputs.Tables) -> DataFrame:
    return inputs.labels(t).select(F.col("community").alias("community_id"), F.col("node").alias("member"))


@query(f"WITH {GRAPH}, {LABELS} SELECT least(a.community, b.community) AS c1, greatest(a.community, b.community) AS c2, count(*)::BIGINT AS weight FROM edges JOIN labels a ON a.node = u JOIN labels b ON b.node = v WHERE a.community <> b.community GROUP BY 1, 2")
def community_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return communities.contract(t.edges, inputs.labels(t))


_KEY_BRANDS = f"""{_DEGREE}, brand_degree AS (SELECT community_id, name, arg_max(coalesce(neighbours, 0), node_ord) AS neighbours, min(node_ord) AS node_ord FROM members LEFT JOIN degree ON node = node_id WHERE type = 'brand' GROUP BY 1, 2),
key_brands AS (SELECT community_id, name, neighbours, row_number() OVER (PARTITION BY community_id ORDER BY neighbours DESC, node_ord, name) AS rank FROM brand_degree QUALIFY rank <= 5)"""
_PRODUCT_LINES = """early AS (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY node_ord, node_id) AS place FROM members QUALIFY place <= 30),
brand_of AS (SELECT a.node AS node_id, arg_min(n.name, a.seq) AS brand FROM adj a JOIN nodes n ON n.node_id = a.nbr WHERE n.type = 'brand' GROUP BY 1),
product_lines AS (SELECT community_id, '- ' || name || ' (Brand: ' || coalesce(brand, 'Unknown') || ')' AS line, row_number() OVER (PARTITION BY community_id ORDER BY node_ord, e.node_id) AS rank
  FROM early e LEFT JOIN brand_of b USING (node_id) WHERE type = 'product' QUALIFY rank <= 20)"""
_EDGE_LINES = """edge_lines AS (SELECT a.community_id, '- ' || substr(a.name, 1, 50) || ' --[' || e.type || ']--> ' || substr(b.name, 1, 50) AS line, row_number() OVER (PARTITION BY a.community_id ORDER BY e.first_seq, e.u, e.v) AS rank
  FROM edges e JOIN members a ON a.node_id = e.u JOIN members b ON b.node_id = e.v AND b.community_id = a.community_id QUALIFY rank <= 20)"""


@query(f"WITH {GRAPH}, {_MEMBERS}, {_KEY_BRANDS} SELECT community_id, name, neighbours::BIGINT AS neighbours, rank::INTEGER AS rank FROM key_brands")
def community_top_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return summaries.top_brands(t.nodes, t.edges, _groups(t))


@query(f"WITH {GRAPH}, {_MEMBERS}, {_PRODUCT_LINES} SELECT community_id, line, rank::INTEGER AS rank FROM product_lines")
def community_prompt_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return summaries.product_lines(t.nodes, t.edges, _groups(t))


@query(f"WITH {GRAPH}, {_MEMBERS}, {_EDGE_LINES} SELECT community_id, line, rank::INTEGER AS rank FROM edge_lines")
def community_prompt_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return summaries.edge_lines(t.nodes, t.edges, _groups(t))


@query(
    f"""WITH {GRAPH}, members AS (SELECT node_ord // 1099511627776 AS community_id, * FROM nodes)
    SELECT community_id::BIGINT AS community_id, count_if(type = 'product')::BIGINT AS num_products, count(*)::BIGINT AS size,
           CASE WHEN count_if(type = 'product') < 3 THEN 'Small cluster: ' || coalesce(array_to_string((list(name ORDER BY node_ord, node_id) FILTER (WHERE type = 'product'))[1:3], '; '), '') END AS stub
    FROM members GROUP BY 1"""
)
def community_small_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes grouped by the stage and the stretch of rows that first mention them: large groups, and small ones that get a stub."""
    t = tables(spark, sf_dir)
    groups = t.nodes.select(F.expr("node_ord div 1099511627776").alias("community_id"), F.col("node_id").alias("member"))
    return summaries.prompts(t.nodes, t.edges, groups).select("community_id", "num_products", F.size("product_ids").cast("bigint").alias("size"), "stub")


@query(
    f"""WITH {GRAPH}, {_MEMBERS}, {_KEY_BRANDS}
    SELECT m.community_id, count_if(type = 'product')::BIGINT AS num_products, string_agg(node_id, ',' ORDER BY node_ord, node_id) AS product_ids,
           (SELECT coalesce(string_agg(k.name, ',' ORDER BY k.rank), '') FROM key_brands k WHERE k.community_id = m.community_id) AS key_brands
    FROM members m GROUP BY m.community_id"""
)
def community_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as the summaries keep them: the whole membership, and products counted."""
    t = tables(spark, sf_dir)
    made = summaries.summarize(t.nodes, t.edges, _groups(t))
    return made.select("community_id", "num_products", F.array_join("product_ids", ",").alias("product_ids"), F.array_join("key_brands", ",").alias("key_brands"))


@query()
def community_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both levels of the hierarchy; tests check its invariants."""
    t = tables(spark, sf_dir)
    return communities.detect_communities(t.nodes, t.edges, resolution=4.0)


@query(
    f"""WITH {GRAPH}, asked AS (SELECT row_ord AS query_id, lower(title) AS needle FROM catalog WHERE row_ord % 50 = 0 AND length(title) >= 3),
    hits AS (SELECT DISTINCT query_id, node_id, node_ord FROM asked JOIN nodes ON contains(lower(name), needle)),
    first AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY node_ord, node_id) AS seed FROM hits QUALIFY seed <= 5),
    every AS (SELECT query_id, node_id AS node, seed * 1000 AS place FROM first UNION ALL SELECT query_id, nbr, seed * 1000 + pos FROM first JOIN adj ON node = node_id AND pos <= 15),
    once AS (SELECT query_id, node, min(place) AS place FROM every GROUP BY 1, 2),
    placed AS (SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY place, node) AS ord FROM once)
    SELECT query_id, node, ord::INTEGER AS ord, substr(coalesce(nullif(name, ''), node), 1, 40) AS label, '[' || type || '] ' || coalesce(nullif(name, ''), node) AS title,
           CASE type WHEN 'product' THEN '#4a90d9' WHEN 'brand' THEN '#3cb371' WHEN 'category' THEN '#f5a623' WHEN 'feature' THEN '#9b59b6' ELSE '#95a5a6' END AS color,
           CASE WHEN type = 'product' THEN 18 ELSE 12 END::INTEGER AS size FROM placed JOIN nodes ON node_id = node WHERE ord <= 150"""
)
def viz_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    asked = t.catalog.filter(F.col("row_ord") % 50 == 0).select(F.col("row_ord").alias("query_id"), F.col("title").alias("entity"), F.lit(1).alias("entity_rank"))
    chosen = materialize(graph.query_nodes(t.nodes, t.adj, asked), "drawn")
    shown, _ = graph.drawing(t.nodes, t.edges, chosen)
    return shown.join(chosen, ["query_id", "node"]).select("query_id", "node", "ord", "label", "title", "color", "size")
