"""Registered queries: retrieval, linking, routing, formatting and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.fuzzy import token_set_ratio_udf
from graphloom.operators import answer, evaluate, linking, lookup, retrieve, similarity
from graphloom.plans import inputs
from graphloom.plans.construction import query
from graphloom.plans.inputs import GRAPH, tables
from graphloom.plans.traversal import INDUCED, bfs_sql, paths_sql
from graphloom.storage import materialize

_VECTORS = "vectors AS (SELECT 'p:' || vec_id AS id, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_HITS = """all_hits AS (SELECT q.vec_id AS query_id, v.id AS node, list_dot_product(q.e, v.e) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, v.e) DESC, v.id) AS rank
  FROM vectors q JOIN vectors v ON q.vec_id % 50 = 0 QUALIFY rank <= 50)"""
_OWN = f"{_HITS}, hits AS (SELECT h.* FROM all_hits h SEMI JOIN nodes n ON n.node_id = h.node)"
_DIRECT = """direct AS (SELECT h.query_id, a.nbr AS node, h.score * 0.5 AS base, CASE a.type WHEN 'bought_together' THEN 0.3 ELSE 0.15 END::DOUBLE AS bonus, a.type AS via, false AS vector,
  {'stage': 1, 'seed_rank': h.rank, 'step': a.seq, 'sibling': 0} AS place
  FROM hits h JOIN adj a ON a.node = h.node JOIN nodes n ON n.node_id = a.nbr WHERE a.type IN ('bought_together', 'similar_to') AND n.type = 'product')"""
_BRAND = """brand_members AS (SELECT a.node AS brand, a.nbr AS node, row_number() OVER (PARTITION BY a.node ORDER BY a.seq, a.nbr) AS pos FROM adj a JOIN nodes b ON b.node_id = a.node AND b.type = 'brand' JOIN nodes n ON n.node_id = a.nbr AND n.type = 'product'),
siblings AS (SELECT h.query_id, m.node, h.score, h.rank, a.seq, row_number() OVER (PARTITION BY h.query_id, h.node, a.nbr ORDER BY m.pos) AS sibling
  FROM hits h JOIN adj a ON a.node = h.node JOIN brand_members m ON m.brand = a.nbr AND m.node <> h.node QUALIFY sibling <= 10),
by_brand AS (SELECT query_id, node, score * 0.5 AS base, 0.1::DOUBLE AS bonus, 'has_brand' AS via, false AS vector, {'stage': 1, 'seed_rank': rank, 'step': seq, 'sibling': sibling} AS place FROM siblings)"""
_POOL = f"""{_OWN}, {_DIRECT}, {_BRAND},
every AS (SELECT query_id, node, score AS base, 0.0::DOUBLE AS bonus, NULL AS via, true AS vector, {{'stage': 0, 'seed_rank': rank, 'step': 0, 'sibling': 0}} AS place FROM hits UNION ALL SELECT * FROM direct UNION ALL SELECT * FROM by_brand),
best AS (SELECT query_id, node, max(base) AS base, max(bonus) AS bonus, bool_or(vector) AS vector, min(place) AS first FROM every GROUP BY 1, 2),
via_of AS (SELECT e.query_id, e.node, e.via, row_number() OVER (PARTITION BY e.query_id, e.node ORDER BY e.place) AS nth FROM every e JOIN best b ON b.query_id = e.query_id AND b.node = e.node AND e.bonus = b.bonus AND b.bonus > 0 QUALIFY nth = 1),
pool AS (SELECT b.query_id, b.node, b.base, b.bonus, b.base + b.bonus AS score, CASE WHEN vector THEN 'vector' ELSE 'graph' END AS source, v.via AS via_edge, first FROM best b LEFT JOIN via_of v USING (query_id, node)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, node) AS rank FROM pool)"""


def _hits(t: inputs.Tables) -> DataFrame:
    asked = inputs.vector_queries(t)
    found = similarity.top_k(asked, t.embeddings.select("id", "embedding"))
    return materialize(found.select(F.col("query_id").cast("bigint").alias("query_id"), "id", "score", "rank"), "hits")


@query(f"WITH {_VECTORS}, {_HITS} SELECT query_id, node AS id, round(score, 6) AS score, rank::INTEGER AS rank FROM all_hits")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector against all vectors, 50 best each."""
    v = inputs.embeddings(spark, sf_dir)
    found = similarity.top_k(v.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding"), v.select("id", "embedding"))
    return found.select(F.col("query_id").cast("bigint").alias("query_id"), "id", F.round("score", 6).alias("score"), "rank")


_SUMMARIES = """sums AS (SELECT label, i, avg(e[i]) AS x FROM (SELECT label, e, unnest(range(1, len(e) + 1)) AS i FROM vectors) u GROUP BY 1, 2),
means AS (SELECT label AS community_id, list(x ORDER BY i) AS e FROM sums GROUP BY 1),
unit AS (SELECT community_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM means)"""


def _group_summaries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A summary of each label, with the mean of its vectors."""
    v = inputs.embeddings(spark, sf_dir)
    flat = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    means = flat.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"].cast("float")).alias("embedding"))
    own = v.groupBy("label").agg(F.count(F.lit(1)).alias("num_products"), F.slice(F.sort_array(F.collect_list(F.struct("vec_id", "id"))), 1, 8).alias("first"))
    told = own.select(F.col("label").cast("bigint").alias("community_id"), F.concat(F.lit("Group "), F.col("label").cast("string")).alias("summary"), "num_products", F.array(F.concat(F.lit("Brand "), F.col("label").cast("string"))).alias("key_brands"), F.transform("first", lambda s: s["id"]).alias("product_ids"))
    return told, means.select(F.col("label").cast("string").alias("id"), "embedding")


@query(
    f"""WITH {_VECTORS}, {_SUMMARIES},
    found AS (SELECT q.vec_id AS query_id, u.community_id, list_dot_product(q.e, u.e) AS score FROM vectors q JOIN unit u ON q.vec_id % 50 = 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community_id::VARCHAR) AS rank FROM found QUALIFY rank <= 5)
    SELECT query_id, rank::INTEGER AS rank, community_id::BIGINT AS community_id, round(score, 4) AS score,
           (SELECT string_agg(id, ',' ORDER BY vec_id) FROM (SELECT id, vec_id FROM vectors v WHERE v.label = placed.community_id ORDER BY vec_id LIMIT 5) x) AS samples FROM placed"""
)
def global_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    told, vectors = _group_summaries(spark, sf_dir)
    found = retrieve.global_search(inputs.vector_queries(t), told, vectors)
    return found.select(F.col("query_id").cast("bigint").alias("query_id"), "rank", "community_id", F.round("score", 4).alias("score"), F.array_join("sample_ids", ",").alias("samples"))


@query(f"WITH {GRAPH}, {_OWN}, {_DIRECT} SELECT query_id, node, round(base, 6) AS base, bonus, via, place.seed_rank AS seed_rank FROM direct")
def local_expand_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    found = retrieve.expand_direct(retrieve.hits_in_graph(_hits(t), t.nodes), t.nodes, t.adj)
    return found.select("query_id", "node", F.round("base", 6).alias("base"), "bonus", "via", F.col("place.seed_rank").alias("seed_rank"))


@query(f"WITH {GRAPH}, {_OWN}, {_BRAND} SELECT query_id, node, round(base, 6) AS base, bonus, via, place.seed_rank AS seed_rank, place.sibling AS sibling FROM by_brand")
def local_expand_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    found = retrieve.expand_brand(retrieve.hits_in_graph(_hits(t), t.nodes), t.nodes, t.adj)
    return found.select("query_id", "node", F.round("base", 6).alias("base"), "bonus", "via", F.col("place.seed_rank").alias("seed_rank"), F.col("place.sibling").alias("sibling"))


@query(f"WITH {GRAPH}, {_POOL} SELECT query_id, node, round(base, 6) AS base, bonus, round(score, 6) AS score, source, via_edge FROM pool")
def local_search_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return retrieve.pool(_hits(t), t.nodes, t.adj).select("query_id", "node", F.round("base", 6).alias("base"), "bonus", F.round("score", 6).alias("score"), "source", "via_edge")


_LOCAL = f"{_POOL}, top AS (SELECT r.query_id, r.rank, r.node, n.name, n.price, n.rating, r.score, r.source, r.via_edge FROM ranked r JOIN nodes n ON n.node_id = r.node WHERE r.rank <= 10)"


def _local(t: inputs.Tables) -> DataFrame:
    return retrieve.local_search(_hits(t), t.nodes, t.adj)


@query(f"WITH {GRAPH}, {_LOCAL} SELECT query_id, rank::INTEGER AS rank, node, name, price, rating, round(score, 6) AS score, source, via_edge FROM top")
def local_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _local(tables(spark, sf_dir)).withColumn("score", F.round("score", 6))


_EXTRAS = "'- ' || coalesce(nullif(name, ''), node) || ' (score: ' || printf('%.3f', score) || coalesce('; price: $' || price, '') || coalesce('; rating: ' || rating, '') || ')'"


@query(
    f"""WITH {GRAPH}, {_LOCAL} SELECT query_id, string_agg({_EXTRAS}, chr(10) ORDER BY rank) AS products,
    coalesce(string_agg('- ' || coalesce(nullif(name, ''), node) || ' — found via graph edge ''' || via_edge || '''', chr(10) ORDER BY rank), '(all results came from direct vector retrieval)') AS links FROM top GROUP BY 1"""
)
def format_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    found, asked = materialize(_local(t), "local"), inputs.vector_queries(t)
    return answer.format_products(found, asked).join(answer.format_graph_context(found, asked), "query_id")


@query(
    f"""WITH {_VECTORS}, {_SUMMARIES},
    found AS (SELECT q.vec_id AS query_id, u.community_id, list_dot_product(q.e, u.e) AS score FROM vectors q JOIN unit u ON q.vec_id % 50 = 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community_id::VARCHAR) AS rank FROM found QUALIFY rank <= 5),
    sizes AS (SELECT label, count(*) AS n FROM vectors GROUP BY 1)
    SELECT query_id, string_agg('### Cluster ' || community_id || ' (' || n || ' products; key brands: Brand ' || label || ')' || chr(10) || 'Group ' || label, chr(10) || chr(10) ORDER BY rank) AS communities
    FROM placed JOIN sizes ON label = community_id GROUP BY 1"""
)
def format_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    told, vectors = _group_summaries(spark, sf_dir)
    asked = inputs.vector_queries(t)
    found = retrieve.global_search(asked, told, vectors)
    return answer.format_communities(found.withColumn("query_id", F.col("query_id").cast("bigint")), asked)


@query(
    f"""WITH {_VECTORS}, q AS (SELECT vec_id AS query_id, t, e[t * 16 + 1 : t * 16 + 16] AS x FROM vectors, range(4) r(t) WHERE vec_id % 50 = 0),
    h AS (SELECT a.vec_id AS query_id, b.vec_id, b.e, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.e, b.e) DESC, b.id) AS rank FROM vectors a JOIN vectors b ON a.vec_id % 50 = 0 QUALIFY rank <= 50),
    d AS (SELECT query_id, vec_id, e[t * 16 + 1 : t * 16 + 16] AS y FROM h, range(4) r(t)),
    best AS (SELECT q.query_id, d.vec_id, q.t, max(list_dot_product(q.x, d.y)) AS best FROM q JOIN d USING (query_id) GROUP BY 1, 2, 3)
    SELECT query_id, 'p:' || vec_id AS id, round(sum(best), 6) AS score FROM best GROUP BY 1, 2"""
)
def maxsim_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late interaction over the hits of every query; a vector's quarters stand for its tokens."""
    t = tables(spark, sf_dir)
    cut = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.alias("token"), F.slice("embedding", i * 16 + 1, 16).alias("embedding")))
    asked = inputs.vector_queries(t).select("query_id", F.inline(cut))
    hits = _hits(t).select("query_id", "id").join(t.embeddings.select("id", "embedding"), "id")
    found = retrieve.maxsim(asked, hits.select("query_id", "id", F.inline(cut)).select("query_id", "id", "embedding"))
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


_NEEDLES = "needles AS (SELECT row_ord AS query_id, 1 AS entity_rank, lower(p_brand) AS needle FROM catalog WHERE row_ord % 50 = 0 UNION ALL SELECT row_ord, 2, lower(trim(title)) FROM catalog WHERE row_ord % 50 = 0)"
_LINKS = f"""{_NEEDLES},
links AS (SELECT query_id, entity_rank, node_id AS node, row_number() OVER (PARTITION BY query_id, entity_rank ORDER BY length(name), node_ord, node_id) AS place
  FROM needles JOIN nodes ON contains(lower(name), needle) WHERE type IN ('product', 'brand') AND name <> '' QUALIFY place <= 3)"""


@query(f"WITH {GRAPH}, {_LINKS} SELECT query_id, entity_rank::INTEGER AS entity_rank, node, place::INTEGER AS place FROM links")
def link_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return linking.link_substring(linking.name_index(t.nodes), materialize(linking.needles(inputs.entities(t)), "needles"))


@query()
def link_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand names with their words turned round, which no name contains."""
    t = tables(spark, sf_dir)
    turned = inputs.entities(t).withColumn("entity", F.array_join(F.reverse(F.split("entity", " ")), " "))
    return linking.link_fuzzy(linking.name_index(t.nodes), materialize(linking.needles(turned), "needles"))


_MULTI = f"""{_LINKS},
linked AS (SELECT query_id, node, min(entity_rank * 10 + place) AS spot FROM links GROUP BY 1, 2),
asked_seeds AS (SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY spot, node) AS seed_rank FROM linked QUALIFY seed_rank <= 10),
{bfs_sql('asked_seeds', 'members')}, {INDUCED}, {paths_sql('asked_seeds')}"""


@query(
    f"""WITH {GRAPH}, {_MULTI},
    reached AS (SELECT p.query_id, p.node, n.name, len(p.path) - 1 AS hop_distance, coalesce(list_dot_product(q.e, v.e), 0) AS score
      FROM paths p JOIN nodes n ON n.node_id = p.node AND n.type = 'product' LEFT JOIN vectors q ON q.vec_id = p.query_id LEFT JOIN vectors v ON v.id = p.node
      WHERE NOT EXISTS (SELECT 1 FROM asked_seeds s WHERE s.query_id = p.query_id AND s.node = p.node) AND p.query_id IN (SELECT vec_id FROM vectors WHERE vec_id % 50 = 0)),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop_distance, round(score, 9) DESC, node) AS rank FROM reached QUALIFY rank <= 20)
    SELECT b.query_id, b.rank::INTEGER AS rank, b.node, b.name, round(b.score, 6) AS score, b.hop_distance::INTEGER AS hop_distance, t.described AS path FROM best b JOIN told t USING (query_id, node)"""
)
def multi_hop_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products near the brand and the title of every fiftieth product that has a vector."""
    t = tables(spark, sf_dir)
    asked = inputs.vector_queries(t)
    entities = inputs.entities(t).join(asked.select("query_id"), "query_id", "left_semi")
    found, _ = linking.multi_hop(asked, t.nodes, t.edges, entities, embeddings=t.embeddings.select("id", "embedding"), fuzzy=False)
    return found.withColumn("score", F.round("score", 6))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_QUESTIONS = f"""questions AS (
  SELECT CASE p_partkey % 6 WHEN 0 THEN 'Compare ' || p_name || ' vs ' || p_brand WHEN 1 THEN 'accessories from ' || p_brand WHEN 2 THEN p_name || ' under $500'
    WHEN 3 THEN 'What works with ' || p_brand || '?' WHEN 4 THEN 'best brands of ' || p_name ELSE 'Trending ' || p_name END AS query FROM part
  UNION ALL SELECT text FROM conversations WHERE role = 'user' AND text IS NOT NULL
  UNION ALL SELECT unnest([{', '.join(_quoted(q) for q, _ in evaluate.EVAL_QUERIES)}]))"""


def _any(values: list[str], test: str) -> str:
    return "(" + " OR ".join(test.format(_quoted(v)) for v in values) + ")"


_HIT = lambda words, stems, phrases: f"({_any(words, 'list_contains(tokens, {})')} OR {_any(stems, 'len(list_filter(tokens, lambda t: contains(t, {}))) > 0')} OR {_any(phrases, 'contains(q, {})')})"
_ROUTED = f"""{_QUESTIONS}, lowered AS (SELECT query, lower(query) AS q, regexp_extract_all(lower(query), '[a-z0-9'']+') AS tokens FROM questions),
routed AS (SELECT query, CASE WHEN {_HIT(answer.GLOBAL_WORDS, answer.GLOBAL_STEMS, answer.GLOBAL_PHRASES)} THEN 'global'
  WHEN {_HIT(answer.MULTI_HOP_WORDS, answer.MULTI_HOP_STEMS, answer.MULTI_HOP_PHRASES)} THEN 'multi_hop' ELSE 'local' END AS route FROM lowered)"""


@query(f"WITH {_ROUTED} SELECT query, route FROM routed")
def route_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.questions(spark, sf_dir).select("query", answer.route(F.col("query")).alias("route"))


@query(f"WITH {_ROUTED} SELECT route, count(*)::BIGINT AS n FROM routed GROUP BY 1")
def route_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.questions(spark, sf_dir).groupBy(answer.route(F.col("query")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"WITH {_QUESTIONS} SELECT query, array_to_string(list_filter(string_split(trim(regexp_replace(query, '\s+', ' ', 'g')), ' '), lambda w: length(w) > 3 AND regexp_matches(w, '^\p{{Lu}}')), '|') AS entities FROM questions")
def entity_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.questions(spark, sf_dir).select("query", F.array_join(answer.fallback_entities(F.col("query")), "|").alias("entities"))


def _prefix_sql(words: str) -> str:
    tests = [f"(length(array_to_string({words}[1:{k}], ' ')) >= 8 AND contains(a, array_to_string({words}[1:{k}], ' ')))" for k in evaluate.PREFIX_WORDS]
    stops = ", ".join(_quoted(w) for w in evaluate.CITE_STOP_WORDS)
    return f"({' OR '.join(tests)} OR (length({words}[1]) >= 4 AND {words}[1] NOT IN ({stops}) AND contains(a, {words}[1])))"


_SQUEEZED = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query(
    rf"""WITH answers AS (SELECT doc_id, {_SQUEEZED} AS a FROM documents WHERE text IS NOT NULL), names AS (SELECT item_id, string_split({_SQUEEZED}, ' ') AS w FROM benchmark WHERE text IS NOT NULL)
    SELECT item_id, count(*)::BIGINT AS n_documents FROM names JOIN answers ON {_prefix_sql('w')} GROUP BY 1"""
)
def cites_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents cite each benchmark text."""
    names = materialize(inputs.table(spark, sf_dir, "benchmark").filter("text is not null").select("item_id", evaluate.needle(F.split(evaluate.normal(F.col("text")), " ")).alias("needle")), "names")
    docs = inputs.table(spark, sf_dir, "documents").filter("text is not null").select(evaluate.normal(F.col("text")).alias("answer"))
    found = lookup.containing(docs, "answer", names).groupBy("needle").agg(F.count(F.lit(1)).alias("n_documents"))
    return names.join(found, "needle").groupBy("item_id").agg(F.sum("n_documents").alias("n_documents"))


@query(
    f"""WITH {_ROUTED}, scored AS (SELECT route AS type, CASE WHEN length(query) % 5 = 0 THEN 'local' ELSE route END AS used, length(query) > 30 AS nonempty, length(query) % 3 = 0 AS cites, route = 'multi_hop' AND length(query) % 5 <> 0 AS graph, (length(query) % 7)::DOUBLE AS s FROM routed),
    by_route AS (SELECT type, used, count(*) AS c FROM scored GROUP BY 1, 2)
    SELECT type, count(*)::BIGINT AS n, round(avg(nonempty::INT), 3) AS nonempty_rate, round(avg(cites::INT), 3) AS cites_rate, round(avg(graph::INT), 3) AS used_graph_rate, round(avg(s), 2) AS avg_latency_s,
           (SELECT string_agg(used || ': ' || c, ', ' ORDER BY used) FROM by_route b WHERE b.type = scored.type) AS routes FROM scored GROUP BY type"""
)
def ablation_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregate over every question, with outcomes that the question's length decides."""
    n = F.length("query")
    q = inputs.questions(spark, sf_dir).withColumn("type", answer.route(F.col("query")))
    rows = q.select("type", F.when(n % 5 == 0, "local").otherwise(F.col("type")).alias("route"), (n > 30).alias("answer_nonempty"), (n % 3 == 0).alias("cites_sources"), ((F.col("type") == "multi_hop") & (n % 5 != 0)).alias("used_graph"), (n % 7).cast("double").alias("latency_s"))
    return evaluate.aggregate(rows)


@query()
def token_set_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part name against its supplier-like storefront spelling; tests hold the ratio against its definition."""
    part = inputs.table(spark, sf_dir, "part")
    return part.select("p_partkey", F.round(token_set_ratio_udf(F.lower("p_name"), F.lower(F.concat_ws(" ", "p_brand", "p_name", "p_type"))), 3).alias("ratio"))


@query()
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled queries answered end to end by the offline models."""
    from graphloom.engine import Engine

    return Engine.from_tables(spark, sf_dir).answer_batch(spark.createDataFrame([(i, q) for i, (q, _) in enumerate(evaluate.EVAL_QUERIES)], "query_id bigint, query string"))
