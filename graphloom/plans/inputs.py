"""The graph over the star schema's tables that registered queries share, and its SQL.

A session builds the graph of a folder once and writes it to shared storage,
as the stages of a build do.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import brand_key
from graphloom.operators import construct, features, graph, similarity
from graphloom.operators.evaluate import EVAL_QUERIES
from graphloom.sources.catalog import from_star_schema
from graphloom.storage import materialize, stamp

#: The synthetic vectors are far apart; the API's default threshold would link none of them.
THRESHOLD = 0.35


class Tables:
    """The graph of a folder; each part is built when it is first read, so nodes and terms don't wait for the search of neighbours."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.catalog = catalog(spark, sf_dir)
        self.embeddings = embeddings(spark, sf_dir)

    @cached_property
    def _log(self) -> DataFrame:
        return materialize(construct.edge_log(self.catalog), "edge-log")

    @cached_property
    def _products(self) -> DataFrame:
        return materialize(construct.products(self.catalog), "products")

    @cached_property
    def _features(self) -> DataFrame:
        return materialize(features.feature_edges(self._products), "feature-writes")

    @cached_property
    def nodes(self) -> DataFrame:
        """All nodes; similarity writes mention none that isn't there."""
        terms = self._features.groupBy(F.col("v").alias("node_id")).agg(F.min("seq").alias("node_ord"))
        null = lambda t, n: F.lit(None).cast(t).alias(n)
        terms = terms.select("node_id", F.lit("feature").alias("type"), F.expr("substring(node_id, 6)").alias("name"), null("string", "description"), null("string", "price"), null("double", "rating"), "node_ord")
        return materialize(construct.nodes(self.catalog, self._log).unionByName(terms), "nodes")

    @cached_property
    def edges(self) -> DataFrame:
        similar = similar_writes(self.catalog, self._products, self.embeddings)
        return materialize(construct.upsert(self._log.unionByName(self._features).unionByName(similar)), "edges")

    @cached_property
    def adj(self) -> DataFrame:
        return graph.adjacency(self.edges)


_built: dict[tuple, Tables] = {}
_catalogs: dict[tuple, DataFrame] = {}
#: Tables that the graph is built from.
_FROM = ("part", "lineitem", "nation", "region", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("p:"), F.col("vec_id").cast("string")).alias("id"), "vec_id", "label", "embedding")


def similar_writes(catalog: DataFrame, products: DataFrame, vectors: DataFrame) -> DataFrame:
    brands = construct.brand_rows(catalog).select(F.col("parent_asin").alias("node_id"), F.col("key").alias("brand"))
    return similarity.similar_to(products.select("node_id", "first_row"), vectors.select("id", "embedding"), brands, threshold=THRESHOLD)


def build(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The built graph, kept for the session until one of its tables changes."""
    key = _key(spark, sf_dir)
    if key not in _built:
        _built[key] = build(spark, sf_dir)
    return _built[key]


def _key(spark: SparkSession, sf_dir: str) -> tuple:
    return (spark.sparkContext.applicationId, sf_dir, *(stamp(spark, f"{sf_dir}/{t}.parquet") for t in _FROM))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog alone, without the graph."""
    key = _key(spark, sf_dir)
    if key not in _catalogs:
        _catalogs[key] = materialize(from_star_schema(spark, sf_dir), "catalog")
    return _catalogs[key]


def seeds(t: Tables) -> DataFrame:
    """Every product whose number is divisible by 50 asks for its own neighbourhood."""
    own = t.catalog.filter(F.col("row_ord") % 50 == 0)
    return own.select(F.col("row_ord").alias("query_id"), F.col("parent_asin").alias("node"), F.lit(1).alias("seed_rank"))


def vector_queries(t: Tables) -> DataFrame:
    return t.embeddings.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query): a question about every part, every user turn, and the labelled queries."""
    name, brand, form = F.col("p_name"), F.col("p_brand"), F.col("p_partkey") % 6
    about = (
        F.when(form == 0, F.concat(F.lit("Compare "), name, F.lit(" vs "), brand))
        .when(form == 1, F.concat(F.lit("accessories from "), brand))
        .when(form == 2, F.concat(name, F.lit(" under $500")))
        .when(form == 3, F.concat(F.lit("What works with "), brand, F.lit("?")))
        .when(form == 4, F.concat(F.lit("best brands of "), name))
        .otherwise(F.concat(F.lit("Trending "), name))
    )
    parts = table(spark, sf_dir, "part").select(about.alias("query"))
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.col("text").alias("query"))
    labelled = spark.createDataFrame([(q,) for q, _ in EVAL_QUERIES], "query string")
    return parts.unionByName(turns).unionByName(labelled).filter("query is not null")


def entities(t: Tables) -> DataFrame:
    """(query_id, entity_rank, entity): brand and title of every fiftieth product."""
    own = t.catalog.filter(F.col("row_ord") % 50 == 0).select(F.col("row_ord").alias("query_id"), F.posexplode(F.array(F.trim(F.regexp_replace("store", "Store", "")), F.col("title"))).alias("entity_rank", "entity"))
    return own.withColumn("entity_rank", F.col("entity_rank") + 1)


def labels(t: Tables) -> DataFrame:
    """(node, community): fixed communities of all nodes, by the length of the id and the product's number."""
    n = F.expr("try_cast(substring(node_id, 3) as bigint)")
    return t.nodes.select(F.col("node_id").alias("node"), F.when(F.col("type") == "product", n % 29).otherwise(F.length("node_id") % 29).cast("bigint").alias("community"))


def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storefront spellings of every supplier's name, with their key."""
    s = table(spark, sf_dir, "supplier")
    name, form = F.col("s_name"), F.col("s_suppkey") % 4
    spelled = F.when(form == 0, F.concat(F.lit("Visit the "), name, F.lit(" Store"))).when(form == 1, F.concat(F.lit("by "), name)).when(form == 2, F.concat(F.lit("  "), F.upper(name), F.lit("  store "))).otherwise(name)
    return s.select("s_suppkey", spelled.alias("brand")).withColumn("key", brand_key(F.col("brand")))


def _seq(stage: int, row: str, step: int, element: str) -> str:
    return f"((({stage}::BIGINT * 68719476736 + {row}) * 16 + {step}) * 1048576 + {element})"




def key_sql(x: str) -> str:
    inner = rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    for pattern in (r"^visit\s+(the\s+)?", r"\s+store$", r"^by\s+"):
        inner = f"regexp_replace({inner}, '{pattern}', '', 'i')"
    return rf"regexp_replace(regexp_replace(lower({inner}), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


CATALOG = f"""
lines AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p FROM lineitem),
pairs AS (SELECT a.p, b.p AS o, 1 AS step, count(*) AS c FROM lines a JOIN lines b ON a.k = b.k AND b.n = a.n + 1 GROUP BY a.p, b.p
          UNION ALL SELECT a.p, b.p, 2, count(*) FROM lines a JOIN lines b ON a.k = b.k AND b.n = a.n + 2 GROUP BY a.p, b.p),
raw_catalog AS (
  SELECT 'p:' || p_partkey AS parent_asin, p_name AS title, p_partkey AS row_ord, p_type, p_size, p_brand, r_name, n_name,
         CASE WHEN p_partkey % 97 = 0 THEN '   ' WHEN p_partkey % 5 = 0 THEN 'Visit the ' || p_brand || ' Store' WHEN p_partkey % 5 = 1 THEN p_brand
              WHEN p_partkey % 5 = 2 THEN 'by ' || p_brand WHEN p_partkey % 5 = 3 THEN upper(p_brand) ELSE ' ' || p_brand || '  Store' END AS raw_brand,
         p_retailprice::VARCHAR AS price, (p_size % 50) / 10.0::DOUBLE AS rating,
         (SELECT count(*) FROM lines WHERE p = p_partkey) AS rating_number
  FROM part LEFT JOIN (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) g ON p_partkey % 25 = n_nationkey),
catalog AS (
  SELECT *, nullif(regexp_replace(raw_brand, '^\\s+|\\s+$', '', 'g'), '') AS brand,
         title || ' ' || p_type || ' | size ' || p_size || ' A ' || title || ' made by ' || p_brand AS description FROM raw_catalog),
brand_rows AS (SELECT parent_asin, row_ord, brand, {key_sql('brand')} AS key FROM catalog WHERE brand IS NOT NULL),
brand_nodes AS (SELECT 'brand:' || key AS node_id, arg_min(brand, length(brand) * 1000000000 + row_ord) AS name FROM brand_rows GROUP BY key),
steps AS (SELECT parent_asin, row_ord, 0 AS spot, r_name AS name, NULL AS before FROM catalog WHERE r_name IS NOT NULL
          UNION ALL SELECT parent_asin, row_ord, 2, n_name, r_name FROM catalog WHERE n_name IS NOT NULL
          UNION ALL SELECT parent_asin, row_ord, 128, p_type, NULL FROM catalog WHERE p_type IS NOT NULL),
category_nodes AS (SELECT 'cat:' || lower(name) AS node_id, arg_max(name, {_seq(0, 'row_ord', 1, 'spot')}) AS name FROM steps GROUP BY 1),
has_brand AS (SELECT parent_asin AS u, 'brand:' || key AS v, 'has_brand' AS type, NULL::DOUBLE AS weight, {_seq(0, 'row_ord', 0, '1')} AS seq FROM brand_rows),
in_category AS (SELECT parent_asin AS u, 'cat:' || lower(name) AS v, 'in_category' AS type, NULL::DOUBLE AS weight, {_seq(0, 'row_ord', 1, 'spot')} AS seq FROM steps),
category_parent AS (SELECT 'cat:' || lower(before) AS u, 'cat:' || lower(name) AS v, 'category_parent' AS type, NULL::DOUBLE AS weight, {_seq(0, 'row_ord', 1, 'spot + 1')} AS seq FROM steps WHERE before IS NOT NULL),
related AS (SELECT p, o, step, row_number() OVER (PARTITION BY p, step ORDER BY c DESC, o) - 1 AS spot FROM pairs WHERE step = 2 OR c >= 2),
bought_together AS (SELECT 'p:' || p AS u, 'p:' || o AS v, 'bought_together' AS type, 2.0::DOUBLE AS weight, {_seq(0, 'p', 2, 'spot')} AS seq FROM related
                    WHERE step = 1 AND p IN (SELECT p_partkey FROM part) AND o IN (SELECT p_partkey FROM part)),
also_bought AS (SELECT 'p:' || p AS u, 'p:' || o AS v, 'also_bought' AS type, 1.0::DOUBLE AS weight, {_seq(0, 'p', 3, 'spot')} AS seq FROM related
                WHERE step = 2 AND spot < 10 AND p IN (SELECT p_partkey FROM part) AND o IN (SELECT p_partkey FROM part)),
writes AS (SELECT * FROM has_brand UNION ALL SELECT * FROM in_category UNION ALL SELECT * FROM category_parent UNION ALL SELECT * FROM bought_together UNION ALL SELECT * FROM also_bought)"""


def _upsert(log: str) -> str:
    return f"SELECT least(u, v) AS u, greatest(u, v) AS v, arg_max(type, seq) AS type, arg_max(weight, seq) FILTER (WHERE weight IS NOT NULL) AS weight, min(seq) AS first_seq FROM {log} GROUP BY 1, 2"


BUILT = f"""{CATALOG},
built_edges AS ({_upsert('writes')})"""

STOPS = "(" + ", ".join(f"'{w}'" for w in features.STOP_WORDS) + ")"

TFIDF = rf"""
term_words AS (SELECT parent_asin AS node_id, row_ord, list_filter(regexp_extract_all(lower(description), '\w\w+'), lambda w: w NOT IN {STOPS}) AS w FROM catalog),
term_rows AS (SELECT node_id, unnest(w) AS term FROM term_words
              UNION ALL SELECT node_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM term_words WHERE len(w) > 1),
term_tf AS (SELECT node_id, term, count(*) AS tf FROM term_rows GROUP BY 1, 2),
vocabulary AS (SELECT term, sum(tf) AS uses, count(*) AS df FROM term_tf GROUP BY term ORDER BY uses DESC, term LIMIT 5000),
term_raw AS (SELECT node_id, term, tf * (ln((1 + (SELECT count(*) FROM catalog))::DOUBLE / (1 + df)) + 1) AS raw FROM term_tf JOIN vocabulary USING (term)),
term_weight AS (SELECT node_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY node_id)) AS weight FROM term_raw),
tfidf AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY round(weight, 9) DESC, term) AS rank FROM term_weight QUALIFY rank <= 5)"""

NEAR = """
vectors AS (SELECT 'p:' || vec_id AS id, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
known_vectors AS (SELECT * FROM vectors WHERE vec_id IN (SELECT p_partkey FROM part)),
near AS (SELECT a.id, b.id AS nbr, list_dot_product(a.e, b.e) AS score, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.e, b.e) DESC, b.id) AS rank
         FROM known_vectors a JOIN known_vectors b ON a.id <> b.id QUALIFY rank <= 5)"""

SIMILAR = f"""{NEAR},
similar_to AS (SELECT n.id AS u, n.nbr AS v, 'similar_to' AS type, n.score AS weight, {_seq(2, 'c.row_ord', 0, 'n.rank')} AS seq
               FROM near n JOIN catalog c ON c.parent_asin = n.id LEFT JOIN brand_rows x ON x.parent_asin = n.id LEFT JOIN brand_rows y ON y.parent_asin = n.nbr
               WHERE n.score >= {THRESHOLD} AND x.key IS DISTINCT FROM y.key)"""

GRAPH = f"""{CATALOG},{TFIDF},{SIMILAR},
has_feature AS (SELECT t.node_id AS u, 'feat:' || t.term AS v, 'has_feature' AS type, t.weight, {_seq(1, 'c.row_ord', 0, 't.rank')} AS seq FROM tfidf t JOIN catalog c ON c.parent_asin = t.node_id),
all_writes AS (SELECT * FROM writes UNION ALL SELECT * FROM has_feature UNION ALL SELECT * FROM similar_to),
edges AS ({_upsert('all_writes')}),
mentions AS (SELECT u AS node_id, seq FROM all_writes UNION ALL SELECT v, seq FROM all_writes UNION ALL SELECT parent_asin, {_seq(0, 'row_ord', 0, '0')} FROM catalog),
ords AS (SELECT node_id, min(seq) AS node_ord FROM mentions GROUP BY 1),
nodes AS (SELECT n.*, o.node_ord FROM (
    SELECT parent_asin AS node_id, 'product' AS type, title AS name, description, price, rating FROM catalog
    UNION ALL SELECT node_id, 'brand', name, NULL, NULL, NULL FROM brand_nodes
    UNION ALL SELECT node_id, 'category', name, NULL, NULL, NULL FROM category_nodes
    UNION ALL SELECT DISTINCT v, 'feature', substr(v, 6), NULL, NULL, NULL FROM has_feature) n JOIN ords o USING (node_id)),
adj AS (SELECT node, nbr, type, weight, seq, row_number() OVER (PARTITION BY node ORDER BY seq, nbr) AS pos FROM (
    SELECT u AS node, v AS nbr, type, weight, first_seq AS seq FROM edges UNION ALL SELECT v, u, type, weight, first_seq FROM edges WHERE u <> v) x)"""
