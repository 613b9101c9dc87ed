"""Registered queries: scans, sinks, construction and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import construct, features, similarity
from graphloom.plans import inputs
from graphloom.plans.inputs import BUILT, CATALOG, GRAPH, NEAR, SIMILAR, TFIDF, tables
from graphloom.sources import artifacts
from graphloom.sources.catalog import most_reviewed
from graphloom.storage import scratch_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a builder under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _edges(df: DataFrame) -> DataFrame:
    return df.select("u", "v", "type", F.round("weight", 6).alias("weight"), "seq")


def _edge_sql(name: str, prelude: str = CATALOG) -> str:
    return f"WITH {prelude} SELECT u, v, type, round(weight, 6) AS weight, seq FROM {name}"


@query(f"WITH {CATALOG} SELECT parent_asin, title, rating_number::BIGINT AS rating_number FROM catalog WHERE title <> '' ORDER BY rating_number DESC, parent_asin LIMIT 1000")
def subsample_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the limit: the thousand most rated products."""
    return most_reviewed(inputs.catalog(spark, sf_dir), 1000).select("parent_asin", "title", "rating_number")


@query(f"WITH {CATALOG} SELECT parent_asin, description FROM catalog")
def description_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.products(inputs.catalog(spark, sf_dir)).select(F.col("node_id").alias("parent_asin"), "description")


@query(f"WITH {CATALOG} SELECT parent_asin, title AS name, price, rating FROM catalog")
def product_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.products(inputs.catalog(spark, sf_dir)).select(F.col("node_id").alias("parent_asin"), "name", "price", "rating")


@query(f"WITH {CATALOG} SELECT parent_asin, brand FROM brand_rows")
def brand_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.brand_rows(inputs.catalog(spark, sf_dir)).select("parent_asin", "brand")


@query(
    f"""WITH s AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Visit the ' || s_name || ' Store' WHEN 1 THEN 'by ' || s_name WHEN 2 THEN '  ' || upper(s_name) || '  store ' ELSE s_name END AS brand FROM supplier)
    SELECT s_suppkey, brand, {inputs.key_sql('brand')} AS key FROM s"""
)
def brand_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.canonical_names(spark, sf_dir)


@query(f"WITH {CATALOG} SELECT node_id, name FROM brand_nodes")
def brand_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.brand_nodes(inputs.catalog(spark, sf_dir))


@query(_edge_sql("has_brand"))
def has_brand_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(construct.has_brand(inputs.catalog(spark, sf_dir)))


@query(f"WITH {CATALOG} SELECT node_id, name FROM category_nodes")
def category_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.category_nodes(inputs.catalog(spark, sf_dir))


@query(_edge_sql("in_category"))
def in_category_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(construct.in_category(inputs.catalog(spark, sf_dir)))


@query(_edge_sql("category_parent"))
def category_parent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(construct.category_parent(inputs.catalog(spark, sf_dir)))


@query(_edge_sql("bought_together"))
def bought_together_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(construct.bought_together(inputs.catalog(spark, sf_dir)))


@query(_edge_sql("also_bought"))
def also_bought_cap10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(construct.also_bought(inputs.catalog(spark, sf_dir)))


@query(f"WITH {BUILT} SELECT u, v, type, round(weight, 6) AS weight, first_seq FROM built_edges")
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.upsert(construct.edge_log(inputs.catalog(spark, sf_dir))).select("u", "v", "type", F.round("weight", 6).alias("weight"), "first_seq")


@query(f"WITH {GRAPH} SELECT node_id, type, name, description, price, rating, node_ord FROM nodes")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).nodes.select("node_id", "type", "name", "description", "price", "rating", "node_ord")


@query(f"WITH {GRAPH} SELECT u, v, type, round(weight, 6) AS weight, first_seq FROM edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build: construction, feature terms and similarity edges, from the tables."""
    return inputs.build(spark, sf_dir).edges.select("u", "v", "type", F.round("weight", 6).alias("weight"), "first_seq")


@query(f"WITH {CATALOG},{TFIDF} SELECT node_id, term, round(weight, 6) AS weight, rank::INTEGER AS rank FROM tfidf")
def tfidf_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = construct.products(inputs.catalog(spark, sf_dir)).select("node_id", F.col("description").alias("text"))
    return features.tfidf(products).select("node_id", "term", F.round("weight", 6).alias("weight"), "rank")


@query(_edge_sql("similar_to", f"{CATALOG},{SIMILAR}"))
def similar_to_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return _edges(inputs.similar_writes(t.catalog, construct.products(t.catalog), t.embeddings))


@query(f"WITH {NEAR} SELECT id, nbr, round(score, 6) AS score, rank::INTEGER AS rank FROM near")
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = inputs.embeddings(spark, sf_dir)
    parts = inputs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"))
    own = v.join(parts, "vec_id", "left_semi").select("id", "embedding")
    return similarity.knn(own, own, 5).select("id", "nbr", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {GRAPH} SELECT node_id, type, name, node_ord FROM nodes")
def artifact_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes written to Parquet and to JSON and read back; rows that both hold."""
    t = tables(spark, sf_dir)
    folder = scratch_path(spark, "artifacts")
    artifacts.save(t.nodes, folder, "nodes")
    artifacts.save(t.nodes.select("node_id", "type", "name", "node_ord"), folder, "report")
    back = artifacts.load(spark, folder, "nodes")
    told = spark.read.schema("node_id string, type string, name string, node_ord bigint").json(f"{folder}/report")
    return back.select("node_id", "type", "name", "node_ord").intersect(told)


@query(
    """SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 5 = 0"""
)
def embedding_cache_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to encode when the cache holds every third document and every fifteenth of these under another text."""
    texts = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    changed = F.when(F.col("id") % 5 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))
    cache = texts.filter("id % 3 = 0").select("id", F.xxhash64(changed).alias("text_hash"))
    return artifacts.stale(texts, cache).select("id")
