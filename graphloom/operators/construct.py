"""Graph construction: a log of edge writes, and tables that replay it.

A write is (u, v, type, weight, seq). ``seq`` orders all writes: by stage, then
catalog row, step inside the row and element. The graph is simple and
undirected, so writes of one unordered pair merge: the last type and the last
weight that was given win, and the first write decides the pair's place among
its ends' neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.config import DEFAULTS
from graphloom.functions import text

#: Stages of the log.
BUILD, FEATURES, SIMILAR = 0, 1, 2
_ROWS, _STEPS, _ELEMENTS = 1 << 36, 1 << 4, 1 << 20
_LOG = ["u", "v", "type", "weight", "seq"]


def seq(stage: int, row: Column, step: int, element: Column | int) -> Column:
    """The place of a write; for up to 2**36 rows and 2**20 elements."""
    return ((F.lit(stage * _ROWS) + row.cast("bigint")) * _STEPS + step) * _ELEMENTS + (F.lit(element) if isinstance(element, int) else element.cast("bigint"))


def products(catalog: DataFrame) -> DataFrame:
    """One row per product with its name, description, price, rating and brand; a repeated id takes its last row."""
    kind = dict(catalog.dtypes)
    pick = F.struct(
        F.coalesce("title", F.lit("")).alias("name"),
        text.description(F.col("title"), F.col("features"), F.col("description")).alias("description"),
        F.col("price").cast("string").alias("price"),
        F.col("average_rating").cast("double").alias("rating"),
    )
    brand = text.brand_of(F.col("details"), F.col("store")) if kind["details"].startswith("map") else text.non_empty(text.strip(text.non_empty(F.col("store"))))
    rows = catalog.filter("parent_asin is not null").select("parent_asin", "row_ord", pick.alias("p"), brand.alias("brand"))
    return rows.groupBy("parent_asin").agg(F.max_by("p", "row_ord").alias("p"), F.min("row_ord").alias("first_row"), F.max_by("brand", "row_ord").alias("brand")).select(F.col("parent_asin").alias("node_id"), "p.*", "brand", "first_row")


def brand_rows(catalog: DataFrame) -> DataFrame:
    """(parent_asin, row_ord, brand, key) of the rows that name a brand."""
    named = catalog.select("parent_asin", "row_ord", text.brand_of(F.col("details"), F.col("store")).alias("brand")).filter("brand is not null")
    return named.withColumn("key", text.brand_key(F.col("brand"))).filter("parent_asin is not null")


def brand_nodes(catalog: DataFrame) -> DataFrame:
    """One brand per key, shown by its shortest spelling, the first of these on ties."""
    best = F.min_by("brand", F.struct(F.length("brand"), "row_ord"))
    return brand_rows(catalog).groupBy("key").agg(best.alias("name")).select(F.concat(F.lit("brand:"), "key").alias("node_id"), "name")


def has_brand(catalog: DataFrame) -> DataFrame:
    rows = brand_rows(catalog)
    return rows.select(F.col("parent_asin").alias("u"), F.concat(F.lit("brand:"), "key").alias("v"), F.lit("has_brand").alias("type"), F.lit(None).cast("double").alias("weight"), seq(BUILD, F.col("row_ord"), 0, 1).alias("seq"))


def category_steps(catalog: DataFrame) -> DataFrame:
    """(parent_asin, row_ord, at, name, before): every element of every path, with the one before it."""
    kind = dict(catalog.dtypes)["categories"]
    paths = catalog.filter("parent_asin is not null").select("parent_asin", "row_ord", F.posexplode(text.as_paths(F.col("categories"), kind)).alias("path_no", "path"))
    steps = F.transform("path", lambda x, i: F.struct(x.alias("name"), F.get("path", i - 1).alias("before"), i.alias("step")))
    flat = paths.select("parent_asin", "row_ord", "path_no", F.inline(steps)).filter("name is not null and name <> ''")
    return flat.withColumn("at", F.col("path_no") * 128 + F.col("step") * 2).drop("path_no", "step")


def category_id(name: Column) -> Column:
    return F.concat(F.lit("cat:"), F.lower(name))


def category_nodes(catalog: DataFrame) -> DataFrame:
    """One category per lower-cased name, shown by its last spelling."""
    steps = category_steps(catalog).withColumn("seq", seq(BUILD, F.col("row_ord"), 1, F.col("at")))
    return steps.groupBy(category_id(F.col("name")).alias("node_id")).agg(F.max_by("name", "seq").alias("name"))


def in_category(catalog: DataFrame) -> DataFrame:
    s = category_steps(catalog)
    return s.select(F.col("parent_asin").alias("u"), category_id(F.col("name")).alias("v"), F.lit("in_category").alias("type"), F.lit(None).cast("double").alias("weight"), seq(BUILD, F.col("row_ord"), 1, F.col("at")).alias("seq"))


def category_parent(catalog: DataFrame) -> DataFrame:
    """Edges between consecutive path elements; equal neighbours make a self-loop."""
    s = category_steps(catalog).filter("before is not null and before <> ''")
    return s.select(category_id(F.col("before")).alias("u"), category_id(F.col("name")).alias("v"), F.lit("category_parent").alias("type"), F.lit(None).cast("double").alias("weight"), seq(BUILD, F.col("row_ord"), 1, F.col("at") + 1).alias("seq"))


def _related(catalog: DataFrame, members: Column, kind: str, weight: float, step: int) -> DataFrame:
    one = catalog.filter("parent_asin is not null").select(F.col("parent_asin").alias("u"), "row_ord", F.posexplode(members).alias("at", "v"))
    known = catalog.select(F.col("parent_asin").alias("v")).distinct()
    found = one.join(known, "v", "left_semi")
    return found.select("u", "v", F.lit(kind).alias("type"), F.lit(weight).alias("weight"), seq(BUILD, F.col("row_ord"), step, F.col("at")).alias("seq"))


def bought_together(catalog: DataFrame) -> DataFrame:
    """Edges to products of the catalog that are listed as bought together; a product that lists itself makes a self-loop."""
    return _related(catalog, F.col("bought_together"), "bought_together", DEFAULTS.bought_together_weight, 2)


def also_bought(catalog: DataFrame) -> DataFrame:
    """The first ten listed products, those of the catalog only; the cap comes before the test."""
    return _related(catalog, F.slice("also_buy", 1, DEFAULTS.also_bought_cap), "also_bought", DEFAULTS.also_bought_weight, 3)


def edge_log(catalog: DataFrame) -> DataFrame:
    """Every edge write of the build."""
    parts = [f(catalog) for f in (has_brand, in_category, category_parent, bought_together, also_bought)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*_LOG)


def upsert(log: DataFrame) -> DataFrame:
    """The edges after replaying a log: u <= v, last type, last given weight, first place."""
    a, b = F.least("u", "v"), F.greatest("u", "v")
    one = log.groupBy(a.alias("u"), b.alias("v")).agg(
        F.max_by("type", "seq").alias("type"),
        F.max_by("weight", F.when(F.col("weight").isNotNull(), F.col("seq"))).alias("weight"),
        F.min("seq").alias("first_seq"),
    )
    return one


def nodes(catalog: DataFrame, log: DataFrame) -> DataFrame:
    """All nodes; node_ord is the place of the first write that mentions the node."""
    ends = log.select(F.col("u").alias("node_id"), "seq").unionByName(log.select(F.col("v").alias("node_id"), "seq"))
    own = products(catalog)
    seen = ends.unionByName(own.select("node_id", seq(BUILD, F.col("first_row"), 0, 0).alias("seq"))).groupBy("node_id").agg(F.min("seq").alias("node_ord"))
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    kinds = own.select("node_id", F.lit("product").alias("type"), "name", "description", "price", "rating")
    for kind, frame in (("brand", brand_nodes(catalog)), ("category", category_nodes(catalog))):
        kinds = kinds.unionByName(frame.select("node_id", F.lit(kind).alias("type"), "name", null("string", "description"), null("string", "price"), null("double", "rating")))
    return kinds.join(seen, "node_id")


def build_graph(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a catalog."""
    log = edge_log(catalog)
    return nodes(catalog, log), upsert(log)


def add_writes(edges: DataFrame, log: DataFrame) -> DataFrame:
    """Edges after further writes; the old edges' places come first."""
    old = edges.select("u", "v", "type", "weight", F.col("first_seq").alias("seq"))
    return upsert(old.unionByName(log.select(*_LOG)))
