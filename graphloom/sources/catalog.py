"""The product catalog: scans, the working subset, and a catalog made from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom import schema
from graphloom.config import DEFAULTS


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """All shards as one table; columns that are missing read as null."""
    return spark.read.schema(schema.CATALOG).parquet(*paths)


def most_reviewed(catalog: DataFrame, n: int = DEFAULTS.top_products) -> DataFrame:
    """The ``n`` titled products with the most ratings, ties to the smaller id. The filter reaches the
    scan, and the order and the limit run as one top-n per task."""
    titled = catalog.filter("title is not null and title <> '' and rating_number is not null")
    return titled.orderBy(F.desc("rating_number"), "parent_asin").limit(n)


def sample_reviews(reviews: DataFrame, per_product: int = 3) -> DataFrame:
    """At most ``per_product`` reviews of each product, in the order of review_ord."""
    rank = F.row_number().over(Window.partitionBy("parent_asin").orderBy("review_ord"))
    return reviews.withColumn("_rank", rank).filter(F.col("_rank") <= per_product).drop("_rank")


def linked_only(catalog: DataFrame) -> DataFrame:
    """Titled products that have co-purchases, a brand or categories."""
    some = (F.size("bought_together") > 0) | (F.size("also_buy") > 0) | F.try_element_at("details", F.lit("Brand")).isNotNull() | (F.size("categories") > 0)
    return catalog.filter((F.col("title") != "") & some)


def from_star_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of ``part``: nations as category paths, line items as ratings and baskets.

    Parts on neighbouring lines of an order were bought together (twice at
    least); parts two lines on were also bought. Lines go to their order once, where
    frames over line numbers see both, so no basket is expanded into all its pairs.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")

    by_line = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    baskets = lines.filter("l_orderkey is not null and l_linenumber is not null")
    on = lambda step: F.collect_list(F.struct("l_partkey")).over(by_line.rangeBetween(step, step))
    baskets = baskets.select("l_partkey", on(1).alias("on_1"), on(2).alias("on_2"))

    def followed(step: int, least: int, name: str) -> DataFrame:
        later = baskets.select("l_partkey", F.explode(f"on_{step}").alias("on")).select("l_partkey", F.col("on.l_partkey").alias("other"))
        pairs = later.groupBy("l_partkey", "other").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
        ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "other")))
        return pairs.groupBy("l_partkey").agg(F.transform(ordered, lambda x: F.concat(F.lit("p:"), x["other"].cast("string"))).alias(name))

    ratings = lines.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("rating_number"))
    paths = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    key, brand = F.col("p_partkey"), F.col("p_brand")
    shop = F.concat(F.lit("Visit the "), brand, F.lit(" Store"))
    form = F.pmod(key, F.lit(5))
    details = (
        F.when(F.pmod(key, F.lit(97)) == 0, F.create_map(F.lit("Brand"), F.lit("   ")))
        .when(form == 0, F.create_map(F.lit("Brand"), shop))
        .when(form == 1, F.create_map(F.lit("Brand"), brand))
        .when(form == 2, F.create_map(F.lit("Manufacturer"), F.concat(F.lit("by "), brand)))
        .when(form == 3, F.create_map(F.lit("Brand"), F.upper(brand)))
    )
    part = read("part").join(paths, F.pmod(key, F.lit(25)) == F.col("n_nationkey"), "left").join(ratings, key == F.col("l_partkey"), "left").drop("l_partkey")
    for step, least, name in ((1, 2, "bought_together"), (2, 1, "also_buy")):
        part = part.join(followed(step, least, name), key == F.col("l_partkey"), "left").drop("l_partkey")
    return part.select(
        F.concat(F.lit("p:"), key.cast("string")).alias("parent_asin"),
        F.col("p_name").alias("title"),
        F.array(F.col("p_type"), F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("features"),
        F.array(F.concat_ws(" ", F.lit("A"), F.col("p_name"), F.lit("made by"), brand)).alias("description"),
        F.array(F.array("r_name", "n_name"), F.array("p_type")).alias("categories"),
        details.alias("details"),
        F.concat(F.lit(" "), brand, F.lit("  Store")).alias("store"),
        F.col("p_retailprice").cast("string").alias("price"),
        (F.pmod(F.col("p_size"), F.lit(50)) / 10.0).alias("average_rating"),
        F.coalesce("rating_number", F.lit(0)).cast("bigint").alias("rating_number"),
        F.coalesce("bought_together", F.array().cast("array<string>")).alias("bought_together"),
        F.coalesce("also_buy", F.array().cast("array<string>")).alias("also_buy"),
        key.cast("bigint").alias("row_ord"),
    )
