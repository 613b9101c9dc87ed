"""TF-IDF feature terms of products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.config import DEFAULTS
from graphloom.operators.construct import FEATURES, seq

#: Words that never become features: articles, pronouns, prepositions and auxiliaries of English.
STOP_WORDS = (
    "a an the and or but if then than so as of at by for from in into on onto off over under to up down out with without about after before between "
    "during through above below again further once here there when where why how all any both each few more most other some such no nor not only own same too very "
    "i me my we our ours you your yours he him his she her hers it its they them their theirs this that these those who whom which what "
    "am is are was were be been being have has had having do does did doing can could will would shall should may might must just now also"
).split()


def terms(docs: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """(node_id, term, tf): words of two characters or more and pairs of neighbours, after the stop words are gone."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?U)\w\w+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(list(stop_words)))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    # texts go to their node; all that follows stays there
    one = docs.select("node_id", "text").repartition("node_id").select("node_id", kept.alias("w"))
    flat = one.select("node_id", F.explode(F.concat("w", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>")))).alias("term"))
    return flat.groupBy("node_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(docs: DataFrame, *, max_features: int = DEFAULTS.max_features, top_k: int = DEFAULTS.features_per_product, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """(node_id, term, weight, rank): each text's ``top_k`` terms by TF-IDF, ties to the smaller term.

    The vocabulary is the ``max_features`` most used terms; idf is
    ln((1 + n) / (1 + df)) + 1, and each text's weights over the vocabulary have
    length 1. The vocabulary is bounded, so it is broadcast.
    """
    found = terms(docs, stop_words)
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    vocabulary = found.groupBy("term").agg(F.sum("tf").alias("uses"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("uses"), "term").limit(max_features)
    weighed = found.join(F.broadcast(vocabulary), "term").join(F.broadcast(n))
    weighed = weighed.withColumn("raw", F.col("tf") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1))
    sizes = weighed.groupBy("node_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("size"))
    scored = weighed.join(sizes, "node_id").withColumn("weight", F.col("raw") / F.col("size"))
    rank = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc(F.round("weight", 9)), "term"))
    return scored.withColumn("rank", rank).filter((F.col("rank") <= top_k) & (F.col("weight") > 0)).select("node_id", "term", "weight", "rank")


def feature_edges(products: DataFrame, *, max_features: int = DEFAULTS.max_features, top_k: int = DEFAULTS.features_per_product) -> DataFrame:
    """Edge writes product - ``feat:`` term, in the order of the products' rows; ``products`` is a result of ``construct.products``."""
    docs = products.select("node_id", F.coalesce(F.when(F.col("description") != "", F.col("description")), F.col("name")).alias("text"))
    order = products.select("node_id", F.col("first_row").alias("row"))
    found = tfidf(docs, max_features=max_features, top_k=top_k).join(order, "node_id")
    return found.select(F.col("node_id").alias("u"), F.concat(F.lit("feat:"), "term").alias("v"), F.lit("has_feature").alias("type"), "weight", seq(FEATURES, F.col("row"), 0, F.col("rank")).alias("seq"))
