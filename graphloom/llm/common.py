"""Pieces that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITESPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch; texts may be long, so batches hold few rows.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small enough for a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text, in order; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")


def count_of(text: Column, chars: str) -> Column:
    """How many characters of a text belong to a regular-expression class."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of the input can't clash."""
    return docs.select(*[docs[n] for n in names])


def apart(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns beside ``row``, a struct of all others, so that whatever their names, they can't clash."""
    rest = [docs[c] for c in docs.columns if c not in names]
    return docs.select(F.struct(*(rest or [F.lit(1).alias("none")])).alias("row"), *[docs[n].alias(n) for n in names])
