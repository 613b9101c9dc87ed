"""Incremental graph ingest: edge writes arrive as a stream and are merged into the stored edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators import construct
from graphloom.plans import inputs
from graphloom.plans.construction import query
from graphloom.storage import scratch_path

_LOG = "u string, v string, type string, weight double, seq bigint"


def merger(spark: SparkSession, folder: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function. Each batch's writes are reduced to one row per pair with their own places,
    and kept as a delta; a batch that is replayed overwrites its own delta, so each write counts once."""

    def merge(batch: DataFrame, epoch: int) -> None:
        first = batch.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(
            F.max(F.struct("seq", "type")).alias("last"),
            F.max(F.when(F.col("weight").isNotNull(), F.struct("seq", "weight"))).alias("weighed"),
            F.min("seq").alias("first_seq"),
        )
        first.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return merge


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The edges after all merged batches, as ``construct.upsert`` would have them, whatever the batches were."""
    deltas = spark.read.parquet(folder)
    merged = deltas.groupBy("u", "v").agg(F.max("last").alias("last"), F.max("weighed").alias("weighed"), F.min("first_seq").alias("first_seq"))
    return merged.select("u", "v", F.col("last.type").alias("type"), F.col("weighed.weight").alias("weight"), "first_seq")


def ingest(writes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Start merging a stream of edge writes (u, v, type, weight, seq) into ``folder``; ends when the source is used up."""
    return writes.writeStream.foreachBatch(merger(writes.sparkSession, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@query(f"WITH {inputs.BUILT} SELECT u, v, type, round(weight, 6) AS weight, first_seq FROM built_edges")
def streaming_edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge log as a stream of several files, merged batch by batch; the same edges as a build at once."""
    source, folder, checkpoint = (scratch_path(spark, x) for x in ("stream-source", "stream-edges", "stream-checkpoint"))
    construct.edge_log(inputs.catalog(spark, sf_dir)).repartition(4, "u").write.parquet(source)
    writes = spark.readStream.schema(_LOG).option("maxFilesPerTrigger", 2).parquet(source)
    running = ingest(writes, folder, checkpoint)
    running.awaitTermination()
    return current(spark, folder).select("u", "v", "type", F.round("weight", 6).alias("weight"), "first_seq")
