"""Keeping co-citation counts up as contexts arrive.

Counts are additive per site, so a batch's counts are added to those of the batches before; a site's
contexts must arrive in one batch (papers are written whole). Each batch's counts are a table of its own, so
that one that is run again replaces itself, and reading adds them up."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import graph
from ..session import scratch_path


def upkeep(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes the counts of each micro-batch of contexts (citing_id, location, refid) under path."""

    def add(batch: DataFrame, number: int) -> None:
        graph.cocounts(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("a", "b").agg(F.sum("n").alias("n"))


def maintained(contexts: DataFrame) -> DataFrame:
    """The graph of contexts that are written by paper into files and read back as a stream of them."""
    spark, at = contexts.sparkSession, scratch_path(contexts.sparkSession)
    rows = contexts.select("citing_id", "location", "refid")
    rows.repartition(4, "citing_id").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    upkeep(stream, f"{at}/out", f"{at}/log").awaitTermination()
    return counts(spark, f"{at}/out")
