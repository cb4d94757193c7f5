"""The star schema seen as a citation corpus.

A customer is a citing paper, an order a site in it, a line a context that cites a part. Parts of other
orders of the customer within 30 days stand for the references that a window's other markers resolve to
(the second anchor route; synthetic). Customers 0 modulo 10 are the test split, 1 validation, others train.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: What tells contexts of an order apart; lines that agree in it are alike as contexts, so it doesn't matter which comes first.
_LINE = ("l_linenumber", "l_partkey")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def split_of(citing: F.Column) -> F.Column:
    return F.when(citing % 10 == 0, "test").when(citing % 10 == 1, "val").otherwise("train")


def contexts(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    """context_id, citing_id, refid, location (0, 1, ... by order key within the paper), split, day, cited (contexts of the split, or of all, with that refid).

    Rows of a paper are in one partition, by citing_id; what isn't asked for isn't made."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    orders = orders.withColumn("split", split_of(F.col("o_custkey")))
    if split:
        orders = orders.where(F.col("split") == split)
    lines = table(spark, folder, "lineitem").select("l_orderkey", *_LINE)
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_LINE))
    rows = lines.withColumn("n", n).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.withColumn("cited", F.count("*").over(W.partitionBy("l_partkey"))).withColumn("citing_id", F.col("o_custkey").cast("string"))
    location = F.dense_rank().over(W.partitionBy("citing_id").orderBy("l_orderkey")) - 1
    return rows.select(F.concat_ws("_", "l_orderkey", "n").alias("context_id"), "citing_id", F.col("l_partkey").cast("string").alias("refid"), location.alias("location"), "split", "day", "cited")


def order_sites(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """citing_id, location, refid: the same contexts, a site being named by its order key, so that lines needn't be dealt out by paper."""
    orders = table(spark, folder, "orders").where(split_of(F.col("o_custkey")) == split).select("o_orderkey", F.col("o_custkey").cast("string").alias("citing_id"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("refid"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("citing_id", F.col("l_orderkey").alias("location"), "refid")


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """id, title, abstract of parts."""
    return table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_brand", "p_type").alias("abstract"))


def marker_sites(ctx: DataFrame) -> DataFrame:
    """citing_id, location, refid: references of the paper's other sites within 30 days."""
    sites = ctx.select("citing_id", "location", "day").distinct()
    refs = ctx.select("citing_id", F.col("location").alias("other"), F.col("day").alias("when"), "refid").distinct()
    near = (F.col("location") != F.col("other")) & (F.abs(F.datediff("day", "when")) <= 30)
    return sites.join(refs, "citing_id").where(near).select("citing_id", "location", "refid").distinct()


def numbered_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """vec_id, x (doubles)."""
    return table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
