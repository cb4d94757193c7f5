"""Tie-exact ranks and outcomes of probes, and the rescoring arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def bands(pools: DataFrame, score: str, key: str = "context_id") -> DataFrame:
    """key, above (candidates with a higher score than gold's), tied (with the same, gold's included).

    NaN is refused: Spark would rank it above all."""
    s = F.when(F.isnan(score), F.raise_error(F.lit("a score is NaN"))).otherwise(F.col(score))
    p = pools.withColumn("_s", s)
    p = p.withColumn("_g", F.max(F.when(F.col("is_gold"), F.col("_s"))).over(W.partitionBy(key)))
    return p.groupBy(key).agg(F.count_if(F.col("_s") > F.col("_g")).alias("above"), F.count_if(F.col("_s") == F.col("_g")).alias("tied"))


def expected_rr(above: Column, tied: Column) -> Column:
    """Mean of 1 / rank over all orders of the tied candidates."""
    return F.aggregate(F.sequence(above + 1, above + tied), F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / i) / tied


def expected_hit1(above: Column, tied: Column) -> Column:
    return F.when(above > 0, 0.0).otherwise(F.lit(1.0) / tied)


def swap_outcome(aa: Column, bb: Column, ab: Column, ba: Column) -> Column:
    """1, 0.5 or 0 by the sign of (aa + bb) - (ab + ba)."""
    d = (aa + bb) - (ab + ba)
    return F.when(d > 0, 1.0).when(d == 0, 0.5).otherwise(0.0)


def zscore(value: str, key: str = "context_id") -> Column:
    """(v - mean) / population sd within key; 0 where the sd is 0."""
    w = W.partitionBy(key)
    sd = F.stddev_pop(value).over(w)
    return F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0)


def harmonic_floor(k: Column) -> Column:
    """H(k) / k, what a constant scorer gets from pools of k."""
    return expected_rr(F.lit(0), k)
