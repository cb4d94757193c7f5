"""Frozen candidates: rank pools and swap pairs. The default sampler orders by md5(seed:key:item)."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F


def keyed(seed: int | str, *cols: str) -> F.Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *cols).cast("binary"))


def eligibility(anchored: DataFrame, aligned: DataFrame, size: int = 10) -> DataFrame:
    """context_id, citing_id, gold (the target), available (sorted references that may be wrong answers), reason.

    reason: alignment_failed before single_location before too_few_distractors before kept."""
    refs = anchored.select("citing_id", F.explode("gold").alias("r")).groupBy("citing_id").agg(F.array_sort(F.collect_set("r")).alias("all"))
    sites = anchored.select("citing_id", "location").distinct().groupBy("citing_id").agg(F.count("*").alias("sites"))
    d = anchored.join(refs.withColumnRenamed("all", "refs"), "citing_id").join(sites.withColumnRenamed("sites", "n_sites"), "citing_id").join(aligned, "context_id")
    return reasons(d, size).select("context_id", "citing_id", "gold", "available", "reason")


def reasons(d: DataFrame, size: int = 10) -> DataFrame:
    """d with available and reason, gold being the target, from refs and n_sites of its paper and aligned."""
    d = d.withColumn("available", F.array_except(F.array_except("refs", "gold"), "marker"))
    reason = F.when(~F.col("aligned"), "alignment_failed").when(F.col("n_sites") < 2, "single_location").when(F.size("available") < size - 1, "too_few_distractors").otherwise("kept")
    return d.withColumn("reason", reason).withColumn("gold", F.col("refid"))


def candidates(size: int = 10, seed: int = 0) -> F.Column:
    """candidate, is_gold: an array of size - 1 of available, those of the smallest hashes, and gold; made in the row, as all it needs is there."""
    hashed = F.transform("available", lambda x: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), "context_id", x).cast("binary")).alias("h"), x.alias("x")))
    others = F.transform(F.slice(F.array_sort(hashed), 1, size - 1), lambda o: F.struct(o["x"].alias("candidate"), F.lit(False).alias("is_gold")))
    return F.concat(others, F.array(F.struct(F.col("gold").alias("candidate"), F.lit(True).alias("is_gold"))))


def rank_pools(eligible: DataFrame, size: int = 10, seed: int = 0) -> DataFrame:
    """context_id, citing_id, gold, candidate, is_gold: gold and size - 1 others of each kept context."""
    kept = eligible.where("reason = 'kept'").select("context_id", "citing_id", "gold", F.explode(candidates(size, seed)).alias("c"))
    return kept.select("context_id", "citing_id", "gold", "c.candidate", "c.is_gold")


def rank_pools_python(eligible: DataFrame, size: int = 10, seed: int = 0) -> DataFrame:
    """context_id, candidates: the same with Python's generator, seeded by "seed:context_id"; gold is put last, then all are shuffled."""

    def draw(batches):
        for pdf in batches:
            out = []
            for ctx, gold, available in zip(pdf["context_id"], pdf["gold"], pdf["available"]):
                rng = random.Random(f"{seed}:{ctx}")
                cands = [*rng.sample(sorted(available), size - 1), gold]
                rng.shuffle(cands)
                out.append(cands)
            yield pd.DataFrame({"context_id": pdf["context_id"], "candidates": out})

    return eligible.where("reason = 'kept'").select("context_id", "gold", "available").mapInPandas(draw, "context_id string, candidates array<string>")


def swap_pairs(anchored: DataFrame, k: int = 5, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """citing_id, ctx_a, ctx_b, gold_a, gold_b: at most k pairs of sites of a paper with disjoint references, each shown by its first context; what is to be kept of both contexts follows as <name>_a, <name>_b."""
    first = anchored.groupBy("citing_id", "location").agg(F.min_by(F.struct("context_id", "refid", "gold", *keep), "context_id").alias("x"))
    a = first.select("citing_id", F.col("location").alias("la"), F.col("x").alias("a"))
    b = first.select("citing_id", F.col("location").alias("lb"), F.col("x").alias("b"))
    pairs = a.join(b, "citing_id").where((F.col("la") < F.col("lb")) & ~F.arrays_overlap("a.gold", "b.gold"))
    n = F.row_number().over(W.partitionBy("citing_id").orderBy(keyed(seed, "citing_id", "la", "lb"), "la", "lb"))
    best = pairs.withColumn("n", n).where(F.col("n") <= k)
    return best.select("citing_id", F.col("a.context_id").alias("ctx_a"), F.col("b.context_id").alias("ctx_b"), F.col("a.refid").alias("gold_a"), F.col("b.refid").alias("gold_b"), *(F.col(f"{x}.{c}").alias(f"{c}_{x}") for c in keep for x in "ab"))
