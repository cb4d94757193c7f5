"""Filling up a site's references one after another, each pick becoming an anchor of the next."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from . import graph, scorers, sites
from .pools import keyed

STEPS = (1, 2, 3, 5, 10, 20)
ARMS = ("semantic", "hybrid_oracle", "hybrid_retrieved", "hybrid_random", "hybrid_degree")


def _stand_ins(corpus, refs: DataFrame, seeds: tuple[int, ...]) -> DataFrame:
    """citing_id, candidate, x, seed, arm, v: associations of a paper's references with what stands in for another, x, in the two control arms.

    A stand-in is chosen by a hash of seed, arm, paper and x among all references of the graph, or those of like degree."""
    bins = graph.degree_bins(graph.vocabulary(corpus.train_sites), corpus.marginals)
    n = F.broadcast(bins.agg(F.count("*").alias("all"), F.min("bin").alias("low")))
    numbered = bins.withColumn("k_random", F.row_number().over(W.orderBy("id")) - 1).withColumn("k_degree", F.row_number().over(W.partitionBy("bin").orderBy("id")) - 1)
    sizes = F.broadcast(bins.groupBy("bin").agg(F.count("*").alias("size")))
    x = refs.select("citing_id", F.col("candidate").alias("x")).withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    hash_ = lambda arm: F.conv(F.substring(F.md5(F.concat_ws(":", "seed", F.lit(arm), "citing_id", "x").cast("binary")), 1, 8), 16, 10).cast("long")
    random = x.crossJoin(n).withColumn("k_random", (hash_("random") % F.col("all")).cast("int")).join(numbered.select("k_random", F.col("id").alias("b")), "k_random").select("citing_id", "x", "seed", F.lit("hybrid_random").alias("arm"), "b")
    degree = x.join(bins.withColumnRenamed("id", "x"), "x", "left").crossJoin(n).withColumn("bin", F.coalesce("bin", "low")).join(sizes, "bin").withColumn("k_degree", (hash_("deg") % F.col("size")).cast("int"))
    degree = degree.join(numbered.select("bin", "k_degree", F.col("id").alias("b")), ["bin", "k_degree"]).select("citing_id", "x", "seed", F.lit("hybrid_degree").alias("arm"), "b")
    return random.unionByName(degree).join(corpus.ppmi.withColumnRenamed("a", "candidate"), "b").join(refs, ["citing_id", "candidate"]).select("citing_id", "candidate", "x", "seed", "arm", "v")


def complete(corpus, arms: tuple[str, ...] = ("hybrid_retrieved",), seeds: tuple[int, ...] = (0, 1, 2), lam: float = 3.0, reveal: bool = True) -> DataFrame:
    """citing_id, location, size, arm, seed, step, recall, remaining: after each of STEPS picks.

    reveal: one reference, by the seed, is the first anchor, isn't picked and counts as found; without it the site
    begins with no anchor, and remaining is null. semantic takes no anchors, hybrid_oracle correct picks only,
    hybrid_retrieved all picks, hybrid_random and hybrid_degree stand-ins for all picks and for the first anchor.
    The score is the base, standardised over the site's candidates, + lam * (sum of associations) / (number of
    anchors), in single precision; the first of equal candidates is taken. Steps depend on one another, so a site
    is one group: its candidates with their associations, bounded by the references of one paper."""
    if bad := set(arms) - set(ARMS):
        raise ValueError(f"unknown arms {sorted(bad)}")
    gold = sites.gold_sets(corpus.ctx).where(F.size("gold") >= 2)
    refs = corpus.ctx.select("citing_id", F.col("refid").alias("candidate")).distinct()
    cand = gold.join(refs, "citing_id").join(scorers.popularity_counts(corpus.ctx), "candidate").select("citing_id", "location", "gold", "candidate", F.log1p("cited").alias("base"))
    first = corpus.ctx.select("citing_id", "location", "refid").distinct().groupBy("citing_id", "location").agg(F.array(*(F.min_by("refid", keyed(s, "citing_id", "location", "refid")) for s in seeds)).alias("first"))
    near = refs.join(corpus.ppmi, F.col("candidate") == F.col("a")).join(refs.select("citing_id", F.col("candidate").alias("b")), ["citing_id", "b"]).groupBy("citing_id", "candidate").agg(F.collect_list(F.struct(F.col("b").alias("x"), "v")).alias("near"))
    rows = cand.join(first, ["citing_id", "location"]).join(near, ["citing_id", "candidate"], "left")
    if {"hybrid_random", "hybrid_degree"} & set(arms):
        other = _stand_ins(corpus, refs, seeds).groupBy("citing_id", "candidate").agg(F.collect_list(F.struct("arm", "seed", "x", "v")).alias("other"))
        rows = rows.join(other, ["citing_id", "candidate"], "left")
    else:
        rows = rows.withColumn("other", F.lit(None).cast("array<struct<arm: string, seed: int, x: string, v: double>>"))

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("candidate", ignore_index=True)
        names, base = list(pdf["candidate"]), pdf["base"].to_numpy(np.float64)
        sd = base.std()
        base = ((base - base.mean()) / sd if sd > 0 else np.zeros(len(base))).astype(np.float32)
        gold_, starts, n = set(pdf["gold"].iloc[0]), list(pdf["first"].iloc[0]), len(names)
        own, other = {}, {}
        for k, (a, b) in enumerate(zip(pdf["near"], pdf["other"])):
            for x in a if a is not None else ():
                own.setdefault(x["x"], np.zeros(n))[k] += x["v"]
            for x in b if b is not None else ():
                other.setdefault((x["arm"], x["seed"], x["x"]), np.zeros(n))[k] += x["v"]
        zero, out = np.zeros(n), []
        head = (pdf["citing_id"].iloc[0], pdf["location"].iloc[0], len(gold_))
        for seed, start in zip(seeds, starts):
            for arm in arms:
                sums, anchors, blocked, found = np.zeros(n), 0, np.zeros(n, bool), set()
                value = (lambda x: own.get(x, zero)) if arm in ("hybrid_oracle", "hybrid_retrieved") else (lambda x: other.get((arm, seed, x), zero))
                if reveal:
                    if start in names:
                        blocked[names.index(start)] = True
                    if arm != "semantic":
                        sums, anchors = sums + value(start), 1
                for step in range(1, max(STEPS) + 1):
                    if not blocked.all():
                        score = base + (lam * (sums / anchors)).astype(np.float32) if anchors else base
                        pick = int(np.argmax(np.where(blocked, -np.inf, score)))
                        blocked[pick] = True
                        found.add(names[pick])
                        if arm != "semantic" and (arm != "hybrid_oracle" or names[pick] in gold_):
                            sums, anchors = sums + value(names[pick]), anchors + 1
                    if step in STEPS:
                        got = len(found & gold_)
                        out.append((*head, arm, seed, step, (got + (reveal and start in gold_)) / len(gold_), got / (len(gold_) - 1) if reveal else None))
        return pd.DataFrame(out, columns=["citing_id", "location", "size", "arm", "seed", "step", "recall", "remaining"])

    return rows.groupBy("citing_id", "location").applyInPandas(steps, "citing_id string, location long, size long, arm string, seed long, step long, recall double, remaining double")
