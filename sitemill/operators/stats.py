"""Paper-weighted means, paired comparisons, bootstraps and agreement."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F


def paper_mean(rows: DataFrame, *values: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over citing papers of per-paper means; papers and n tell how many."""
    per = rows.groupBy(*by, "citing_id").agg(*(F.avg(v).alias(v) for v in values), F.count("*").alias("n"))
    return per.groupBy(*by).agg(*(F.avg(v).alias(v) for v in values), F.count("*").alias("papers"), F.sum("n").alias("n"))


def paper_values(rows: DataFrame, value: str) -> np.ndarray:
    """Per-paper means in order of citing_id: a row for each paper, for the bootstrap on the driver."""
    return np.array([r[0] for r in rows.groupBy("citing_id").agg(F.avg(value).alias("v")).orderBy("citing_id").select("v").collect()])


def cluster_ci(means: np.ndarray, draws: int = 1000, seed: int = 0, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval of the mean over resampled papers; (nan, nan) of none."""
    if not len(means):
        return float("nan"), float("nan")
    at = np.random.default_rng(seed).integers(0, len(means), (draws, len(means)))
    lo, hi = np.quantile(means[at].mean(1), [(1 - level) / 2, (1 + level) / 2])
    return float(lo), float(hi)


def resampled(per: DataFrame, by: str | None, *values: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """by (if given), draw and the means of values, in resample number draw, of per: a row for each by and citing_id.

    Draw d's i-th paper is number md5(seed:d:i), its first 8 digits, modulo their count, in order of citing_id; a null
    adds nothing to a mean, and one of nulls only is null. Eight bytes for each value come to the driver and go to all
    tasks; a task makes whole draws, whose hashes all of by share, so no row for a drawn paper is shuffled."""
    from hashlib import md5

    import pyarrow as pa

    order = [c for c in (by, "citing_id") if c]
    sizes = [(r[0], r[1]) for r in per.groupBy(by).agg(F.count("*")).orderBy(by).collect()] if by else [(None, per.count())]
    spark = per.sparkSession
    table = per.orderBy(*order).select(*(F.col(v).cast("double").alias(v) for v in values)).toArrow()
    columns = spark.sparkContext.broadcast([table.column(v).to_numpy() for v in values])
    del table

    def run(batches):
        most = max((n for _, n in sizes), default=0)
        for d in (x for b in batches for x in b.column(0).to_pylist()):
            total, count = np.zeros((len(sizes), len(values))), np.zeros((len(sizes), len(values)))
            for lo in range(0, most, 1 << 17):
                head = f"{seed}:{d}:"
                h = np.frombuffer(b"".join([md5(f"{head}{i}".encode()).digest()[:4] for i in range(lo, min(most, lo + (1 << 17)))]), ">u4").astype(np.int64)
                at = 0
                for k, (_, n) in enumerate(sizes):
                    own = h[: max(0, n - lo)] % n + at
                    for j, x in enumerate(columns.value):
                        drawn = x[own]
                        ok = ~np.isnan(drawn)
                        total[k, j] += drawn[ok].sum()
                        count[k, j] += ok.sum()
                    at += n
            with np.errstate(invalid="ignore", divide="ignore"):
                means = np.where(count > 0, total / count, np.nan)
            names = [pa.array([n for n, _ in sizes], pa.string())] if by else []
            yield pa.RecordBatch.from_arrays([*names, pa.array([d] * len(sizes), pa.int64()), *(pa.array(m, from_pandas=True) for m in means.T)], names=[*([by] if by else []), "draw", *values])

    schema = ", ".join([*([f"{by} string"] if by else []), "draw long", *(f"{v} double" for v in values)])
    return spark.range(draws).mapInArrow(run, schema)


def hash_bootstrap(rows: DataFrame, value: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """lo, hi: the same distributed; draw d's i-th paper is number md5(seed:d:i) modulo the count."""
    from ..session import kept

    means = resampled(kept(rows.groupBy("citing_id").agg(F.avg(value).alias("v"))), None, "v", draws=draws, seed=seed)
    return means.agg(F.expr("percentile(v, 0.025D)").alias("lo"), F.expr("percentile(v, 0.975D)").alias("hi"))


def paired(rows: DataFrame, draws: int = 1000, seed: int = 0) -> DataFrame:
    """name, n, papers, a, b, delta, lo, hi, excludes_zero, pool_a, pool_b, pool_delta of rows (name, citing_id, a, b), each name a comparison.

    a, b and delta = a - b are means over papers of their means; lo and hi bound 95% of the mean delta of resampled
    papers, draw d's i-th paper being number md5(seed:d:i) modulo their count; pool_* average all rows alike. Per
    paper and name there is one row from here on."""
    from ..session import kept

    per = kept(rows.groupBy("name", "citing_id").agg(F.avg("a").alias("a"), F.avg("b").alias("b"), F.avg(F.col("a") - F.col("b")).alias("d"), F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.count("*").alias("n")))
    means = resampled(per, "name", "d", draws=draws, seed=seed).select("name", F.round("d", 9).alias("m"))
    ci = means.groupBy("name").agg(F.expr("percentile(m, 0.025D)").alias("lo"), F.expr("percentile(m, 0.975D)").alias("hi"))
    six = lambda c, name: F.round(c, 6).alias(name)
    all_ = per.groupBy("name").agg(F.sum("n").alias("n"), F.count("*").alias("papers"), six(F.avg("a"), "a"), six(F.avg("b"), "b"), six(F.avg("d"), "delta"), six(F.sum("sa") / F.sum("n"), "pool_a"), six(F.sum("sb") / F.sum("n"), "pool_b"), six((F.sum("sa") - F.sum("sb")) / F.sum("n"), "pool_delta"))
    return all_.join(ci, "name").select("name", "n", "papers", "a", "b", "delta", six(F.col("lo"), "lo"), six(F.col("hi"), "hi"), ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("excludes_zero"), "pool_a", "pool_b", "pool_delta")


def poststratified(rows: DataFrame, draws: int = 1000, seed: int = 0) -> dict[str, tuple[float, float, float]]:
    """value, lo, hi of precision, recall and f1 of rows (paper, cell, pop, clustering, good), cells weighing as their population.

    Papers are resampled; a cell that a resample leaves empty has the shares of all rows. Only counts by paper and
    cell, a row for each, come to the driver; all draws are one array product."""
    kinds = {"tp": F.col("clustering") & F.col("good"), "fp": F.col("clustering") & ~F.col("good"), "fn": ~F.col("clustering") & F.col("good")}
    got = rows.groupBy("paper", "cell").agg(F.max("pop").alias("pop"), F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in kinds.items())).collect()
    papers, cells = sorted({r["paper"] for r in got}), sorted({r["cell"] for r in got})
    if not got:
        return {n: (float("nan"),) * 3 for n in ("precision", "recall", "f1")}
    count, pop = np.zeros((len(papers), len(cells), 4)), np.zeros(len(cells))
    for r in got:
        k = cells.index(r["cell"])
        count[papers.index(r["paper"]), k] = [r["n"], r["tp"], r["fp"], r["fn"]]
        pop[k] = max(pop[k], r["pop"])
    times = np.stack([np.bincount(x, minlength=len(papers)) for x in np.random.default_rng(seed).integers(0, len(papers), (draws, len(papers)))])
    whole = count.sum(0)
    total = np.concatenate([whole[None], np.tensordot(times, count, 1)])
    n = total[:, :, :1]
    share = np.where(n > 0, total[:, :, 1:] / np.maximum(n, 1), whole[None, :, 1:] / np.maximum(whole[None, :, :1], 1))
    tp, fp, fn = (share * pop[None, :, None]).sum(1).T
    with np.errstate(invalid="ignore", divide="ignore"):
        all_ = {"precision": tp / (tp + fp), "recall": tp / (tp + fn), "f1": 2 * tp / (2 * tp + fp + fn)}
    out = {}
    for name, x in all_.items():
        v = np.sort(x[1:])
        out[name] = float(x[0]), float(v[int(0.025 * (draws - 1))]), float(v[round(0.975 * (draws - 1))])
    return out


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with number: 0, 1, ... in that order, which must tell all rows apart.

    Rows are dealt out by ranges and written; their places are counted within a range and moved by the sizes of
    those before, so no task has them all."""
    from pyspark.sql import Window as W

    from ..session import kept

    dealt = kept(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_first", F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).select("_part", "_first")  # a row a range
    n = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("number", n).join(F.broadcast(before), "_part").withColumn("number", F.col("number") + F.col("_first")).drop("_part", "_first")


def kappa(labels: DataFrame, a: str, b: str) -> DataFrame:
    """n, raw, kappa of two readers' labels; null where chance agreement is 1."""
    n = labels.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("raw"))
    ca = labels.groupBy(F.col(a).alias("k")).agg(F.count("*").alias("x"))
    cb = labels.groupBy(F.col(b).alias("k")).agg(F.count("*").alias("y"))
    pe = ca.join(cb, "k").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("pe"))
    chance = F.coalesce("pe", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return n.crossJoin(pe).select("n", "raw", F.when(chance != 1, (F.col("raw") - chance) / (1 - chance)).alias("kappa"))


QUANTILES = (("p01", 0.01), ("p05", 0.05), ("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))


def quantiles(rows: DataFrame, value: str) -> DataFrame:
    """n, mean, p01, p05, p10, p25, median, p75, p90, p95, p99 (element floor(p n) of the sorted values) and shares above, at and below 0.

    Ranks come from counts of equal values, so no task gathers all values."""
    from pyspark.sql import Window as W

    n = rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), *(F.avg(c.cast("double")).alias(k) for k, c in (("frac_positive", F.col(value) > 0), ("frac_zero", F.col(value) == 0), ("frac_negative", F.col(value) < 0))))
    c = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k")).withColumn("hi", F.sum("k").over(W.orderBy("v")))
    at = lambda p: F.min(F.when(F.col("hi") > F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n"))), F.col("v")))
    return c.crossJoin(F.broadcast(n)).groupBy("n", "mean", "frac_positive", "frac_zero", "frac_negative").agg(*(at(p).alias(name) for name, p in QUANTILES))
