"""The co-citation graph: counts per site, marginals, smoothed PPMI, degree bins, walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as T


def vocabulary(ctx: DataFrame) -> DataFrame:
    return ctx.select(F.col("refid").alias("id")).distinct()


def cocounts(ctx: DataFrame) -> DataFrame:
    """a, b, n: sites at which both are cited, in both directions."""
    return both_ways(half_counts(ctx))


def _site_sets(ctx: DataFrame) -> DataFrame:
    return ctx.where("citing_id IS NOT NULL AND location IS NOT NULL").groupBy("citing_id", "location").agg(F.collect_set("refid").alias("r"))


def half_counts(ctx: DataFrame) -> DataFrame:
    """The same in one direction, a < b: pairs are made within a site, and only they are dealt out."""
    return _site_sets(ctx).select("r", F.explode("r").alias("a")).select("a", F.explode("r").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def both_ways(half: DataFrame) -> DataFrame:
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), *(c for c in half.columns if c not in ("a", "b"))))


def site_marginals(ctx: DataFrame) -> DataFrame:
    """marginals of cocounts, without the edges: each site adds the number of its other references."""
    return _site_sets(ctx).where(F.size("r") > 1).select(F.explode("r").alias("id"), (F.size("r") - 1).cast("long").alias("k")).groupBy("id").agg(F.sum("k").alias("m"))


def marginals(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("m"))


def totals(m: DataFrame, *alphas: float) -> DataFrame:
    """z0, z1, ... (sums of m^alpha) and total (the sum of m): one row."""
    return m.agg(*(F.sum(F.pow("m", F.lit(x))).alias(f"z{k}") for k, x in enumerate(alphas)), F.sum("m").alias("total"))


def pmi(alpha: float, z: str = "z0") -> F.Column:
    """ln(n Z^2 / (N m_a^alpha m_b^alpha)) of a row with n, ma, mb, Z and total."""
    return F.ln(F.col("n") * F.col(z) * F.col(z) / (F.col("total") * F.pow("ma", F.lit(alpha)) * F.pow("mb", F.lit(alpha))))


def weighed(edges: DataFrame, m: DataFrame) -> DataFrame:
    """edges (a, b, ...) with the marginals of their ends, ma and mb."""
    return edges.join(m.toDF("a", "ma"), "a").join(m.toDF("b", "mb"), "b")


def ppmi(edges: DataFrame, alpha: float = 1.0, min_count: int = 1) -> DataFrame:
    """a, b, v: positive ln(n Z^2 / (N m_a^alpha m_b^alpha)); marginals are of all edges, before min_count.

    Z is the sum of m^alpha, N that of m; isolated references add nothing to either."""
    m = marginals(edges)
    return weighed(edges.where(F.col("n") >= min_count), m).crossJoin(F.broadcast(totals(m, alpha))).select("a", "b", pmi(alpha).alias("v")).where("v > 0")


def association(edges: DataFrame, name: str = "ppmi", alpha: float = 1.0, min_count: int = 1) -> DataFrame:
    if name == "ppmi":
        return ppmi(edges, alpha, min_count)
    if name == "count":
        return edges.where(F.col("n") >= min_count).select("a", "b", F.col("n").cast("double").alias("v"))
    if name == "node2vec":
        # among linked nodes; node_values gives it for any pairs
        v = node2vec(edges).toDF("id", "x")
        return node_values(edges.select(F.col("a").alias("candidate"), F.col("b").alias("anchor")), v).where("v > 0").select(F.col("candidate").alias("a"), F.col("anchor").alias("b"), "v")
    raise ValueError(f"unknown association {name!r}")


def lookup(pairs: DataFrame, assoc: DataFrame) -> DataFrame:
    """pairs (candidate, anchor, ...) with v, 0 where the graph has no such edge."""
    a = assoc.select(F.col("a").alias("candidate"), F.col("b").alias("anchor"), "v")
    return pairs.join(a, ["candidate", "anchor"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def anchor_scores(pools: DataFrame, used: DataFrame, assoc: DataFrame) -> DataFrame:
    """pools with n_anchors and mean, masked_mean and most: a candidate's association with the context's anchors.

    mean divides by all anchors, masked_mean by those with evidence; without evidence all are 0."""
    hits = pools.select("context_id", "candidate").join(used.select("context_id", F.explode("used").alias("anchor")), "context_id")
    a = assoc.select(F.col("a").alias("candidate"), F.col("b").alias("anchor"), "v")
    hits = hits.join(a.hint("shuffle_hash"), ["candidate", "anchor"]).groupBy("context_id", "candidate").agg(F.sum("v").alias("total"), F.count("*").alias("k"), F.max("v").alias("most"))
    d = pools.join(used.select("context_id", F.size("used").alias("n_anchors")), "context_id").join(hits, ["context_id", "candidate"], "left")
    total = F.coalesce("total", F.lit(0.0))
    return d.select(*pools.columns, "n_anchors", F.when(F.col("n_anchors") > 0, total / F.col("n_anchors")).otherwise(0.0).alias("mean"), F.when(F.col("k") > 0, total / F.col("k")).otherwise(0.0).alias("masked_mean"), F.coalesce("most", F.lit(0.0)).alias("most"))


def near(anchors: str, known: str = "known") -> F.Column:
    """a, b, v: of what is known (a, b, n, v at each alpha), the positive associations, at the first alpha, of any reference a with an anchor b."""
    near_ = F.filter(known, lambda h: (h["v"][0] > 0) & F.array_contains(anchors, h["b"]))
    return F.transform(near_, lambda h: F.struct(h["a"].alias("a"), h["b"].alias("b"), h["v"][0].alias("v")))


def associated(rows: DataFrame) -> DataFrame:
    """rows of pools (c, n_anchors, near) with total, k, most, mean and masked_mean in c, as in anchor_scores."""

    def one(x, own):
        total = F.aggregate(own, F.lit(0.0), lambda s, h: s + h["v"])
        v = T.let(total, lambda t: F.struct(*(x[n].alias(n) for n in ("candidate", "is_gold", "base", "z")), t.alias("total"), F.size(own).cast("long").alias("k"), F.coalesce(F.array_max(F.transform(own, lambda h: h["v"])), F.lit(0.0)).alias("most"), F.when(F.col("n_anchors") > 0, t / F.col("n_anchors")).otherwise(0.0).alias("mean"), F.when(F.size(own) > 0, t / F.size(own)).otherwise(0.0).alias("masked_mean")))
        return v

    c = T.let(F.col("near"), lambda all_: F.transform("c", lambda x: T.let(F.filter(all_, lambda h: h["a"] == x["candidate"]), lambda own: one(x, own))))
    return rows.withColumn("c", c)


def arm_scores(pools: DataFrame, arms: DataFrame, assoc: DataFrame, names: list[str]) -> DataFrame:
    """context_id, candidate and, for each named arm, a candidate's mean association with the arm's anchors, from one join.

    arms: arm, context_id, anchor; an anchor counts as often as it occurs. Null where an arm has no anchor for
    the context, 0 without evidence."""
    sizes = arms.groupBy("context_id").agg(*(F.count_if(F.col("arm") == n).alias(f"k_{n}") for n in names))
    a = assoc.select(F.col("a").alias("candidate"), F.col("b").alias("anchor"), "v")
    hits = pools.select("context_id", "candidate").join(arms, "context_id").join(a.hint("shuffle_hash"), ["candidate", "anchor"])
    sums = hits.groupBy("context_id", "candidate").agg(*(F.sum(F.when(F.col("arm") == n, F.col("v"))).alias(f"s_{n}") for n in names))
    d = pools.select("context_id", "candidate").join(sizes, "context_id").join(sums, ["context_id", "candidate"], "left")
    return d.select("context_id", "candidate", *(F.when(F.col(f"k_{n}") > 0, F.coalesce(f"s_{n}", F.lit(0.0)) / F.col(f"k_{n}")).alias(n) for n in names))


def grid(rows: DataFrame, alphas: int, min_counts: tuple[int, ...]) -> DataFrame:
    """rows of pools (c, n_anchors, near: a, b, n, v at so many alphas) with m in c: means over a context's anchors of PPMI at each alpha and min_count, then of counts at each min_count."""
    total = lambda own, f: F.aggregate(own, F.lit(0.0), lambda s, h: s + f(h))
    ppmi_ = lambda k, c: lambda h: F.when((h["v"][k] > 0) & (h["n"] >= c), h["v"][k]).otherwise(0.0)
    counts = lambda c: lambda h: F.when(h["n"] >= c, h["n"].cast("double")).otherwise(0.0)
    fs = [*(ppmi_(k, c) for k in range(alphas) for c in min_counts), *(counts(c) for c in min_counts)]
    mean = lambda own: F.when(F.size(own) == 0, F.array_repeat(F.lit(0.0), len(fs))).otherwise(F.array(*(total(own, f) / F.col("n_anchors") for f in fs)))
    c = T.let(F.col("near"), lambda all_: F.transform("c", lambda x: T.let(F.filter(all_, lambda h: h["a"] == x["candidate"]), lambda own: F.struct(*(x[n].alias(n) for n in ("is_gold", "base", "z")), mean(own).alias("m")))))
    return rows.withColumn("c", c)


def degree_bins(vocab: DataFrame, marg: DataFrame) -> DataFrame:
    """id, bin: floor(log2(max(m, 1)))."""
    d = vocab.join(marg, "id", "left")
    return d.select("id", (F.length(F.bin(F.greatest(F.coalesce("m", F.lit(0)), F.lit(1)))) - 1).cast("long").alias("bin"))


def walks(edges: DataFrame, length: int = 5, per_node: int = 2, seed: int = 0, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """paths with a row for each step: start, walk_no, step, node."""
    return paths(edges, length, per_node, seed, p, q).select("start", "walk_no", F.posexplode("path").alias("step", "node"))


def paths(edges: DataFrame, length: int = 5, per_node: int = 2, seed: int = 0, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """start, walk_no, path: second-order walks from every node.

    An edge weighs its count, divided by p where it leads back, and by q where it leads to a node that isn't linked
    to the one before. Of a node's edges the one with the smallest -ln(u) / weight is taken, u a hash of (seed, step,
    start, walk, end): that draws in proportion to the weights in one pass, without rejecting any. A step is a join
    with the nodes, each a row with its edges; a walk takes the neighbours of the node before along, so that edges
    are dealt out once and no step has a row for each way on."""
    nodes = edges.groupBy("a").agg(F.collect_list(F.struct("b", "n")).alias("ways"))
    now = edges.select(F.col("a").alias("start")).distinct().crossJoin(edges.sparkSession.range(per_node).select(F.col("id").alias("walk_no")))
    now = now.select("start", "walk_no", F.array("start").alias("path"), F.lit(None).cast("array<string>").alias("old"))
    second = p != 1.0 or q != 1.0
    for k in range(1, length):
        d = now.withColumn("a", F.element_at("path", -1)).join(nodes, "a")
        ends = F.transform("ways", lambda e: e["b"])

        def cost(e, linked, k=k):
            weight = e["n"].cast("double")
            if k > 1 and second:
                weight = weight * F.when(e["b"] == F.element_at("path", -2), 1 / p).when(F.array_contains(linked, e["b"]), 1.0).otherwise(1 / q)
            u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(k)), "start", "walk_no", e["b"]).cast("binary")), 1, 8), 16, 10).cast("double") + 1) / float(1 << 32)
            return F.struct((-F.ln(u) / weight).alias("cost"), e["b"].alias("b"))

        linked = F.array_intersect(ends, "old") if k > 1 and second else F.array().cast("array<string>")
        best = T.let(linked, lambda x: F.array_min(F.transform("ways", lambda e: cost(e, x))))["b"]
        now = d.select("start", "walk_no", F.concat("path", F.array(best)).alias("path"), (ends if second and k + 1 < length else F.lit(None).cast("array<string>")).alias("old"))
    return now.select("start", "walk_no", "path")


def node2vec(edges: DataFrame, size: int = 128, length: int = 40, per_node: int = 10, seed: int = 0, p: float = 1.0, q: float = 0.5, window: int = 10, partitions: int = 8) -> DataFrame:
    """word, vector: vectors of length one of the nodes, by skip-gram over ten walks of 40 nodes from each.

    Walks are written once, for the vocabulary and the training. The trainer holds two vectors for each node in one place."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    from ..session import kept
    from .scorers import normalised

    w = kept(paths(kept(edges), length, per_node, seed, p, q).select(F.col("path").alias("walk")))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=0, maxIter=1, seed=seed, inputCol="walk", outputCol="v", numPartitions=partitions).fit(w)
    return model.getVectors().select("word", normalised(vector_to_array("vector")).alias("vector"))


def node_values(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (candidate, anchor, ...) with v: the cosine of their nodes (id, x, of length one), 0 where negative or where either is unknown."""
    from .scorers import dot

    d = pairs.join(nodes.toDF("candidate", "_x"), "candidate", "left").join(nodes.toDF("anchor", "_y"), "anchor", "left")
    return d.withColumn("v", F.coalesce(F.greatest(dot(F.col("_x"), F.col("_y")), F.lit(0.0)), F.lit(0.0))).drop("_x", "_y")
