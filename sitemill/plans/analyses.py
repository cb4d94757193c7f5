"""The composite analyses: rank report, sweep, swap, controls, coverage, proximity, thresholds, influence, contrast of slices, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import probes as P, report, text as T
from ..operators import graph, pools, scorers, sites, stats
from ..session import kept
from ..sources import adapters
from .base import PAIRED, Corpus, ranked_by, ranks, rr, split_sql, sql
from .citation import _ASYM, _INFL, _SWAP4, _SWAPS, _swap_scores, R6, deciles, influence, reciprocal, smp_degree_matched, smp_other_location, smp_random_anchors
from .registry import query

#: The settings of a sweep.
ALPHAS, MIN_COUNTS = (0.1, 0.25, 0.5, 0.75, 1.0), (1, 2)
LAMBDAS = (0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 7.0, 10.0, 15.0, 20.0, 30.0, 50.0)
LAMBDA = 3.0
_RESCORED = f"z + {LAMBDA}::DOUBLE * mean"


def _compared(rows: DataFrame, *pairs: tuple[str, F.Column, F.Column, F.Column | None]) -> DataFrame:
    """name, citing_id, a, b: a row for each of rows and each (name, a, b, condition) whose condition holds."""
    each = F.array(*(F.when(F.lit(True) if ok is None else ok, F.struct(F.lit(n).alias("name"), a.cast("double").alias("a"), b.cast("double").alias("b"))) for n, a, b, ok in pairs))
    return rows.select("citing_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("x.name", "citing_id", "x.a", "x.b")


_BASE, _OWN = (lambda x: x["z"]), (lambda x: x["z"] + LAMBDA * x["mean"])


# --- rank report


_PRIMARY = sql(
    "SELECT name, n, papers, a, b, delta, lo, hi, excludes_zero FROM paired",
    f"both_rr AS (SELECT x.context_id, x.citing_id, x.rr AS base_rr, x.hit1 AS base_hit1, y.rr, y.hit1 FROM {rr('z')} x JOIN {rr(_RESCORED)} y USING (context_id))",
    "cmp AS (SELECT 'mrr' AS name, citing_id, rr AS a, base_rr AS b FROM both_rr UNION ALL SELECT 'r1', citing_id, hit1, base_hit1 FROM both_rr)",
    *PAIRED,
)


@query("agg_paired", _PRIMARY)
@query("an_primary_result", _PRIMARY)
def an_primary_result(s, d):
    """Mean reciprocal rank and R@1 of the base (b) and of base with the co-citation term (a), with the interval of the difference."""
    r = ranks(Corpus(s, d).rows, base=_BASE, own=_OWN)
    rows = _compared(r, ("mrr", F.col("own_rr"), F.col("base_rr"), None), ("r1", F.col("own_hit1"), F.col("base_hit1"), None))
    return stats.paired(rows).select("name", "n", "papers", "a", "b", "delta", "lo", "hi", "excludes_zero")


_OTHER = (
    "picked AS (SELECT context_id, arg_min(g.gold, md5('0:' || context_id || ':' || g.location)) AS og FROM anc a JOIN gold g ON a.citing_id = g.citing_id AND a.location <> g.location GROUP BY context_id)",
    "other_set AS (SELECT 'other' AS arm, context_id, unnest(og) AS anchor FROM picked)",
)
_HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_ARMS = (
    "vocab AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT DISTINCT refid AS id FROM ctx WHERE split = 'train'))",
    f"random_set AS (SELECT 'random' AS arm, context_id, id AS anchor FROM (SELECT context_id, unnest(range(0, len(anchors))) AS i FROM anc) JOIN vocab ON k = {_HASH.format("'0:rand:' || context_id || ':' || i")} % (SELECT count(*) FROM vocab))",
    "bins AS (SELECT id, floor(log2(greatest(coalesce(m, 0), 1)))::BIGINT AS bin FROM (SELECT DISTINCT refid AS id FROM ctx WHERE split = 'train') LEFT JOIN marg USING (id))",
    "members AS (SELECT id, bin, row_number() OVER (PARTITION BY bin ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY bin) AS size FROM bins)",
    f"""degree_set AS (SELECT 'degree_matched' AS arm, context_id, m.id AS anchor FROM (SELECT context_id, unnest(anchors) AS anchor FROM anc) x LEFT JOIN bins b ON b.id = anchor
  JOIN members m ON m.bin = coalesce(b.bin, (SELECT min(bin) FROM bins)) AND m.k = {_HASH.format("'0:deg:' || context_id || ':' || anchor")} % m.size)""",
)


def _wide(*names: str, sets: str) -> tuple[str, ...]:
    """wide: z with, for each arm of the named sets, its mean association (null where it has no anchor)."""
    return (
        f"arm_set AS ({sets})",
        "arm_size AS (SELECT arm, context_id, count(*) AS k FROM arm_set GROUP BY ALL)",
        "arm_sum AS (SELECT arm, p.context_id, p.candidate, sum(v) AS t FROM pool p JOIN arm_set USING (context_id) JOIN ppmi ON ppmi.a = p.candidate AND ppmi.b = anchor GROUP BY ALL)",
        "wide AS (SELECT z.context_id, z.citing_id, z.candidate, z.is_gold, z.n_anchors, z.z, z.mean" + "".join(f", CASE WHEN kk.{n} > 0 THEN coalesce(tt.{n}, 0) / kk.{n} END AS {n}" for n in names) + " FROM z"
        + " LEFT JOIN (SELECT context_id" + "".join(f", sum(k) FILTER (arm = '{n}') AS {n}" for n in names) + " FROM arm_size GROUP BY context_id) kk USING (context_id)"
        + " LEFT JOIN (SELECT context_id, candidate" + "".join(f", sum(t) FILTER (arm = '{n}') AS {n}" for n in names) + " FROM arm_sum GROUP BY ALL) tt USING (context_id, candidate))",
    )


def _gates_sql() -> str:
    """Rows of cmp for the gates."""
    one = lambda name, a, b, where="true": f"SELECT '{name}' AS name, citing_id, {a} AS a, {b} AS b FROM both_rr WHERE {where}"
    return "cmp AS (" + " UNION ALL ".join([one("gate1", "own_rr", "base_rr"), one("gate1_anchored", "own_rr", "base_rr", "n_anchors > 0"), one("gate2", "own_rr", "other_rr", "has_other"), one("other_vs_base", "other_rr", "base_rr", "has_other"), one("gate1_r1", "own_hit1", "base_hit1"), one("gate2_r1", "own_hit1", "other_hit1", "has_other")]) + ")"


@query("an_rank_gates", sql(
    "SELECT *, CASE WHEN name IN ('gate1', 'gate2') THEN excludes_zero AND delta > 0 END AS passes FROM paired",
    *_OTHER, *_wide("other", sets="SELECT * FROM other_set"),
    f"""both_rr AS (SELECT x.context_id, x.citing_id, x.rr AS base_rr, x.hit1 AS base_hit1, y.rr AS own_rr, y.hit1 AS own_hit1, o.rr AS other_rr, o.hit1 AS other_hit1, n_anchors, has_other
  FROM {rr('z', 'wide')} x JOIN {rr(_RESCORED, 'wide')} y USING (context_id) JOIN {rr('z + 3.0::DOUBLE * coalesce(other, 0)', 'wide')} o USING (context_id) JOIN (SELECT context_id, any_value(n_anchors) AS n_anchors, bool_or(other IS NOT NULL) AS has_other FROM wide GROUP BY context_id) f USING (context_id))""",
    _gates_sql(), *PAIRED,
))
def an_rank_gates(s, d):
    """Gate 1: rescored against base, on all pools and on those with an anchor; gate 2: own anchors against those of another site of the paper; R@1 of both.

    passes: the interval is above zero, of the two gates only; R@1 gates nothing."""
    c = Corpus(s, d)
    other = smp_other_location(s, d).join(c.ctx.select("context_id", "citing_id"), "context_id").join(sites.gold_sets(c.ctx).withColumnRenamed("location", "other"), ["citing_id", "other"]).select(F.lit("other").alias("arm"), "context_id", F.explode("gold").alias("anchor"))
    p = c.scored.select("context_id", "citing_id", "candidate", "is_gold", "n_anchors", "z", F.col("mean").alias("own")).join(graph.arm_scores(c.pools, other, c.ppmi, ["other"]), ["context_id", "candidate"], "left")
    p = p.withColumn("has_other", F.col("other").isNotNull())
    r = ranked_by(p, "n_anchors", "has_other", base=F.col("z"), own=F.col("z") + LAMBDA * F.col("own"), other=F.col("z") + LAMBDA * F.coalesce("other", F.lit(0.0)))
    both = F.col("has_other")
    pairs = (("gate1", "own_rr", "base_rr", None), ("gate1_anchored", "own_rr", "base_rr", F.col("n_anchors") > 0), ("gate2", "own_rr", "other_rr", both), ("other_vs_base", "other_rr", "base_rr", both), ("gate1_r1", "own_hit1", "base_hit1", None), ("gate2_r1", "own_hit1", "other_hit1", both))
    m = stats.paired(_compared(r, *((n, F.col(a), F.col(b), ok) for n, a, b, ok in pairs)))
    return m.withColumn("passes", F.when(F.col("name").isin("gate1", "gate2"), F.col("excludes_zero") & (F.col("delta") > 0)))


@query("agg_coverage_strata", sql(
    "SELECT * FROM paired",
    "strata AS (SELECT context_id, CASE WHEN max(CASE WHEN is_gold THEN mean END) > 0 THEN 'target' WHEN max(mean) > 0 THEN 'distractor' ELSE 'none' END AS stratum FROM z GROUP BY context_id)",
    f"both_rr AS (SELECT stratum, x.citing_id, x.rr AS base_rr, y.rr FROM strata JOIN {rr('z')} x USING (context_id) JOIN {rr(_RESCORED)} y USING (context_id))",
    "cmp AS (SELECT stratum AS name, citing_id, rr AS a, base_rr AS b FROM both_rr UNION ALL SELECT 'unseen', citing_id, rr, base_rr FROM both_rr WHERE stratum <> 'target')",
    *PAIRED,
))
def agg_coverage_strata(s, d):
    """Rescored (a) against base (b) by what the graph knows of a pool: an edge of the target and an anchor, of a distractor only, none; unseen: the latter two."""
    gold = F.exists("c", lambda x: x["is_gold"] & (x["mean"] > 0))
    p = Corpus(s, d).rows.withColumn("stratum", F.when(gold, "target").when(F.exists("c", lambda x: x["mean"] > 0), "distractor").otherwise("none"))
    r = ranks(p, "stratum", base=_BASE, own=_OWN)
    a, b = F.col("own_rr"), F.col("base_rr")
    return stats.paired(_compared(r, *((n, a, b, F.col("stratum") == n) for n in ("target", "distractor", "none")), ("unseen", a, b, F.col("stratum") != "target")))


# --- sweep on the validation split


_SETTINGS = [("ppmi", a, c) for a in ALPHAS for c in MIN_COUNTS] + [("count", None, c) for c in MIN_COUNTS]
_SETS = ", ".join(f"({k}, '{n}', {'NULL' if a is None else a}::DOUBLE, {c})" for k, (n, a, c) in enumerate(_SETTINGS))
_SWEEP = (
    split_sql("val"),
    f"setting AS (SELECT * FROM (VALUES {_SETS}) v(j, assoc, alpha, min_count))",
    "lambdas AS (SELECT unnest([" + ", ".join(f"{x}::DOUBLE" for x in LAMBDAS) + "]) AS lam)",
    "zeta AS (SELECT alpha, sum(m ** alpha) AS zz, sum(m) AS total FROM marg, (SELECT DISTINCT alpha FROM setting WHERE alpha IS NOT NULL) GROUP BY alpha)",
    "valued_edge AS (SELECT j, a, b, ln(n * zz ** 2 / (total * x.m ** alpha * y.m ** alpha)) AS v FROM edge JOIN marg x ON x.id = a JOIN marg y ON y.id = b, zeta JOIN setting USING (alpha) WHERE n >= min_count UNION ALL SELECT j, a, b, n FROM edge, setting WHERE assoc = 'count' AND n >= min_count)",
    "swept AS (SELECT j, context_id, candidate, sum(v) / any_value(k) AS mean FROM pool_val p JOIN (SELECT context_id, len(anchors) AS k, unnest(anchors) AS anchor FROM anc_val) USING (context_id) JOIN valued_edge e ON e.a = candidate AND e.b = anchor WHERE v > 0 GROUP BY ALL)",
    """per_pool AS (SELECT j, lam, context_id, any_value(citing_id) AS citing_id, count(*) FILTER (s > g) AS above, count(*) FILTER (s = g) AS tied FROM (
    SELECT *, max(CASE WHEN is_gold THEN s END) OVER (PARTITION BY j, lam, context_id) AS g FROM (SELECT j, lam, z.context_id, z.citing_id, is_gold, round(z_val + lam * coalesce(swept.mean, 0), 9) AS s FROM z_val z CROSS JOIN setting CROSS JOIN lambdas LEFT JOIN swept USING (j, context_id, candidate))) GROUP BY j, lam, context_id)""",
    "grid_rr AS (SELECT assoc, alpha, min_count::BIGINT AS min_count, lam, round(avg(rr), 6) AS mrr FROM (SELECT j, lam, citing_id, avg(list_sum(list_transform(range(above + 1, above + tied + 1), lambda i: 1.0::DOUBLE / i)) / tied) AS rr FROM per_pool GROUP BY ALL) JOIN setting USING (j) GROUP BY ALL)",
)


@query("sc_sweep", sql("SELECT assoc, alpha, min_count, lam, mrr, round(mrr - base, 6) AS delta FROM grid_rr, (SELECT any_value(mrr) AS base FROM grid_rr WHERE lam = 0)", *_SWEEP))
def sc_sweep(s, d):
    """Every alpha, min_count and lambda of PPMI, every min_count and lambda of counts, on the validation split; delta is against the base.

    The associations of all settings come from one join of papers' pairs, the ranks of all from one pass over the pools:
    a pool's candidates, few by definition, are one row. At lambda 0 every setting must give the base exactly."""
    c = Corpus(s, d, "val")
    d = c.pool_rows(c.linked(*ALPHAS), "known").withColumn("near", F.filter("known", lambda h: F.array_contains("anchors", h["b"])))
    p = graph.grid(scorers.standardised(d, "near"), len(ALPHAS), MIN_COUNTS)

    def band(score) -> F.Column:
        return T.let(score(F.element_at(F.filter("c", lambda x: x["is_gold"]), 1)), lambda g: T.let(F.transform("c", score), lambda all_: F.struct(F.size(F.filter(all_, lambda v: v > g)).alias("above"), F.size(F.filter(all_, lambda v: v == g)).alias("tied"))))

    settings = [(j, x) for j in range(len(_SETTINGS)) for x in LAMBDAS]
    plain = band(lambda x: F.round(x["base"], 9))
    # a pool that no setting gives an association is the base in all
    at = F.when(F.size("near") == 0, F.array_repeat(band(lambda x: F.round(x["z"], 9)), len(settings))).otherwise(F.transform(F.array(*(F.struct(F.lit(j).alias("j"), F.lit(x).alias("lam")) for j, x in settings)), lambda t: band(lambda x: F.round(x["z"] + t["lam"] * F.get(x["m"], t["j"]), 9))))
    r = p.select("citing_id", plain.alias("plain"), at.alias("at"))
    wrong = F.exists(F.array(*(F.lit(k) for k, (_, x) in enumerate(settings) if x == 0)), lambda k: F.get("at", k) != F.col("plain"))
    mrr = F.when(wrong, F.raise_error(F.lit("lambda 0 doesn't give the base")).cast("array<double>")).otherwise(F.transform("at", lambda b: P.expected_rr(b["above"], b["tied"])))
    # means of a paper within its row, so that a row for each setting leaves a task
    r = r.select("citing_id", mrr.alias("mrr")).groupBy("citing_id").agg(F.count("*").alias("n"), *(F.sum(F.get("mrr", F.lit(k))).alias(f"s{k}") for k in range(len(settings))))
    each = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(x).alias("lam"), (F.col(f"s{k}") / F.col("n")).alias("mrr")) for k, (j, x) in enumerate(settings)))
    out = r.select(F.explode(each).alias("x")).groupBy("x.j", "x.lam").agg(F.round(F.avg("x.mrr"), 6).alias("mrr"))
    names = F.array(*(F.struct(F.lit(n).alias("assoc"), F.lit(a).cast("double").alias("alpha"), F.lit(k).cast("long").alias("min_count")) for n, a, k in _SETTINGS))
    # a row for each setting from here on
    first = F.first(F.when((F.col("j") == 0) & (F.col("lam") == 0), F.col("mrr")), ignorenulls=True).over(W.partitionBy())
    return out.withColumn("b", first).select(F.get(names, F.col("j")).alias("x"), "lam", "mrr", R6(F.col("mrr") - F.col("b"), "delta")).select("x.*", "lam", "mrr", "delta")


@query("argmax_grid", sql(f"SELECT assoc, alpha, min_count, lam, mrr, lam IN ({LAMBDAS[0]}, {LAMBDAS[-1]}) AS on_edge FROM grid_rr QUALIFY row_number() OVER (PARTITION BY assoc ORDER BY mrr DESC, alpha, min_count, lam) = 1", *_SWEEP))
@query("warn_boundary", sql(f"SELECT assoc, alpha, min_count, lam, mrr, lam IN ({LAMBDAS[0]}, {LAMBDAS[-1]}) AS on_edge FROM grid_rr QUALIFY row_number() OVER (PARTITION BY assoc ORDER BY mrr DESC, alpha, min_count, lam) = 1", *_SWEEP))
def argmax_grid(s, d):
    """Best setting of each association, the first of equals; on_edge: the grid ends at its lambda, so a better one may lie outside."""
    best = sc_sweep(s, d).groupBy("assoc").agg(F.max_by(F.struct("alpha", "min_count", "lam", "mrr"), F.struct("mrr", -F.coalesce("alpha", F.lit(0.0)), -F.col("min_count"), -F.col("lam"))).alias("x"))
    return best.select("assoc", "x.*", F.col("x.lam").isin(*(x for x in LAMBDAS if report.on_edge(x, list(LAMBDAS)))).alias("on_edge"))


# --- swap


_DENSE = ("vec AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)", "vecs AS (SELECT count(*) AS n FROM vec)")
_COS = "list_inner_product(p.x, q.x) / (sqrt(list_inner_product(p.x, p.x)) * sqrt(list_inner_product(q.x, q.x)))"


def _diffs(four: str, cells: str, anc: str) -> str:
    """Pairs with the differences between the right and the wrong assignment, of base (db) and of association (dv)."""
    return f"""SELECT citing_id, ctx_a, ctx_b, db, (aa + bb) - (ab + ba) AS dv FROM {four} JOIN (
  SELECT citing_id, ctx_a, ctx_b, sum(CASE WHEN cell IN ('aa', 'bb') THEN 1 ELSE -1 END * round({_COS}, 9)) AS db
  FROM {cells} JOIN vec p ON p.vec_id = {_HASH.format('context_id')} % (SELECT n FROM vecs) JOIN vec q ON q.vec_id = candidate::BIGINT % (SELECT n FROM vecs) GROUP BY ALL) USING (citing_id, ctx_a, ctx_b)"""


_OUT = lambda x: f"CASE WHEN round({x}, 9) > 0 THEN 1.0 WHEN round({x}, 9) = 0 THEN 0.5 ELSE 0.0 END::DOUBLE"
_SWAP = (
    _SWAPS, _SWAP4, split_sql("val", _SWAPS, _SWAP4), *_DENSE,
    f"diff_test AS ({_diffs('four', 'cells', 'anc')})", f"diff_val AS ({_diffs('four_val', 'cells_val', 'anc_val')})",
    f"sigma AS (SELECT stddev_pop(round({_COS}, 9)) AS s FROM cells_val c JOIN vec p ON p.vec_id = {_HASH.format('context_id')} % (SELECT n FROM vecs) JOIN vec q ON q.vec_id = candidate::BIGINT % (SELECT n FROM vecs))",
    "lambdas AS (SELECT unnest([" + ", ".join(f"{x}::DOUBLE" for x in LAMBDAS) + "]) AS lam)",
    f"on_val AS (SELECT lam, round(avg(o), 9) AS accuracy FROM (SELECT lam, citing_id, avg({_OUT('db / s + lam * dv')}) AS o FROM diff_val, sigma, lambdas GROUP BY ALL) GROUP BY lam)",
    "chosen AS (SELECT lam FROM on_val ORDER BY accuracy DESC, lam LIMIT 1)",
    f"arms AS (SELECT citing_id, {_OUT('db')} AS base, {_OUT('dv')} AS cocite, {_OUT('db / s + lam * dv')} AS both_ FROM diff_test, sigma, chosen)",
    "cmp AS (SELECT 'base' AS name, citing_id, base AS a, 0.0::DOUBLE AS b FROM arms UNION ALL SELECT 'cocite', citing_id, cocite, 0 FROM arms UNION ALL SELECT 'both', citing_id, both_, 0 FROM arms UNION ALL SELECT 'both-base', citing_id, both_, base FROM arms UNION ALL SELECT 'both-cocite', citing_id, both_, cocite FROM arms)",
    *PAIRED,
)


def _swap_pairs(c: Corpus) -> DataFrame:
    """citing_id, db, dv, and b, the four base scores: cosines of a context's and a reference's vector, both chosen from the embeddings by id."""
    p = _swap_scores(c).withColumn("dv", (F.col("aa") + F.col("bb")) - (F.col("ab") + F.col("ba")))
    rows = p.select("citing_id", "ctx_a", "ctx_b", "dv", F.explode(F.array(*(F.struct(F.lit(n).alias("sign"), F.col(x).alias("context_id"), F.col(g).alias("candidate")) for n, x, g in ((1, "ctx_a", "gold_a"), (1, "ctx_b", "gold_b"), (-1, "ctx_a", "gold_b"), (-1, "ctx_b", "gold_a"))))).alias("x")).select("citing_id", "ctx_a", "ctx_b", "dv", "x.*")
    v = adapters.numbered_vectors(c.spark, c.folder).withColumn("x", scorers.normalised(F.col("x")))
    n = v.agg(F.count("*").alias("n"))
    rows = rows.crossJoin(F.broadcast(n)).withColumn("vp", F.conv(F.substring(F.md5(F.col("context_id").cast("binary")), 1, 8), 16, 10).cast("long") % F.col("n")).withColumn("vq", F.col("candidate").cast("long") % F.col("n"))
    rows = rows.join(v.toDF("vp", "xp"), "vp").join(v.toDF("vq", "xq"), "vq").withColumn("cos", F.round(scorers.dot(F.col("xp"), F.col("xq")), 9)).drop("xp", "xq")
    return rows.groupBy("citing_id", "ctx_a", "ctx_b").agg(F.sum(F.col("sign") * F.col("cos")).alias("db"), F.first("dv").alias("dv"), F.collect_list("cos").alias("b"))


def _outcome(x: F.Column) -> F.Column:
    x = F.round(x, 9)
    return F.when(x > 0, 1.0).when(x == 0, 0.5).otherwise(0.0)


@query("an_swap", sql("SELECT paired.name, n, papers, a, delta, lo, hi, excludes_zero, lam FROM paired, chosen", *_SWAP))
@query("sc_swap_arms", sql("SELECT paired.name, n, papers, a, delta, lo, hi, excludes_zero, lam FROM paired, chosen", *_SWAP))
def an_swap(s, d):
    """Accuracy (a) of base, association and both at the lambda that is best on the validation split, the first of equals, and paired differences.

    A base score's mean cancels out of a pair's outcome; its deviation is that of the validation pairs."""
    val, test = kept(_swap_pairs(Corpus(s, d, "val"))), _swap_pairs(Corpus(s, d))
    sigma = val.select(F.explode("b").alias("b")).agg(F.stddev_pop("b").alias("s"))
    on_val = val.crossJoin(F.broadcast(sigma)).withColumn("lam", F.explode(F.array(*map(F.lit, LAMBDAS)))).groupBy("lam", "citing_id").agg(F.avg(_outcome(F.col("db") / F.col("s") + F.col("lam") * F.col("dv"))).alias("o"))
    chosen = on_val.groupBy("lam").agg(F.round(F.avg("o"), 9).alias("accuracy")).agg(F.max_by("lam", F.struct("accuracy", -F.col("lam"))).alias("lam")).crossJoin(F.broadcast(sigma))
    chosen = kept(chosen)
    arms = test.crossJoin(F.broadcast(chosen)).select("citing_id", "lam", _outcome(F.col("db")).alias("base"), _outcome(F.col("dv")).alias("cocite"), _outcome(F.col("db") / F.col("s") + F.col("lam") * F.col("dv")).alias("both"))
    zero = F.lit(0.0)
    rows = _compared(arms, *((n, F.col(n), zero, None) for n in ("base", "cocite", "both")), *((f"both-{n}", F.col("both"), F.col(n), None) for n in ("base", "cocite")))
    return stats.paired(rows).crossJoin(F.broadcast(chosen.select("lam"))).select("name", "n", "papers", "a", "delta", "lo", "hi", "excludes_zero", "lam")


@query("sc_swap_accuracy", sql("SELECT round(avg(o), 6) AS accuracy, count(*) AS papers FROM (SELECT citing_id, avg(cocite) AS o FROM arms GROUP BY citing_id)", *_SWAP))
def sc_swap_accuracy(s, d):
    """Mean over papers of the outcomes by association alone."""
    dv = (F.col("aa") + F.col("bb")) - (F.col("ab") + F.col("ba"))
    return stats.paper_mean(_swap_scores(Corpus(s, d)).withColumn("accuracy", _outcome(dv)), "accuracy").select(R6("accuracy"), "papers")


# --- controls


_CONTROLS = ("random", "degree_matched", "other")


@query("an_controls", sql(
    "SELECT name, n, papers, a, b, delta, lo, hi, excludes_zero FROM paired",
    *_OTHER, *_ARMS, *_wide(*_CONTROLS, sets="SELECT * FROM other_set UNION ALL SELECT * FROM random_set UNION ALL SELECT * FROM degree_set"),
    f"both_rr AS (SELECT x.context_id, x.citing_id, x.rr AS base, y.rr AS own, has_other, {', '.join(f'{n}_.rr AS {n}' for n in _CONTROLS)} FROM {rr('z', 'wide')} x JOIN {rr(_RESCORED, 'wide')} y USING (context_id) JOIN (SELECT context_id, bool_or(other IS NOT NULL) AS has_other FROM wide GROUP BY context_id) f USING (context_id) "
    + " ".join(f"JOIN {rr(f'z + 3.0::DOUBLE * coalesce({n}, 0)', 'wide')} {n}_ USING (context_id)" for n in _CONTROLS) + ")",
    "cmp AS (SELECT 'true' AS name, citing_id, own AS a, base AS b FROM both_rr " + " ".join(f"UNION ALL SELECT '{n}', citing_id, {n}, base FROM both_rr WHERE has_other OR '{n}' <> 'other' UNION ALL SELECT 'true-{n}', citing_id, own, {n} FROM both_rr WHERE has_other OR '{n}' <> 'other'" for n in _CONTROLS) + ")",
    *PAIRED,
))
def an_controls(s, d):
    """Own anchors, as many random ones, ones of like degree and another site's, each against the base, and the own ones against each control."""
    c = Corpus(s, d)
    other = smp_other_location(s, d).join(c.ctx.select("context_id", "citing_id"), "context_id").join(sites.gold_sets(c.ctx).withColumnRenamed("location", "other"), ["citing_id", "other"]).select(F.lit("other").alias("arm"), "context_id", F.explode("gold").alias("anchor"))
    arms = other.unionByName(smp_random_anchors(s, d).select(F.lit("random").alias("arm"), "context_id", "anchor")).unionByName(smp_degree_matched(s, d).select(F.lit("degree_matched").alias("arm"), "context_id", F.col("stand_in").alias("anchor")))
    p = c.scored.select("context_id", "citing_id", "candidate", "is_gold", "z", F.col("mean").alias("own")).join(graph.arm_scores(c.pools, arms, c.ppmi, list(_CONTROLS)), ["context_id", "candidate"], "left")
    p = p.withColumn("has_other", F.col("other").isNotNull())
    r = ranked_by(p, "has_other", base=F.col("z"), own=F.col("z") + LAMBDA * F.col("own"), **{n: F.col("z") + LAMBDA * F.coalesce(n, F.lit(0.0)) for n in _CONTROLS})
    ok = lambda n: F.col("has_other") if n == "other" else None
    rows = _compared(r, ("true", F.col("own_rr"), F.col("base_rr"), None), *((n, F.col(f"{n}_rr"), F.col("base_rr"), ok(n)) for n in _CONTROLS), *((f"true-{n}", F.col("own_rr"), F.col(f"{n}_rr"), ok(n)) for n in _CONTROLS))
    return stats.paired(rows).select("name", "n", "papers", "a", "b", "delta", "lo", "hi", "excludes_zero")


# --- proximity: what anchors are worth by how near the text puts them


TIERS = ("group", "sentence", "beyond", "not_in_window")
#: What stands between the target and a marker of its window, by a hash of both, as the tables hold no windows.
_BETWEEN = ("] , [", " and ", " as shown by ", " works. Then [", " et al. show ", " ends here. ")
_BETWEEN_TIERS = ("group", "group", "sentence", "beyond", "sentence", "beyond")


def anchor_tiers(c: Corpus) -> DataFrame:
    """context_id, anchor, tier: of anchors that the marker route gives, from the text between; others aren't in the window."""
    k = F.conv(F.substring(F.md5(F.concat_ws(":", "context_id", "anchor").cast("binary")), 1, 8), 16, 10).cast("long") % len(_BETWEEN)
    between = F.element_at(F.array(*map(F.lit, _BETWEEN)), (k + 1).cast("int"))
    a = c.anchored.select("context_id", "marker", F.explode("anchors").alias("anchor"))
    return a.select("context_id", "anchor", F.when(F.array_contains("marker", F.col("anchor")), T.tier(between)).otherwise(TIERS[3]).alias("tier"))


_PROX = (
    "tiered AS (SELECT context_id, anchor, CASE WHEN list_contains(marker, anchor) THEN [" + ", ".join(f"'{x}'" for x in _BETWEEN_TIERS) + f"][{_HASH.format("context_id || ':' || anchor")} % 6 + 1] ELSE 'not_in_window' END AS arm FROM (SELECT context_id, marker, unnest(anchors) AS anchor FROM anc))",
    "arm_set AS (SELECT 'only_' || arm AS arm, context_id, anchor FROM tiered UNION ALL SELECT 'upto_' || u, context_id, anchor FROM tiered JOIN (VALUES (1, 'group'), (2, 'group'), (2, 'sentence'), (3, 'group'), (3, 'sentence'), (3, 'beyond'), (4, 'group'), (4, 'sentence'), (4, 'beyond'), (4, 'not_in_window')) v(u, arm) USING (arm))",
)
_READINGS = (*(f"only_{x}" for x in TIERS), "upto_1", "upto_2", "upto_3", "upto_4")


@query("an_proximity", sql(
    "SELECT name, n, papers, a, b, delta, lo, hi, excludes_zero, pool_delta FROM paired",
    _PROX[0], *(_PROX[1] if x.startswith("arm_set") else x for x in _wide(*_READINGS, sets="SELECT 1")),
    f"both_rr AS (SELECT x.context_id, x.citing_id, x.rr AS base, {', '.join(f'{n}_.rr AS {n}, ok_{n}' for n in _READINGS)} FROM {rr('z', 'wide')} x JOIN (SELECT context_id, {', '.join(f'bool_or({n} IS NOT NULL) AS ok_{n}' for n in _READINGS)} FROM wide GROUP BY context_id) f USING (context_id) " + " ".join(f"JOIN {rr(f'z + 3.0::DOUBLE * coalesce({n}, 0)', 'wide')} {n}_ USING (context_id)" for n in _READINGS) + ")",
    "cmp AS (" + " UNION ALL ".join([*(f"SELECT '{n}' AS name, citing_id, {n} AS a, base AS b FROM both_rr WHERE ok_{n}" for n in _READINGS), *(f"SELECT 'fixed_upto_{k}', citing_id, upto_{k}, base FROM both_rr WHERE ok_only_group" for k in range(1, 5))]) + ")",
    *PAIRED,
))
def an_proximity(s, d):
    """Rescored (a) against base (b) with anchors of one tier only, of the nearest tiers together, and the latter on the pools that have an anchor of the group.

    Pools without an anchor of the kind are left out."""
    c = Corpus(s, d)
    t = anchor_tiers(c)
    upto = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    arms = t.select(F.explode(F.concat(F.array(F.concat(F.lit("only_"), "tier")), F.transform(F.sequence(upto, F.lit(4).cast("long")), lambda k: F.concat(F.lit("upto_"), k.cast("string"))))).alias("arm"), "context_id", "anchor")
    p = c.scored.select("context_id", "citing_id", "candidate", "is_gold", "z").join(graph.arm_scores(c.pools, arms, c.ppmi, list(_READINGS)), ["context_id", "candidate"], "left")
    p = p.select("*", *(F.col(n).isNotNull().alias(f"ok_{n}") for n in _READINGS))
    r = ranked_by(p, *(f"ok_{n}" for n in _READINGS), base=F.col("z"), **{n: F.col("z") + LAMBDA * F.coalesce(n, F.lit(0.0)) for n in _READINGS})
    rows = _compared(r, *((n, F.col(f"{n}_rr"), F.col("base_rr"), F.col(f"ok_{n}")) for n in _READINGS), *((f"fixed_upto_{k}", F.col(f"upto_{k}_rr"), F.col("base_rr"), F.col("ok_only_group")) for k in range(1, 5)))
    return stats.paired(rows).select("name", "n", "papers", "a", "b", "delta", "lo", "hi", "excludes_zero", "pool_delta")


@query("an_proximity_tiers", sql("SELECT route, tier, count(*) AS n FROM (SELECT arm AS tier, CASE WHEN list_contains(marker, anchor) THEN 'marker' ELSE 'clustering' END AS route FROM tiered JOIN anc USING (context_id)) GROUP BY ALL", _PROX[0]))
def an_proximity_tiers(s, d):
    """Anchors by route and tier."""
    c = Corpus(s, d)
    t = anchor_tiers(c).join(c.anchored.select("context_id", "marker"), "context_id")
    return t.groupBy(F.when(F.array_contains("marker", F.col("anchor")), "marker").otherwise("clustering").alias("route"), "tier").agg(F.count("*").alias("n"))


# --- hard against easy pools, over one resample of papers


_SLICED = (
    f"sliced AS (SELECT citing_id, (gold::INT % 4) > 0 AS hard, y.rr - x.rr AS d, x.rr AS base FROM {rr('z')} x JOIN {rr(_RESCORED)} y USING (citing_id, context_id) JOIN (SELECT context_id, gold FROM elig WHERE len(anchors) > 0) USING (context_id))",
    "joint AS (SELECT *, row_number() OVER (ORDER BY citing_id) - 1 AS k, count(*) OVER () AS papers FROM (SELECT citing_id, avg(d) FILTER (hard) AS hd, avg(base) FILTER (hard) AS hb, avg(d) FILTER (NOT hard) AS ed, avg(base) FILTER (NOT hard) AS eb FROM sliced GROUP BY citing_id))",
    "jboot AS (SELECT draw, avg(y.hd) AS hd, avg(y.hb) AS hb, avg(y.ed) AS ed, avg(y.eb) AS eb FROM (SELECT k, papers, unnest(range(1000)) AS draw FROM joint) x JOIN joint y ON y.k = ('0x' || substr(md5('0:' || draw || ':' || x.k), 1, 8))::BIGINT % x.papers GROUP BY draw)",
)
_QUANTITIES = {"hard": "hd", "easy": "ed", "difference": "hd - ed", "ratio": "hd / nullif(ed, 0)", "headroom_hard": "hd / nullif(1 - hb, 0)", "headroom_easy": "ed / nullif(1 - eb, 0)", "headroom_ratio": "(hd / nullif(1 - hb, 0)) / nullif(ed / nullif(1 - eb, 0), 0)"}
_CONTRAST = sql(
    " UNION ALL ".join(f"SELECT '{n}' AS quantity, round(any_value(v), 6) AS value, round(quantile_cont(b, 0.025), 6) AS lo, round(quantile_cont(b, 0.975), 6) AS hi, any_value(papers) AS papers, any_value(both_) AS papers_in_both FROM (SELECT {e} AS b FROM jboot), (SELECT {e} AS v, papers, both_ FROM jmean)" for n, e in _QUANTITIES.items()),
    *_SLICED, "jmean AS (SELECT avg(hd) AS hd, avg(hb) AS hb, avg(ed) AS ed, avg(eb) AS eb, count(*) AS papers, count(*) FILTER (hd IS NOT NULL AND ed IS NOT NULL) AS both_ FROM joint)",
)


@query("agg_headroom", _CONTRAST)
@query("bs_joint", _CONTRAST)
@query("an_hard_easy", _CONTRAST)
def an_hard_easy(s, d):
    """Gains on hard and easy anchored pools, their difference and ratio, and gains as shares of what was left to gain, with intervals of one resample of papers.

    A paper that a slice lacks adds nothing to its mean."""
    c = Corpus(s, d)
    p = c.rows.where("n_anchors > 0").withColumn("hard", F.col("gold").cast("int") % 4 > 0)
    r = ranks(p, "hard", base=_BASE, own=_OWN).withColumn("d", F.col("own_rr") - F.col("base_rr"))
    part = lambda v, ok: F.avg(F.when(ok, F.col(v)))
    j = r.groupBy("citing_id").agg(part("d", F.col("hard")).alias("hd"), part("base_rr", F.col("hard")).alias("hb"), part("d", ~F.col("hard")).alias("ed"), part("base_rr", ~F.col("hard")).alias("eb"))
    j = kept(j)
    boot = stats.resampled(j, None, "hd", "hb", "ed", "eb")
    each = lambda: F.array(*(F.struct(F.lit(n).alias("quantity"), F.expr(e).alias("v")) for n, e in _QUANTITIES.items()))
    ci = boot.select(F.explode(each()).alias("x")).groupBy("x.quantity").agg(F.expr("percentile(x.v, 0.025D)").alias("lo"), F.expr("percentile(x.v, 0.975D)").alias("hi"))
    mean = j.agg(*(F.avg(x).alias(x) for x in ("hd", "hb", "ed", "eb")), F.count("*").alias("papers"), F.count_if(F.col("hd").isNotNull() & F.col("ed").isNotNull()).alias("papers_in_both"))
    out = mean.select("papers", "papers_in_both", F.explode(each()).alias("x")).select("x.quantity", F.col("x.v").alias("value"), "papers", "papers_in_both")
    return out.join(ci, "quantity").select("quantity", R6("value"), R6("lo"), R6("hi"), "papers", "papers_in_both")


# --- influence and anchors


@query("an_influence", sql(
    """SELECT 'decile' AS section, bin::VARCHAR AS key, count(*) AS n, round(avg(d_rr), 6) AS value, round(avg(d_hit), 6) AS hit FROM (
  SELECT *, floor((row_number() OVER (ORDER BY round(ppmi, 9), context_id, anchor) - 1) / greatest(1, (SELECT count(*) // 10 FROM infl)))::BIGINT AS bin FROM infl) GROUP BY bin
UNION ALL SELECT 'asymmetry', 'mean_abs_difference', count(*), round(avg(abs(fwd - rev)), 6), NULL FROM asym
UNION ALL SELECT 'asymmetry', 'median_abs_difference', count(*), round(quantile_cont(abs(fwd - rev), 0.5), 6), NULL FROM asym
UNION ALL SELECT 'asymmetry', 'frac_same_sign', count(*), round(avg(((fwd > 0) = (rev > 0))::INT), 6), NULL FROM asym
UNION ALL SELECT 'all', 'd_rr', count(*), round(avg(d_rr), 6), round(avg(d_hit), 6) FROM infl""",
    _INFL, _ASYM, "asym AS (SELECT round(fwd, 6) AS fwd, round(rev, 6) AS rev FROM both_ways WHERE fwd IS NOT NULL AND rev IS NOT NULL)",
))
def an_influence(s, d):
    """What the removal of an anchor takes (value: reciprocal rank, hit: R@1) by tenths of its association with the target, over all, and how unlike both directions of a pair are."""
    r = kept(influence(Corpus(s, d)))
    six = lambda section, key, rows, n, v, h: rows.agg(n.alias("n"), R6(v, "value"), (F.round(h, 6) if h is not None else F.lit(None).cast("double")).alias("hit")).select(F.lit(section).alias("section"), F.lit(key).alias("key"), "n", "value", "hit")
    dec = deciles(r).groupBy("bin").agg(F.count("*").alias("n"), R6(F.avg("d_rr"), "value"), R6(F.avg("d_hit"), "hit")).select(F.lit("decile").alias("section"), F.col("bin").cast("string").alias("key"), "n", "value", "hit")
    a = kept(reciprocal(r))
    apart, n = F.abs(F.col("fwd") - F.col("rev")), F.count("*")
    out = dec.unionByName(six("all", "d_rr", r, n, F.avg("d_rr"), F.avg("d_hit")))
    for key, v in (("mean_abs_difference", F.avg(apart)), ("median_abs_difference", F.expr("percentile(abs(fwd - rev), 0.5D)")), ("frac_same_sign", F.avg(((F.col("fwd") > 0) == (F.col("rev") > 0)).cast("double")))):
        out = out.unionByName(six("asymmetry", key, a, n, v, None))
    return out


def _anchored_pairs(s, d) -> DataFrame:
    """Influence with sim, the cosine of target and anchor (vectors chosen from the embeddings by id), and cover: another anchor is as strong."""
    c = Corpus(s, d)
    v = adapters.numbered_vectors(s, d).withColumn("x", scorers.normalised(F.col("x")))
    r = influence(c).withColumn("ppmi", F.round("ppmi", 9)).withColumn("d_rr", F.round("d_rr", 9)).join(scorers.paper_vectors(c.by_paper, scorers.numbered_nodes(c.by_paper.select(F.explode("refs").alias("id")), v)), "citing_id")
    x = lambda name: F.filter("vectors", lambda y: y["id"] == F.col(name))[0]["x"]
    r = r.withColumn("sim", F.round(scorers.dot(x("gold"), x("anchor")), 9)).drop("vectors")
    w = W.partitionBy("citing_id", "context_id").orderBy("anchor")
    best = F.greatest(F.max("ppmi").over(w.rowsBetween(W.unboundedPreceding, -1)), F.max("ppmi").over(w.rowsBetween(1, W.unboundedFollowing)))
    return kept(r.withColumn("cover", F.coalesce(best >= F.col("ppmi"), F.lit(False))))


def _at(rows: DataFrame, value: str, *places) -> DataFrame:
    """One row: values at places (n -> index) of the sorted ones, from counts of equal values."""
    n = rows.agg(F.count(value).alias("n"))
    c = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k")).withColumn("top", F.sum("k").over(W.orderBy("v"))).crossJoin(F.broadcast(n))
    return c.agg(*(F.min(F.when(F.col("top") > f(F.col("n")), F.col("v"))).alias(name) for name, f in places))


_PAIRS = (
    *_DENSE,
    f"pairs AS (SELECT context_id, anchor, round(ppmi, 9) AS ppmi, round(d_rr, 9) AS d_rr, round({_COS}, 9) AS sim FROM infl JOIN vec p ON p.vec_id = gold::BIGINT % (SELECT n FROM vecs) JOIN vec q ON q.vec_id = anchor::BIGINT % (SELECT n FROM vecs))",
    "covered AS (SELECT x.*, coalesce((SELECT max(y.ppmi) FROM pairs y WHERE y.context_id = x.context_id AND y.anchor <> x.anchor) >= x.ppmi, false) AS cover FROM pairs x)",
    "sim_edges AS (SELECT xs[len(xs) // 3 + 1] AS lo, xs[least(2 * len(xs) // 3, len(xs) - 1) + 1] AS hi FROM (SELECT list_sort(list(sim)) AS xs FROM pairs))",
    "ppmi_edge AS (SELECT xs[len(xs) // 2 + 1] AS high FROM (SELECT list_sort(list(ppmi) FILTER (ppmi > 0)) AS xs FROM pairs))",
    "banded_pairs AS (SELECT *, CASE WHEN ppmi <= 0 THEN 'zero' WHEN ppmi >= high THEN 'high' ELSE 'low' END AS pb, CASE WHEN sim < lo THEN 'low' WHEN sim >= hi THEN 'high' ELSE 'mid' END AS cb, CASE WHEN ppmi <= 0 THEN 'non_cocited' WHEN d_rr > 0 THEN 'informative' ELSE 'redundant' END AS category FROM covered, sim_edges, ppmi_edge)",
)


def _banded(s, d) -> DataFrame:
    r = _anchored_pairs(s, d)
    e = _at(r, "sim", ("lo", lambda n: F.floor(n / 3)), ("hi", lambda n: F.least(F.floor(2 * n / 3), n - 1)))
    h = _at(r.where("ppmi > 0"), "ppmi", ("high", lambda n: F.floor(n / 2)))
    r = r.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(h))
    pb = F.when(F.col("ppmi") <= 0, "zero").when(F.col("ppmi") >= F.col("high"), "high").otherwise("low")
    cb = F.when(F.col("sim") < F.col("lo"), "low").when(F.col("sim") >= F.col("hi"), "high").otherwise("mid")
    category = F.when(F.col("ppmi") <= 0, "non_cocited").when(F.col("d_rr") > 0, "informative").otherwise("redundant")
    return r.select("*", pb.alias("pb"), cb.alias("cb"), category.alias("category"))


@query("agg_grid", sql("SELECT p AS ppmi, c AS cosine, count(d_rr) AS n, round(avg(d_rr), 6) AS mean_d_rr, round(avg((d_rr > 0)::INT), 6) AS frac_positive FROM (VALUES ('zero'), ('low'), ('high')) x(p) CROSS JOIN (VALUES ('low'), ('mid'), ('high')) y(c) LEFT JOIN banded_pairs ON pb = p AND cb = c GROUP BY ALL", _INFL, *_PAIRS))
def agg_grid(s, d):
    """Pairs of target and anchor by bands of association and cosine, all nine cells."""
    rows = _banded(s, d).groupBy(F.col("pb").alias("ppmi"), F.col("cb").alias("cosine")).agg(F.count("*").alias("n"), R6(F.avg("d_rr"), "mean_d_rr"), R6(F.avg((F.col("d_rr") > 0).cast("double")), "frac_positive"))
    cells = s.range(9).select(F.element_at(F.array(*map(F.lit, ("zero", "low", "high"))), (F.floor(F.col("id") / 3) + 1).cast("int")).alias("ppmi"), F.element_at(F.array(*map(F.lit, ("low", "mid", "high"))), (F.col("id") % 3 + 1).cast("int")).alias("cosine"))
    return cells.join(rows, ["ppmi", "cosine"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("an_anchor_analysis", sql(
    """SELECT 'grid' AS section, pb || '|' || cb AS key, count(*) AS n, round(avg(d_rr), 6) AS mean_d_rr FROM banded_pairs GROUP BY ALL
UNION ALL SELECT 'category', category, count(*), round(avg(d_rr), 6) FROM banded_pairs GROUP BY ALL
UNION ALL SELECT 'null', CASE WHEN ppmi <= 0 THEN 'sparsity' WHEN cover THEN 'redundancy' ELSE 'subthreshold' END, count(*), 0 FROM banded_pairs WHERE d_rr = 0 GROUP BY ALL
UNION ALL SELECT 'topical', CASE WHEN sim >= lo THEN 'aligned' ELSE 'cross_topic' END, count(*), round(avg(d_rr), 6) FROM banded_pairs WHERE category = 'informative' GROUP BY ALL""",
    _INFL, *_PAIRS,
))
def an_anchor_analysis(s, d):
    """The grid, the categories, why removals change nothing, and informative anchors by topic, in one pass over the pairs."""
    r = _banded(s, d)
    row = lambda section, key, ok=None: F.when(F.lit(True) if ok is None else ok, F.struct(F.lit(section).alias("section"), key.alias("key")))
    null = F.when(F.col("ppmi") <= 0, "sparsity").when(F.col("cover"), "redundancy").otherwise("subthreshold")
    each = F.array(row("grid", F.concat_ws("|", "pb", "cb")), row("category", F.col("category")), row("null", null, F.col("d_rr") == 0), row("topical", F.when(F.col("sim") >= F.col("lo"), "aligned").otherwise("cross_topic"), F.col("category") == "informative"))
    return r.select("d_rr", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).groupBy("x.section", "x.key").agg(F.count("*").alias("n"), R6(F.avg("d_rr"), "mean_d_rr"))


_MAP_EDGES = (1, 2, 3, 4)


@query("agg_anchor_map", sql("SELECT CASE WHEN ppmi <= 0 THEN 0 ELSE 1 + (ppmi >= 1)::INT + (ppmi >= 2)::INT + (ppmi >= 3)::INT + (ppmi >= 4)::INT END::BIGINT AS band, len(list_filter(e, lambda x: sim >= x))::BIGINT AS octile, count(*) AS n, round(avg(d_rr), 6) AS mean_d_rr FROM pairs, (SELECT quantile_cont(sim, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS e FROM pairs) GROUP BY ALL", _INFL, *_PAIRS[:3]))
def agg_anchor_map(s, d):
    """Mean influence by bands of association (none, then at the edges 1 to 4) and octiles of cosine."""
    r = _anchored_pairs(s, d)
    e = r.agg(F.expr("percentile(sim, array(0.125D, 0.25D, 0.375D, 0.5D, 0.625D, 0.75D, 0.875D))").alias("e"))
    band = F.when(F.col("ppmi") <= 0, 0).otherwise(sum(((F.col("ppmi") >= x).cast("int") for x in _MAP_EDGES), F.lit(1)))
    return r.crossJoin(F.broadcast(e)).groupBy(band.cast("long").alias("band"), F.size(F.filter("e", lambda x: F.col("sim") >= x)).cast("long").alias("octile")).agg(F.count("*").alias("n"), R6(F.avg("d_rr"), "mean_d_rr"))


# --- first stage


_FIRST = (
    *_DENSE,
    "asked AS (SELECT citing_id || ':' || location AS query, citing_id, location, min(context_id) AS ctx FROM anc WHERE citing_id::BIGINT % 20 = 0 GROUP BY ALL)",
    f"retrieved AS (SELECT query, citing_id, location, id, rank FROM (SELECT query, a.citing_id, a.location, id, row_number() OVER (PARTITION BY query ORDER BY round({_COS}, 9) DESC, id) AS rank FROM asked a JOIN vec p ON p.vec_id = {_HASH.format('ctx')} % (SELECT n FROM vecs), paper JOIN vec q ON q.vec_id = id::BIGINT % (SELECT n FROM vecs)) WHERE rank <= 100)",
)


def _asked(c: Corpus, k: int) -> tuple[DataFrame, DataFrame]:
    """query, vec_id: sites of papers whose id is divisible by 20 with the vector of their first context; vec_id, id, rank: the k papers nearest to each of these vectors.

    Sites of one vector have the same papers, and papers of one vector the same cosine, so vectors meet vectors. The
    best k papers are among those of the best k vectors, each by its first paper; vectors behind k papers that are
    nearer go, and so does what isn't among a vector's first k papers."""
    v = adapters.numbered_vectors(c.spark, c.folder).withColumn("x", scorers.normalised(F.col("x")))
    n = F.broadcast(v.agg(F.count("*").alias("size")))
    q = c.ctx.where(F.col("citing_id").cast("long") % 20 == 0).groupBy("citing_id", "location").agg(F.min("context_id").alias("ctx")).crossJoin(n)
    q = kept(q.select(F.concat_ws(":", "citing_id", "location").alias("query"), (F.conv(F.substring(F.md5(F.col("ctx").cast("binary")), 1, 8), 16, 10).cast("long") % F.col("size")).alias("vec_id")))
    docs = c.papers.select("id").crossJoin(n).select("id", (F.col("id").cast("long") % F.col("size")).alias("vec_id"))
    first = kept(docs.groupBy("vec_id").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    top = scorers.top_k_blocks(q.select("vec_id").distinct().join(v, "vec_id").select(F.col("vec_id").alias("query"), "x"), first.join(v, "vec_id").select(F.col("first").alias("id"), F.col("x").alias("y")), k)
    top = top.select("query", F.col("id").alias("first"), "sim", "rank").join(first, "first")
    before = F.coalesce(F.sum("n").over(W.partitionBy("query").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    top = top.withColumn("before", before).withColumn("before", F.min("before").over(W.partitionBy("query", "sim"))).where(F.col("before") < k).select("query", "vec_id", "sim")
    some = docs.withColumn("r", F.row_number().over(W.partitionBy("vec_id").orderBy("id"))).where(F.col("r") <= k).select("vec_id", "id")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("sim"), "id"))
    return q, kept(top.join(some, "vec_id").withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("vec_id"), "id", "rank"))


@query("an_retrieve", sql("SELECT query, string_agg(id, ',' ORDER BY rank) AS candidates FROM retrieved GROUP BY query", *_FIRST))
def an_retrieve(s, d):
    """The task over the whole corpus: for each asked site the 100 papers nearest to its first context, in order; gold sets play no part."""
    q, top = _asked(Corpus(s, d), 100)
    top = top.groupBy("vec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]), ",").alias("candidates"))
    return q.join(top, "vec_id").select("query", "candidates")


@query("agg_recall_cutoffs", sql("SELECT k, round(count(*) FILTER (rank <= k) / count(*)::DOUBLE, 6) AS recall, count(*) AS gold FROM (SELECT rank FROM site JOIN asked USING (citing_id, location) LEFT JOIN retrieved r ON r.query = asked.query AND r.id = refid), (VALUES (1), (10), (100)) c(k) GROUP BY k", *_FIRST))
def agg_recall_cutoffs(s, d):
    """First-stage recall: share of all references of the asked sites that are among the first k."""
    c = Corpus(s, d)
    q, top = _asked(c, 100)
    gold = c.ctx.where(F.col("citing_id").cast("long") % 20 == 0).select(F.concat_ws(":", "citing_id", "location").alias("query"), F.col("refid").alias("id")).distinct()
    hit = gold.join(q, "query", "left").join(top, ["vec_id", "id"], "left").withColumn("k", F.explode(F.array(*map(F.lit, (1, 10, 100)))))
    return hit.groupBy("k").agg(R6(F.count_if(F.col("rank") <= F.col("k")) / F.count("*"), "recall"), F.count("*").alias("gold"))


# --- thresholds of the window overlap: conversations as papers, turns as contexts, the references by their text


THETAS = (0.003, 0.005, 0.01, 0.02)
REFERENCE_THETA = 0.005
_THETA_VALUES = ", ".join(f"({x}::DOUBLE)" for x in THETAS)
_THETA = (
    """turns AS (SELECT conv_id AS grp, turn AS i, min(text) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL)""",
    """sh AS (SELECT grp, i, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS s FROM (SELECT grp, i, regexp_extract_all(lower(text), '[a-z]+') AS w FROM turns))""",
    """link AS (SELECT a.grp, a.i, b.i AS j, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE AS jaccard FROM sh a JOIN sh b ON a.grp = b.grp AND a.i < b.i WHERE len(a.s) > 0 AND len(b.s) > 0)""",
    f"th AS (SELECT theta FROM (VALUES {_THETA_VALUES}) v(theta))",
    "reach(theta, grp, i, j) AS (SELECT theta, grp, i, i FROM turns, th UNION SELECT r.theta, r.grp, r.i, x.j FROM reach r JOIN (SELECT grp, i, j, jaccard FROM link UNION ALL SELECT grp, j, i, jaccard FROM link) x ON x.grp = r.grp AND x.i = r.j AND x.jaccard >= r.theta)",
    "placed AS (SELECT theta, grp, i, min(j) AS location, ('0x' || substr(md5(text), 1, 8))::BIGINT % 1000 AS ref FROM reach JOIN turns USING (grp, i) GROUP BY theta, grp, i, text)",
    "anchored_at AS (SELECT p.theta, p.grp, p.i, p.ref, p.location, list_sort(list_distinct(list(q.ref) FILTER (q.ref <> p.ref))) AS anchors FROM placed p JOIN placed q USING (theta, grp, location) GROUP BY ALL)",
    "refs AS (SELECT grp, list_distinct(list(ref)) AS refs FROM placed GROUP BY grp)",
    # distractors: the paper's references that aren't cited at the site
    "pooled AS (SELECT theta, grp, i, ref, location, coalesce(anchors, []) AS anchors, list_sort(list_filter(refs, lambda x: x <> ref AND NOT list_contains(coalesce(anchors, []), x))) AS candidates FROM anchored_at JOIN refs USING (grp))",
    "eligible_at AS (SELECT * FROM pooled WHERE len(anchors) > 0 AND len(candidates) >= 2)",
    f"common AS (SELECT grp, i, count(DISTINCT candidates) = 1 AS same_pool, count(DISTINCT anchors) = 1 AS same_anchors FROM eligible_at GROUP BY ALL HAVING count(*) = {len(THETAS)})",
    f"swappable AS (SELECT r.grp, r.i FROM eligible_at r JOIN pooled p USING (grp, i) WHERE r.theta = {REFERENCE_THETA} GROUP BY r.grp, r.i HAVING bool_and(len(p.anchors) > 0 AND len(list_intersect(p.anchors, r.candidates)) = 0))",
)


def _theta_sql(select: str) -> str:
    return f"WITH RECURSIVE {', '.join(_THETA)} {select}"


def _rebuilt(s, d) -> DataFrame:
    """theta, grp, i, ref, location, anchors, candidates: sites, anchors and possible distractors rebuilt at every threshold, from one join at the lowest."""
    w = adapters.table(s, d, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy(F.col("conv_id").alias("grp"), F.col("turn").alias("i")).agg(F.min("text").alias("text"))
    p = sites.window_pairs(w, 2, min(THETAS))
    at = None
    for x in THETAS:
        own = sites.location_labels(w.select("grp", "i"), p.where(F.col("jaccard") >= x).select("grp", "i", "j")).withColumn("theta", F.lit(x))
        at = own if at is None else at.unionByName(own)
    ref = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 8), 16, 10).cast("long") % 1000
    at = at.join(w.select("grp", "i", ref.alias("ref")), ["grp", "i"])
    site = at.groupBy("theta", "grp", "location").agg(F.collect_set("ref").alias("cited"))
    refs = w.groupBy("grp").agg(F.collect_set(ref).alias("refs"))
    at = at.join(site, ["theta", "grp", "location"]).join(refs, "grp")
    return kept(at.select("theta", "grp", "i", "ref", "location", F.array_sort(F.array_remove("cited", F.col("ref"))).alias("anchors"), F.array_sort(F.array_except("refs", "cited")).alias("candidates")))


def _eligible_at(rows: DataFrame) -> DataFrame:
    return rows.where((F.size("anchors") > 0) & (F.size("candidates") >= 2))


def _common(rows: DataFrame) -> DataFrame:
    """grp, i, same_pool, same_anchors of contexts that are eligible at every threshold."""
    g = _eligible_at(rows).groupBy("grp", "i").agg(F.count("*").alias("n"), F.count_distinct("candidates").alias("c"), F.count_distinct("anchors").alias("a"))
    return g.where(F.col("n") == len(THETAS)).select("grp", "i", (F.col("c") == 1).alias("same_pool"), (F.col("a") == 1).alias("same_anchors"))


def _swappable(rows: DataFrame) -> DataFrame:
    """grp, i: pools of the reference threshold for whose context every threshold has an anchor and none that is a candidate."""
    r = _eligible_at(rows.where(F.col("theta") == REFERENCE_THETA)).select("grp", "i", F.col("candidates").alias("pool"))
    ok = (F.size("anchors") > 0) & ~F.arrays_overlap("anchors", "pool")
    return rows.join(r, ["grp", "i"]).groupBy("grp", "i").agg(F.bool_and(ok).alias("ok")).where("ok").select("grp", "i")


@query("jn_cohort", _theta_sql("SELECT grp, i, same_pool, same_anchors FROM common"))
def jn_cohort(s, d):
    """Contexts that are eligible at every threshold, and whether their candidates and anchors are the same throughout."""
    return _common(_rebuilt(s, d))


@query("jn_swap_cohort", _theta_sql("SELECT grp, i FROM swappable"))
def jn_swap_cohort(s, d):
    """Contexts whose pool at the reference threshold is a clean test of every threshold's anchors."""
    return _swappable(_rebuilt(s, d))


@query("agg_theta_composition", _theta_sql("SELECT theta, count(DISTINCT (grp, location)) AS locations, count(*) AS contexts, count(*) FILTER (len(anchors) > 0) AS anchored, round(avg(len(anchors)), 6) AS mean_anchors, count(*) FILTER (len(anchors) > 0 AND len(candidates) >= 2) AS pools FROM pooled GROUP BY theta"))
def agg_theta_composition(s, d):
    g = _rebuilt(s, d).groupBy("theta")
    return g.agg(F.count_distinct("grp", "location").alias("locations"), F.count("*").alias("contexts"), F.count_if(F.size("anchors") > 0).alias("anchored"), R6(F.avg(F.size("anchors")), "mean_anchors"), F.count_if((F.size("anchors") > 0) & (F.size("candidates") >= 2)).alias("pools"))


@query("an_theta", _theta_sql(f"""SELECT e.theta, count(*) AS pools, count(c.grp) AS in_cohort, count(*) FILTER (c.same_pool) AS same_pool, count(*) FILTER (c.same_pool AND c.same_anchors) AS same_anchors, count(w.grp) AS swappable,
  count(r.grp) AS in_reference, count(*) FILTER (r.anchors = e.anchors) AS reference_anchors, count(*) FILTER (r.candidates = e.candidates) AS reference_pool
FROM eligible_at e LEFT JOIN common c USING (grp, i) LEFT JOIN swappable w USING (grp, i) LEFT JOIN (SELECT * FROM eligible_at WHERE theta = {REFERENCE_THETA}) r USING (grp, i) GROUP BY e.theta"""))
def an_theta(s, d):
    """Of each threshold's pools: how many are in the cohort of all thresholds, with the same candidates, and anchors, throughout, how many are like the reference's."""
    rows = _rebuilt(s, d)
    e = _eligible_at(rows)
    there = lambda x, name: x.withColumn(name, F.lit(True))
    r = e.where(F.col("theta") == REFERENCE_THETA).select("grp", "i", F.col("anchors").alias("ra"), F.col("candidates").alias("rc"))
    j = e.join(there(_common(rows), "c"), ["grp", "i"], "left").join(there(_swappable(rows), "w"), ["grp", "i"], "left").join(there(r, "r"), ["grp", "i"], "left")
    n = F.count_if
    return j.groupBy("theta").agg(F.count("*").alias("pools"), n(F.col("c")).alias("in_cohort"), n(F.col("same_pool")).alias("same_pool"), n(F.col("same_pool") & F.col("same_anchors")).alias("same_anchors"), n(F.col("w")).alias("swappable"), n(F.col("r")).alias("in_reference"), n(F.col("ra") == F.col("anchors")).alias("reference_anchors"), n(F.col("rc") == F.col("candidates")).alias("reference_pool"))
