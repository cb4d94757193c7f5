"""Drawing items for annotation."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window as W, functions as F

from .pools import keyed

RESERVOIR = 20_000


def quotas(total: int, shares: list[float]) -> list[int]:
    """total split by shares: floors, and what remains in order."""
    out = [int(total * x / sum(shares)) for x in shares]
    for k in range(total - sum(out)):
        out[k % len(out)] += 1
    return out


def reservoir(rows: DataFrame, size: int = RESERVOIR, seed: int = 0) -> DataFrame:
    """rows (cell, citing_id, context_id) of the smallest hashes, at most size a cell, with the cell's population.

    Hash prefixes cut a cell into small parts first, so no task ranks a whole cell."""
    rows = rows.withColumn("h", keyed(seed, "context_id"))
    part = rows.withColumn("n", F.row_number().over(W.partitionBy("cell", F.substring("h", 1, 3)).orderBy("h"))).where(F.col("n") <= size)
    best = part.withColumn("n", F.row_number().over(W.partitionBy("cell").orderBy("h"))).where(F.col("n") <= size).drop("n")
    return best.join(F.broadcast(rows.groupBy("cell").agg(F.count("*").alias("population"))), "cell")


def draw(rows: DataFrame, want: dict[int, int], per_paper: int = 2, seed: int = 0, shares: dict[str, float] | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """cell, tier, citing_id, context_id, population: items in hash order, at most per_paper of a paper over all cells, cells in order.

    shares split a cell's quota by the rows' tier; exclude (context_id) names items that are taken elsewhere. A cell
    that has too few items stays short. The choice depends on all before it, so it is made on the driver, over
    reservoirs of bounded size."""
    if "tier" not in rows.columns:
        rows = rows.withColumn("tier", F.lit("all"))
    if exclude is not None:
        rows = rows.join(exclude.select("context_id"), "context_id", "left_anti")
    names = list(shares or {"all": 1.0})
    left = {(c, t): q for c, n in want.items() for t, q in zip(names, quotas(n, list((shares or {"all": 1.0}).values())))}
    seen: Counter = Counter()
    out = []
    for r in reservoir(rows, seed=seed).orderBy("cell", "h").toLocalIterator():
        key = r["cell"], r["tier"] if shares else "all"
        if left.get(key, 0) > 0 and seen[r["citing_id"]] < per_paper:
            seen[r["citing_id"]] += 1
            left[key] -= 1
            out.append((r["cell"], r["tier"], r["citing_id"], r["context_id"], r["population"]))
    return rows.sparkSession.createDataFrame(out, "cell long, tier string, citing_id string, context_id string, population long")


def sheets(drawn: DataFrame, readers: tuple[str, ...], seed: int = 0) -> DataFrame:
    """reader, place, item_id, context_id, cell, tier, cell_population, cell_drawn: every reader has every item, under a label that tells nothing, in an order of their own."""
    label = F.row_number().over(W.orderBy(keyed(seed, F.lit("item"), "context_id")))  # as many rows as are drawn
    key = drawn.withColumn("item_id", F.format_string("item-%04d", label)).withColumn("cell_drawn", F.count("*").over(W.partitionBy("cell")))
    key = key.withColumn("reader", F.explode(F.array(*map(F.lit, readers))))
    place = F.row_number().over(W.partitionBy("reader").orderBy(keyed(seed, "reader", "context_id")))
    return key.select("reader", place.cast("long").alias("place"), "item_id", "context_id", "cell", "tier", F.col("population").alias("cell_population"), "cell_drawn")
