"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Within a source every document's expected number of copies is the same, target / source size. Documents are
put in an order (size class, then md5 of the id), their expected copies are summed up along it, one offset
that is random per source is added, and a document is emitted once for each integer that its interval
crosses. As neighbours in the order are of like size, the words taken come near the target.

The running sum over a source is a rank, found without gathering a source in one task: each (source, size
class) is cut into about sqrt(n) runs of md5 values, runs are numbered by small windows over their counts,
and only the rows of one run meet in a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import WORD, Scratch

WEIGHTS, CAP = (5.0, 2.0, 1.0), 3
_SPACE = float(1 << 60)


def _hash60(c: F.Column) -> F.Column:
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, target of sources (source, source_size): all words shared by weight, none above cap times its own size.

    Weights repeat over the sources in code point order, null last. Resharing the excess until none is
    above its cap fills up all sources to one level: target = min(cap * size, level * weight), and the level
    is the first, in order of cap * size / weight, that leaves the next source below its cap. There is a row
    for each source, so this one window runs over few rows."""
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("k") % F.lit(len(weights)) + 1).cast("int"))
    top = F.lit(float(cap)) * F.col("source_size")
    s = sizes.withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", w).withColumn("top", top).withColumn("r", top / F.col("w"))
    order = W.orderBy("r", "k")
    all_ = W.partitionBy()
    # the level if the sources up to, but without, this one are at their cap
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_) - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("r"))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("fits"), F.struct("r", "k"))).over(all_))
    # the sum of all caps is at least the sum of all sizes if cap >= 1, so some level fits
    return s.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("level") > F.col("r")), F.col("top")).otherwise(F.col("level") * F.col("w")).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text; null: 0) and the keys of the order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    bits = F.bin("size")
    return d.withColumn("class", F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 3))).withColumn("h", _hash60(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (size * copies) of every document.

    Null texts have size 0; a null source is a source of its own, last in order. Rows of one id are ordered
    as they are equal in all that is returned. Without any word all targets and copies are 0. Other columns
    than doc_id, source and text aren't read. The offset depends on source and seed alone, so reruns agree."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    rows = scratch.keep(sized(docs).withColumn("source_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))))
    groups = scratch.keep(rows.groupBy("source_key", "class").agg(F.first("source").alias("source"), F.count("*").alias("n"), F.sum("size").alias("words")))
    sources = groups.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    goal = targets(sources.select("source", "source_size"), weights, cap).withColumn("source_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))).drop("source")
    goal = scratch.keep(goal)
    classes = groups.select("source_key", "class", F.ceil(F.sqrt("n")).cast("long").alias("runs"))
    rows = rows.join(classes, ["source_key", "class"]).withColumn("run", F.floor(F.col("h") / F.lit(_SPACE) * F.col("runs"))).drop("runs")
    counts = scratch.keep(rows.groupBy("source_key", "class", "run").agg(F.count("*").alias("n")))
    by_class = groups.select("source_key", "class", (F.sum("n").over(W.partitionBy("source_key").orderBy("class")) - F.col("n")).alias("first"))
    starts = counts.withColumn("within", F.sum("n").over(W.partitionBy("source_key", "class").orderBy("run")) - F.col("n")).join(by_class, ["source_key", "class"]).select("source_key", "class", "run", (F.col("first") + F.col("within")).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("source_key", "class", "run").orderBy("h", "doc_id", "size")))
    ranked = ranked.join(scratch.keep(starts), ["source_key", "class", "run"]).join(goal, "source_key")
    offset = _hash60(F.concat_ws(":", F.lit(str(seed)), F.col("source_key"))) / F.lit(_SPACE)
    rank, each = F.col("before") + F.col("rank"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = (F.floor(rank * each + offset) - F.floor((rank - 1) * each + offset)).cast("long")
    return ranked.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def emit(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, seed: int = 0) -> DataFrame:
    """Rows of docs as often as the mix takes them, with copy (1, 2, ...), which replaces a column of that name.

    Rows that share an id, or have none, are emitted alike, as often as the one of them that is taken most. Null and
    empty texts have size 0 and are taken as often as others of their source; an empty table, or one without any
    word, gives no rows. All other columns are kept, whatever their names."""
    chosen = mix(docs, weights, cap, seed).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    joined = docs.join(chosen, docs["doc_id"].cast("long").eqNullSafe(chosen["doc_id"]))
    own = [docs[f"`{c}`"] for c in docs.columns if c.lower() != "copy"]
    return joined.select(*own, F.explode(F.sequence(F.lit(1), chosen["copies"])).alias("copy"))


#: The same in DuckDB, from the definition: a rank over each whole source.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(k % 3 + 1)::INT] AS w, 3.0::DOUBLE * source_size AS top FROM s
), fill(step, capped) AS (
  SELECT 0, []::BIGINT[]
  UNION ALL
  SELECT step + 1, (SELECT list(k ORDER BY k) FROM w, (SELECT (sum(source_size) - coalesce(sum(top) FILTER (list_contains(fill.capped, k)), 0)) / nullif(sum(w) FILTER (NOT list_contains(fill.capped, k)), 0) AS level FROM w) WHERE list_contains(fill.capped, k) OR level * w > top)
  FROM fill WHERE step <= (SELECT count(*) FROM w)
), last AS (
  SELECT coalesce(capped, []) AS capped FROM fill ORDER BY step DESC LIMIT 1
), t AS (
  SELECT w.*, CASE WHEN list_contains(capped, k) THEN top ELSE (SELECT (sum(source_size) - coalesce(sum(top) FILTER (list_contains(capped, k)), 0)) / nullif(sum(w) FILTER (NOT list_contains(capped, k)), 0) FROM w, last) * w END AS target FROM w, last
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.target / nullif(t.source_size, 0) AS each,
    ('0x' || substr(md5('0:' || coalesce('=' || d.source, 'null')), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u,
    row_number() OVER (PARTITION BY d.source ORDER BY lpad(length(bin(d.size))::VARCHAR, 2, '0') || substr(bin(d.size), 1, 3), substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 15), d.doc_id, d.size) AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (floor(n * coalesce(each, 0) + u) - floor((n - 1) * coalesce(each, 0) + u))::BIGINT AS copies,
  (size * (floor(n * coalesce(each, 0) + u) - floor((n - 1) * coalesce(each, 0) + u)))::BIGINT AS taken FROM r
"""
