"""Checks of a corpus: every problem is a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T

#: Fixed value: the share of contexts that can't be aligned above which a corpus fails.
MAX_UNALIGNABLE = 0.5


def validate(contexts: DataFrame, papers: DataFrame, splits: DataFrame | None = None, there: dict[str, bool] | None = None) -> DataFrame:
    """check, id of each problem of contexts (context_id, citing_id, refid, raw, masked), papers (id, authors as JSON or an array) and splits (context_id, split).

    Without splits, contexts tell their own; there: which files were found. raw and authors may be absent."""
    row = lambda d, check, c: d.select(F.lit(check).alias("check"), c.cast("string").alias("id"))
    col = F.col
    twice = contexts.groupBy("context_id").agg(F.count("*").alias("n")).where("n > 1")
    lost = contexts.join(papers.select(col("id").alias("refid")), "refid", "left_anti")
    blank = contexts.where(F.regexp_replace("masked", r"^\s+|\s+$", "") == "")
    targets = contexts.where(F.size(F.split("masked", "TARGETCIT", -1)) != 2)
    told = contexts if splits is None else splits.join(contexts.select("context_id", "citing_id"), "context_id")
    both = told.groupBy("citing_id").agg(F.count_distinct("split").alias("n")).where("n > 1")
    out = row(twice, "duplicate_context", col("context_id"))
    for d, check, c in ((lost, "unknown_reference", "context_id"), (blank, "empty_window", "context_id"), (targets, "targets", "context_id"), (both, "split_overlap", "citing_id")):
        out = out.unionByName(row(d, check, col(c)))
    if "authors" in papers.columns and papers.schema["authors"].dataType.typeName() == "string":
        out = out.unionByName(row(papers.where(~F.ltrim("authors").startswith("[")), "authors", col("id")))
    if "raw" in contexts.columns:
        rate = contexts.agg(F.avg(T.markers_with_numbers(col("raw"), col("masked")).isNull().cast("double")).alias("rate"))
        out = out.unionByName(row(rate.where(col("rate") > MAX_UNALIGNABLE), "unalignable", F.lit("corpus")))
    for name, found in (there or {}).items():
        if not found:
            out = out.unionByName(row(contexts.sparkSession.range(1), "missing_file", F.lit(name)))
    return out
