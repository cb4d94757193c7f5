"""Bounded samples of labelled documents, and the small models that are fitted to them on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import crc_rest, map_arrow, texts_of

#: Folds of crc32(doc_id as text): rows of fold 0 are held out of all learning from labels.
FOLDS = 5
#: Labelled documents of either class, at most, that a classifier is fitted to.
PER_CLASS = 1500
#: Characters of such documents of a class together, where a classifier needs the texts themselves.
SAMPLE_CHARS = 32 << 20


def held_out(n: int = FOLDS, fold: int = 0) -> F.Column:
    return crc_rest(n) == fold


def chosen(docs: DataFrame, labels: DataFrame, column: str, per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, y, text of at most per_class documents of either label (0 or 1) outside the held-out fold, those with the smallest hashes; how many labelled ones there are.

    A document with several labels has the largest, one with several texts the first of them. Only the chosen
    ids, a bounded number, are broadcast."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out())
    own = own.groupBy("doc_id").agg(F.max("y").alias("y"))
    count = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    some = [own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = some[0].unionAll(some[1]).withColumnRenamed("doc_id", "_id")
    return texts_of(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "y").agg(F.min("text").alias("text")), count


def sample(docs: DataFrame, labels: DataFrame, column: str, reduce: Callable[[], Callable[[list[str]], list[bytes]]], per_class: int = PER_CLASS) -> list[tuple[int, int, float, bytes]]:
    """doc_id, label, weight and what reduce()(texts) makes of the text, of the chosen documents.

    Weights restore the shares that the classes have among all labels. Texts are reduced where they are read."""
    texts, count = chosen(docs, labels, column, per_class)

    def run(batches):
        f = reduce()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(f(b.column("text").to_pylist()), pa.binary())], names=["doc_id", "y", "x"])

    return weighted(map_arrow(texts, run, "doc_id long, y int, x binary").collect(), count)


def sampled_texts(docs: DataFrame, labels: DataFrame, column: str, per_class: int = PER_CLASS, most: int = SAMPLE_CHARS) -> list[tuple[int, int, float, str]]:
    """The same with the texts themselves, of as many of the chosen documents of a class, in order of their hashes, as have so many characters together."""
    texts, count = chosen(docs, labels, column, per_class)
    # at most 2 per_class rows: the window is small, and texts stay out of it
    size = texts.select("doc_id", "y", F.length("text").alias("n"))
    fits = size.withColumn("sum", F.sum("n").over(W.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("sum") <= most).select(F.col("doc_id").alias("_id"))
    rows = texts.join(F.broadcast(fits), F.col("doc_id") == F.col("_id")).select("doc_id", "y", F.col("text").alias("x")).collect()
    return weighted(rows, count)


def weighted(rows: list, count: dict[int, int]) -> list[tuple]:
    """(doc_id, y, x) rows in order of id with their weights."""
    got = {y: sum(r["y"] == y for r in rows) for y in (0, 1)}
    total = sum(count.get(y, 0) for y in (0, 1) if got[y])
    return sorted((r["doc_id"], r["y"], count[r["y"]] / total * len(rows) / got[r["y"]], r["x"]) for r in rows)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights, bias last, by Newton's method with a ridge on all but the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b, keep = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (w * (p - y)) + keep * b)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
