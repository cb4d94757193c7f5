"""Embedding near-duplicates as an exact metric range join.

Links are pairs of cosine >= t, that is, of unit vectors at Euclidean distance <= r = sqrt(2 - 2t). Some of
the vectors are pivots; a vector's home is the cell of its nearest pivot. If u and v link and v's home is p',
then d(u, p') <= d(v, p') + r <= d(v, p) + r <= d(u, p) + 2r for the home p of u, and u is within r of the
plane between p and p': u is replicated to the cells that satisfy both, so all of v's partners are in v's
cell, and cells join independently: home vectors against all members, in blocks of bounded size. A cell gives
the number of links of its home vectors and a spanning forest of the links, never the pairs themselves.

In many dimensions few cells are out of reach for uniformly scattered vectors, so that the work is near that
of comparing all pairs; it then is one matrix product for each pair of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, components, forest, map_arrow

THRESHOLD = 0.95
#: Vectors to a pivot, at first; pivots at most; members of a block.
PER_PIVOT, MAX_PIVOTS, BLOCK = 4096, 1024, 8192
_SURE = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows(col, dim: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: indexes and a matrix, of a column of byte strings of doubles."""
    data = col.to_pylist()
    out = {}
    for n in np.unique(dim):
        at = np.flatnonzero(dim == n)
        out[int(n)] = at, np.frombuffer(b"".join(data[k] for k in at), np.float64).reshape(len(at), int(n))
    return out


def exact(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y, pair by pair, have that cosine in double precision; near the threshold from sums of their own."""
    nx, ny = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    c = np.einsum("ij,ij->i", x, y) / (np.sqrt(nx) * np.sqrt(ny))
    out = c >= threshold
    for k in np.flatnonzero(np.abs(c - threshold) < 1e-12):
        a, b = x[k], y[k]
        out[k] = float(np.dot(a, b)) / (float(np.sqrt(np.dot(a, a))) * float(np.sqrt(np.dot(b, b)))) >= threshold
    return out


def linked(x: np.ndarray, y: np.ndarray, threshold: float):
    """Yields (rows of x, rows of y): pairs that have that cosine, some rows of x at a time.

    A product in single precision leaves out what is below the threshold by more than its error bound; what
    is left is computed in double precision."""
    dim = x.shape[1]
    slack = 1e-6 + 2.4e-7 * (dim + 4)
    x32, y32 = _unit(x).astype(np.float32), _unit(y).astype(np.float32).T
    step = max(1, (1 << 22) // len(y))
    for lo in range(0, len(x), step):
        near = np.flatnonzero(x32[lo : lo + step] @ y32 >= np.float32(threshold - slack))
        i, j = near // len(y) + lo, near % len(y)
        part = max(1, (1 << 22) // dim)
        ok = [exact(x[i[k : k + part]], y[j[k : k + part]], threshold) for k in range(0, len(i), part)]
        ok = np.concatenate(ok) if ok else np.empty(0, bool)
        yield i[ok], j[ok]


def cells_of(x: np.ndarray, pivots: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each row, and for each cell whether the row belongs to it."""
    r = np.sqrt(max(0.0, 2 - 2 * threshold))
    c = _unit(x) @ pivots.T
    home = c.argmax(1)
    d = np.sqrt(np.maximum(0, 2 - 2 * c))
    at = np.arange(len(x))
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    member = (d <= d[at, home][:, None] + 2 * r + _SURE) & (c[at, home][:, None] - c <= r * apart[home] + _SURE)
    return home, member


def components_of(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do
    vectors of different dimension. A vector is first scaled by a power of two to components of at most 1, which
    changes no cosine, so none of its squares overflows or vanishes whatever its length. Equal vectors are one node, so copies cost nothing, and each row of them
    links with each other one. component_id is the smallest vec_id that links reach; rows with a null vec_id
    are linked, but name no component (they get null where there is no other id, and are not kept)."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    x = F.transform(F.col("embedding"), lambda v: v.cast("double") + F.lit(0.0))
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = F.coalesce((F.size("x") > 0) & F.forall("x", finite) & F.exists("x", lambda v: v != 0), F.lit(False))
    raw = raw.withColumn("good", good).withColumn("h", F.when(F.col("good"), F.xxhash64("x"))).withColumn("g", F.when(F.col("good"), F.xxhash64(F.lit(1), F.col("x"))))
    rows = scratch.keep(raw.select("vec_id", "good", "h", "g"))
    distinct = raw.where("good").groupBy("h", "g").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("x").alias("x"))
    distinct = map_arrow(distinct, _packed, "h long, g long, least long, copies long, dim int, v binary")
    distinct = scratch.keep(distinct.withColumn("node", F.monotonically_increasing_id()))
    n = distinct.count()
    dims = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    pivots, first = {}, 0
    for dim, k in sorted(dims.items()):
        some = distinct.where(F.col("dim") == dim).orderBy("g", "h").limit(max(1, min(MAX_PIVOTS, -(-k // PER_PIVOT)))).select("v").collect()
        pivots[dim] = first, _unit(np.array([np.frombuffer(r["v"], np.float64) for r in some]))
        first += len(some)
    shared = spark.sparkContext.broadcast(pivots)

    def count(batches):
        total = np.zeros((first + 1, 2), np.int64)
        for b in batches:
            for dim, (_, m) in _rows(b.column("v"), b.column("dim").to_numpy(zero_copy_only=False)).items():
                lo, p = shared.value[dim]
                home, member = cells_of(m, p, threshold)
                total[lo : lo + len(p), 0] += np.bincount(home, minlength=len(p))
                total[lo : lo + len(p), 1] += member.sum(0)
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at, 0]), pa.array(total[at, 1])], names=["cell", "home", "member"])

    sizes = map_arrow(distinct.select("dim", "v"), count, "cell long, home long, member long").groupBy("cell").agg(F.sum("home").alias("home"), F.sum("member").alias("member")).collect()
    parts = {r["cell"]: (max(1, -(-r["home"] // BLOCK)), max(1, -(-r["member"] // BLOCK)) if r["home"] else 0) for r in sizes}

    def deal(batches):
        for b in batches:
            node, copies = b.column("node").to_numpy(), b.column("copies").to_numpy()
            data = b.column("v")
            for dim, (at, m) in _rows(data, b.column("dim").to_numpy(zero_copy_only=False)).items():
                lo, p = shared.value[dim]
                home, member = cells_of(m, p, threshold)
                for cell in range(len(p)):
                    nh, nm = parts.get(lo + cell, (1, 0))
                    if not nm:
                        continue
                    # home rows go to their block against each block of members, members to theirs against each block of home rows
                    for own, role, mine, others in ((np.flatnonzero(home == cell), 0, nh, nm), (np.flatnonzero(member[:, cell]), 1, nm, nh)):
                        if not len(own):
                            continue
                        block = node[at[own]] % mine
                        for other in range(others):
                            i, j = (block, np.full(len(own), other)) if role == 0 else (np.full(len(own), other), block)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), lo + cell)), pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64)), pa.array(np.full(len(own), role, np.int32)), pa.array(node[at[own]]), pa.array(copies[at[own]]), data.take(pa.array(at[own]))], names=["cell", "i", "j", "role", "node", "copies", "v"])

    def compare(t: pa.Table) -> pa.Table:
        role = t.column("role").to_numpy()
        node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
        home, member = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        if not len(home) or not len(member):
            return empty
        data = t.column("v").to_pylist()
        x, y = (np.frombuffer(b"".join(data[k] for k in at), np.float64).reshape(len(at), -1) for at in (home, member))
        ids, place = np.unique(node, return_inverse=True)
        links = np.zeros(len(home), np.int64)

        def pairs():
            for i, j in linked(x, y, threshold):
                other = node[home[i]] != node[member[j]]
                i, j = i[other], j[other]
                np.add.at(links, i, copies[member[j]])
                ends = np.flatnonzero(np.diff(i, append=-1)) + 1
                for a, e in zip([0, *ends[:-1]], ends):
                    yield place[home[i[a]]], place[member[j[a:e]]]

        label = forest(pairs(), len(ids))
        moved = np.flatnonzero(label != np.arange(len(ids)))
        own = np.flatnonzero(links)
        none = np.zeros(len(moved), np.int64)
        return pa.table({"a": np.concatenate([ids[moved], node[home[own]]]), "b": np.concatenate([ids[label[moved]], node[home[own]]]), "n": np.concatenate([none, links[own]])})

    dealt = map_arrow(distinct.select("node", "copies", "dim", "v"), deal, "cell long, i long, j long, role int, node long, copies long, v binary")
    found = scratch.keep(dealt.groupBy("cell", "i", "j").applyInArrow(compare, "a long, b long, n long")) if n else None
    base = distinct.select("node", "h", "g", "least", "copies")
    if found is None:
        own = base.select("h", "g", F.lit(0).cast("long").alias("links"), F.col("least").alias("component_id"))
    else:
        label = components(found.where("n = 0").select("a", "b"), scratch)
        links = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
        base = base.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        base = scratch.keep(base.join(links, "node", "left").select("h", "g", "least", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links")))
        least = scratch.keep(base.groupBy("component").agg(F.min("least").alias("component_id")))
        own = base.join(least, "component").select("h", "g", "links", "component_id")
    own = scratch.keep(own)
    out = rows.join(own, ["h", "g"], "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def scaled(x: np.ndarray) -> np.ndarray:
    """x times the power of two that brings its largest component to between 1/2 and 1; exact but for what vanishes beside that."""
    return np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))


def _packed(batches):
    for b in batches:
        x = b.column("x").to_pylist()
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("h", "g", "least", "copies")), pa.array([len(v) for v in x], pa.int32()), pa.array([scaled(np.array(v, np.float64)).tobytes() for v in x], pa.binary())], names=["h", "g", "least", "copies", "dim", "v"])


#: The same in DuckDB, from all pairs.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN m BETWEEN 1e-100 AND 1e100 THEN x ELSE list_transform(x, lambda c: c / m) END AS x FROM (SELECT vec_id, embedding, embedding::DOUBLE[] AS x, list_max(list_transform(embedding::DOUBLE[], lambda c: abs(c))) AS m FROM embeddings)
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.95::DOUBLE
), r(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN r ON r.a = e.vec_id GROUP BY e.vec_id
"""
