"""Base scores of (context, candidate): constant, popularity, BM25, dense cosine; exact top-k."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as T


def constant(pools: DataFrame) -> DataFrame:
    return pools.withColumn("base", F.lit(1.0))


def popularity_counts(ctx: DataFrame) -> DataFrame:
    return ctx.groupBy(F.col("refid").alias("candidate")).agg(F.count("*").alias("cited"))


def popularity(pools: DataFrame, counts: DataFrame) -> DataFrame:
    return pools.join(counts, "candidate", "left").withColumn("base", F.log1p(F.coalesce("cited", F.lit(0)))).drop("cited")


def standardised(rows: DataFrame, *keep: str) -> DataFrame:
    """rows of pools (candidates: an array of candidate and is_gold; cited: a map of counts) with n_anchors and c: candidate, is_gold, base (popularity) and z, standardised within the pool, 0 where all are equal."""
    base = F.transform("candidates", lambda x: F.struct(x["candidate"].alias("candidate"), x["is_gold"].alias("is_gold"), F.log1p(F.coalesce(F.element_at("cited", x["candidate"]), F.lit(0))).alias("base")))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    moved = lambda c: T.let(F.transform(c, lambda x: x["base"]), lambda v: T.let(mean(v), lambda m: F.struct(m.alias("m"), F.when(F.array_max(v) > F.array_min(v), F.sqrt(mean(F.transform(v, lambda x: (x - m) * (x - m))))).otherwise(0.0).alias("sd"))))
    z = lambda x, k: F.when(k["sd"] > 0, (x["base"] - k["m"]) / k["sd"]).otherwise(0.0)
    c = T.let(base, lambda c: T.let(moved(c), lambda k: F.transform(c, lambda x: F.struct(x["candidate"].alias("candidate"), x["is_gold"].alias("is_gold"), x["base"].alias("base"), z(x, k).alias("z")))))
    return rows.select("context_id", "citing_id", "gold", "anchors", *keep, F.size("anchors").alias("n_anchors"), c.alias("c"))


class HashingEncoder:
    """An encoder for tests: words hashed into so many dimensions, of length one."""

    def __init__(self, size: int = 16):
        self.size = size

    def __call__(self, texts: list[str]):
        import numpy as np

        out = np.zeros((len(texts), self.size))
        for k, t in enumerate(texts):
            ids = [crc32(w.encode("utf-8", "surrogatepass")) % self.size for w in t.lower().split()]
            out[k] = np.bincount(np.array(ids, np.int64), minlength=self.size)
        return out / np.maximum(1e-12, np.linalg.norm(out, axis=1, keepdims=True))


def embed(texts: DataFrame, encoder, batch: int = 32) -> DataFrame:
    """key, embedding of texts (key, text) by an encoder of a list of texts.

    Texts of an Arrow batch go to the encoder longest first, so that those of a batch are of like length, and come
    back in their own order. A vector that holds what isn't a number is an error; a null text counts as empty."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            t = pdf["text"].fillna("").tolist()
            order = sorted(range(len(t)), key=lambda k: -len(t[k]))
            out: list = [None] * len(t)
            for lo in range(0, len(order), batch):
                own = order[lo : lo + batch]
                for k, v in zip(own, np.asarray(encoder([t[k] for k in own]), np.float64)):
                    if not np.isfinite(v).all():
                        raise ValueError(f"the vector of {pdf['key'].iloc[k]!r} isn't finite")
                    out[k] = v.tolist()
            yield pd.DataFrame({"key": pdf["key"], "embedding": out})

    return texts.select("key", "text").mapInPandas(run, "key string, embedding array<double>")


def base_factory(embeddings: DataFrame | None = None, texts: DataFrame | None = None):
    """A scorer of pools (context_id, candidate) from exactly one of embeddings (key, x), cosines, or texts (key, text), BM25 of the pool's pairs."""
    if (embeddings is None) == (texts is None):
        raise ValueError("exactly one of embeddings and texts")
    return (lambda pools: dense(pools, embeddings)) if embeddings is not None else (lambda pools: bm25_pairs(pools, texts))


def dense(pools: DataFrame, vectors: DataFrame) -> DataFrame:
    """pools with base, the cosine of the context's and the candidate's vector; a missing one is an error."""
    v = vectors.select("key", normalised(F.col("x")).alias("x"))
    d = pools.join(v.toDF("context_id", "_x"), "context_id", "left").join(v.toDF("candidate", "_y"), "candidate", "left")
    there = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    return d.withColumn("base", F.when(there, dot(F.col("_x"), F.col("_y"))).otherwise(F.raise_error(F.lit("a vector is missing")).cast("double"))).drop("_x", "_y")


def bm25_pairs(pools: DataFrame, texts: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """pools with base, BM25 of the context's text for the candidate's, 0 where they share nothing.

    Statistics are of the candidates' texts. Only tokens of a pool's own pairs meet, not all texts with a token."""
    papers = texts.join(pools.select(F.col("candidate").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("id"), "text")
    tf, idf = bm25_stats(papers)
    q = texts.join(pools.select(F.col("context_id").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("context_id"), F.explode(T.tokens_alnum(F.col("text"))).alias("token")).groupBy("context_id", "token").agg(F.count("*").alias("times"))
    part = F.col("times") * F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    found = pools.select("context_id", "candidate").join(tf.withColumnRenamed("id", "candidate"), "candidate").join(q, ["context_id", "token"]).join(idf, "token").groupBy("context_id", "candidate").agg(F.sum(part).alias("base"))
    return pools.join(found, ["context_id", "candidate"], "left").withColumn("base", F.coalesce("base", F.lit(0.0)))


def bm25_stats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, token, f, len) of texts (id, text), and (token, idf, avgdl)."""
    tok = docs.select("id", T.tokens_alnum(F.col("text")).alias("w"))
    size = tok.agg(F.count("*").alias("docs"), F.avg(F.size("w")).alias("avgdl"))
    tf = tok.select("id", F.size("w").alias("len"), F.explode("w").alias("token")).groupBy("id", "len", "token").agg(F.count("*").alias("f"))
    df = tf.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size))
    return tf, df.select("token", F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query, id, score of every pair that shares a token; query tokens count as often as they occur.

    Common tokens meet few queries' rows here as the query side is summed up first."""
    tf, idf = bm25_stats(docs)
    q = queries.select("query", F.explode(T.tokens_alnum(F.col("text"))).alias("token")).groupBy("query", "token").agg(F.count("*").alias("times"))
    part = F.col("times") * F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return q.join(tf, "token").join(idf, "token").groupBy("query", "id").agg(F.sum(part).alias("score"))


def dot(x: F.Column, y: F.Column) -> F.Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)


def numbered_nodes(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """id, x: of each distinct id, a number as text, the vector (vec_id, x) of that number modulo their count."""
    n = F.broadcast(vectors.agg(F.count("*").alias("n")))
    return ids.select("id").distinct().crossJoin(n).select("id", (F.col("id").cast("long") % F.col("n")).alias("vec_id")).join(vectors, "vec_id").select("id", "x")


def paper_vectors(papers: DataFrame, nodes: DataFrame) -> DataFrame:
    """citing_id, vectors (id, x): the nodes (id, x) of each paper's refs, so that vectors are dealt out once for a paper and not for each pair."""
    refs = papers.select("citing_id", F.explode("refs").alias("id"))
    return refs.join(nodes, "id").groupBy("citing_id").agg(F.collect_list(F.struct("id", "x")).alias("vectors"))


def normalised(x: F.Column) -> F.Column:
    n = F.sqrt(dot(x, x))
    return F.transform(x, lambda v: F.when(n > 0, v / n).otherwise(F.raise_error(F.lit("a vector has norm 0")).cast("double")))


def top_k(queries: DataFrame, docs: DataFrame, k: int, most: int = 64 << 20) -> DataFrame:
    """query, id, sim, rank: exact cosine neighbours of vectors (query, x) among (id, y), ties by id.

    Products of matrices tell which rows can be among the best k of a batch; their cosines are then added up in the
    order of the components, so that equal vectors are equal, and at most k of a batch leave a task. Queries are broadcast where
    their vectors take at most `most` bytes; more are taken in parts, each a pass over the documents."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    queries = queries.where("x IS NOT NULL")
    n, dim = queries.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    parts, merged = max(1, -(-(n or 0) * 8 * (dim or 0) // most)), None
    schema = f"query {queries.schema['query'].dataType.simpleString()}, id {docs.schema['id'].dataType.simpleString()}, sim double"
    for part in range(parts):
        got = queries.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).select("query", "x").toArrow().combine_chunks()
        x = np.array(got.column("x").to_pylist(), np.float64).reshape(got.num_rows, dim or 0)
        shared = docs.sparkSession.sparkContext.broadcast((got.column("query").to_pylist(), x))
        names = got.schema.field("query").type

        def best(batches, shared=shared, names=names):
            own, x = shared.value
            own = pa.array(own, names)
            for b in batches:
                y = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, x.shape[1])
                place = np.empty(b.num_rows, np.int64)
                place[pc.array_sort_indices(b.column(0), null_placement="at_start").to_numpy()] = np.arange(b.num_rows)
                for lo in range(0, len(x), 256):
                    sim = x[lo : lo + 256] @ y.T
                    # sums in another order differ by far less than 1e-9
                    least = -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k] - 1e-9 if sim.shape[1] > k else -np.inf
                    i, j = np.nonzero(sim >= least)
                    if len(i):
                        exact = np.concatenate([np.add.accumulate(x[i[a : a + 8192] + lo] * y[j[a : a + 8192]], axis=1)[:, -1] for a in range(0, len(i), 8192)])
                        order = np.lexsort((place[j], -exact, i))
                        i, j, exact = i[order], j[order], exact[order]
                        own_k = np.arange(len(i)) - np.searchsorted(i, i) < k  # of equal ones the first by id
                        i, j, exact = i[own_k], j[own_k], exact[own_k]
                        yield pa.RecordBatch.from_arrays([own.take(pa.array(i + lo)), b.column(0).take(pa.array(j)), pa.array(exact)], names=["query", "id", "sim"])

        found = docs.where("y IS NOT NULL").select("id", "y").mapInArrow(best, schema)
        merged = found if merged is None else merged.unionByName(found)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("sim"), "id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k_blocks(queries: DataFrame, docs: DataFrame, k: int, most: int = 64 << 20) -> DataFrame:
    """query, id, sim, rank: the same for many queries: each task keeps the best k of its documents by matrix products, then these are merged.

    Similarities are compared at 9 decimals, ties by id as text. Queries are broadcast where their vectors take at
    most `most` bytes; more are taken in parts, each a pass over the documents."""
    import numpy as np
    import pandas as pd

    n, dim = queries.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    parts, merged = max(1, -(-(n or 0) * 8 * (dim or 0) // most)), None
    for part in range(parts):
        rows = queries.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).collect()
        shared = docs.sparkSession.sparkContext.broadcast(([r["query"] for r in rows], np.array([r["x"] for r in rows], np.float64).reshape(len(rows), dim or 0)))

        def best(batches, shared=shared):
            names, x = shared.value
            held: list[pd.DataFrame] = []

            def cut(frames: list[pd.DataFrame]) -> pd.DataFrame:
                d = pd.concat(frames, ignore_index=True).sort_values(["q", "sim", "id"], ascending=[True, False, True], kind="stable")
                return d[d.groupby("q").cumcount() < k]

            for pdf in batches:
                if not len(names) or not len(pdf):
                    continue
                y, ids = np.stack(pdf["y"].to_numpy()), pdf["id"].astype(str).to_numpy()
                for lo in range(0, len(names), 256):
                    sim = np.round(x[lo : lo + 256] @ y.T, 9)
                    if sim.shape[1] > k:  # what is below the k-th best is in no result; equals stay for the ties
                        keep = sim >= -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k]
                    else:
                        keep = np.ones(sim.shape, bool)
                    i, j = np.nonzero(keep)
                    held.append(pd.DataFrame({"q": i + lo, "id": ids[j], "sim": sim[i, j]}))
                held = [cut(held)]
            for d in held:
                yield pd.DataFrame({"query": [names[q] for q in d["q"]], "id": d["id"].to_numpy(), "sim": d["sim"].to_numpy()})

        found = docs.mapInPandas(best, f"query {queries.schema['query'].dataType.simpleString()}, id string, sim double")
        merged = found if merged is None else merged.unionByName(found)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("sim"), "id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k)
