"""Benchmark decontamination by spaced-seed hashing.

Tokens are whitespace-separated words, lower-cased, without what isn't a letter or digit at either end; words
of which nothing is left are skipped. Each mask looks at 4 tokens of a window and ignores those between. The
hashes of all masks at all positions of the benchmark items are joined with those of the documents. Where two
hits or more lay an item over a document at the same offset, they are verified: the longest stretch in which
at least 0.8 of the tokens agree counts as overlap if it has 13 tokens, or all tokens of a shorter item. The
masks hit every such stretch of 8 tokens or more twice, whichever 0.2 of its tokens are replaced. Items of
fewer tokens than that are looked for whole and unaltered.

Documents send only the hashes that a bitmap of the benchmark's, of bounded size, lets pass. Both sides of the
joins may be of any size: no part of the benchmark is held by the driver or by all workers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Cached, Scratch, map_arrow, texts_of

#: Offsets of the tokens that a mask looks at.
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4))
SPAN, SIMILARITY, LEAST = 13, 0.8, 8
#: Hits that a verified stretch of an item of LEAST tokens or more must have.
HITS = 2
#: Bits of the bitmap: 64 for each hash of the benchmark, but at most so many (8 MB), which bounds what is broadcast.
MOST_BITS = 1 << 26
#: Candidates that are broadcast to their documents at most; more are joined.
TOLD = 1 << 18


def token(word: str) -> str:
    """The word in lower case without anything but letters and digits at its ends."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b].lower()


def tokens(text: str | None) -> list[str]:
    return [t for t in map(token, (text or "").split()) if t]


def _token_hash(word: str) -> int:
    """64 bits of the word's token, 0 of a word that has none."""
    t = token(word)
    return xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 1) | 1 if t else 0


def hashed(text: str | None, known: Cached) -> np.ndarray:
    words = (text or "").split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return h[h > 0]


def hashes(ids: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Of each window, from the tokens that mask looks at and from mask itself."""
    n = len(ids) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, sum(1 << k for k in mask), np.uint64)
    for k in mask:
        h = (h ^ (h >> np.uint64(29)) ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def masks_of(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks that look for an item of so many tokens: of a short one, all its tokens."""
    return MASKS if n >= LEAST else (tuple(range(n)),) if n else ()


def overlap(same: np.ndarray, span: int = SPAN, similarity: float = SIMILARITY) -> tuple[int, int] | None:
    """The longest stretch of at least span positions (or all, if fewer) that agree in at least that share; the first of equals."""
    n, unit = len(same), round(similarity * 1000)
    total = np.concatenate([[0], np.cumsum(np.where(same, 1000, 0) - unit)])
    high = np.maximum.accumulate(total[::-1])[::-1]
    best, i, j = (0, 0), 0, 0
    low = np.minimum.accumulate(total)
    while i <= n and j <= n:
        if high[j] >= low[i]:
            if j - i > best[1] - best[0]:
                best = (i, j)
            j += 1
        else:
            i += 1
    a, b = best
    return (a, b) if b - a >= min(span, n) and b > a else None


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, tokens (their hashes) of the different benchmark items that have tokens."""

    def run(batches):
        known = Cached(_token_hash)
        for b in batches:
            t = [hashed(x, known) for x in b.column("text").to_pylist()]
            some = pa.array([len(x) > 0 for x in t])
            out = pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([x.view(np.int64) for x in t], pa.list_(pa.int64()))], names=["item_id", "tokens"])
            yield out.filter(some)
            known.trim()

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL AND item_id IS NOT NULL")
    return map_arrow(rows.distinct(), run, "item_id long, tokens array<long>").withColumn("k", F.monotonically_increasing_id())


def _windows(items: DataFrame) -> DataFrame:
    """h, k, q: hashes of the windows of items, with the item's number and their position."""

    def run(batches):
        for b in batches:
            for k, t in zip(b.column("k").to_pylist(), b.column("tokens")):
                ids = t.values.to_numpy(zero_copy_only=False).view(np.uint64)
                for mask in masks_of(len(ids)):
                    h = hashes(ids, mask).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), k)), pa.array(np.arange(len(h), dtype=np.int64))], names=["h", "k", "q"])

    return map_arrow(items.select("k", "tokens"), run, "h long, k long, q long")


def _bitmap(windows: DataFrame, n: int) -> np.ndarray:
    """Bits of the highest bits of the hashes that occur."""
    bits = min(MOST_BITS, 1 << max(10, (64 * n).bit_length()))
    slot = F.shiftrightunsigned("h", 64 - (bits.bit_length() - 1))
    words = windows.select(F.shiftright(slot, 6).alias("w"), (slot % 64).cast("int").alias("c")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, c)")).alias("b"))
    rows = words.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return out


def _seeds(docs: DataFrame, bitmap: np.ndarray, short: list[int]) -> DataFrame:
    """key, h, p: windows of documents (key, text) whose hash the bitmap has."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    masks = (*MASKS, *(m for n in short for m in masks_of(n)))
    down = np.uint64(64 - (64 * len(bitmap)).bit_length() + 1)

    def run(batches):
        bitmap, known = shared.value, Cached(_token_hash)
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                ids = hashed(text, known)
                for mask in masks:
                    h = hashes(ids, mask)
                    slot = h >> down
                    at = np.flatnonzero((bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1))
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key)), pa.array(h[at].view(np.int64)), pa.array(at)], names=["key", "h", "p"])
            known.trim()

    return map_arrow(docs, _gathered(run), "key long, h long, p long")


def _gathered(run):
    """run with its small batches put together."""

    def all_(batches):
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 1 << 15:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return all_


def _slices(docs: DataFrame) -> DataFrame:
    """key, doc_id, k, at, part: tokens of documents (key, doc_id, text, asked) where items are laid over them, from the item's first token or the document's."""

    def run(batches):
        known = Cached(_token_hash)
        for b in batches:
            for key, doc_id, text, asked in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "text", "asked"))):
                ids = hashed(text, known).view(np.int64)
                for lo in range(0, len(asked), 1000):
                    some = asked[lo : lo + 1000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(some), pa.int64()), pa.array([doc_id] * len(some), pa.int64()), pa.array([x["k"] for x in some], pa.int64()), pa.array([x["at"] for x in some], pa.int64()), pa.array([ids[max(0, x["at"]) : x["at"] + x["n"]] for x in some], pa.list_(pa.int64()))],
                        names=["key", "doc_id", "k", "at", "part"],
                    )
            known.trim()

    return map_arrow(docs, _gathered(run), "key long, doc_id long, k long, at long, part array<long>")


def _verified(laid: DataFrame) -> DataFrame:
    """key, doc_id, k, item_id, first, n, same, tokens of laid (key, doc_id, k, item_id, at, part, tokens) that overlap."""

    def run(batches):
        for b in batches:
            rows = []
            for key, doc_id, k, item_id, at, part, own in zip(*(b.column(c) for c in ("key", "doc_id", "k", "item_id", "at", "part", "tokens"))):
                own, part, at = own.values.to_numpy(), part.values.to_numpy(), at.as_py()
                same = np.zeros(len(own), bool)
                lo = max(0, -at)
                same[lo : lo + len(part)] = own[lo : lo + len(part)] == part
                x = overlap(same) if len(own) >= LEAST else (0, len(own)) if same.all() else None
                if x is not None:
                    rows.append((key.as_py(), doc_id.as_py(), k.as_py(), item_id.as_py(), at + x[0], x[1] - x[0], int(same[x[0] : x[1]].sum()), len(own)))
            cols = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "doc_id", "k", "item_id", "first", "n", "same", "tokens"])

    return map_arrow(laid, run, "key long, doc_id long, k long, item_id long, first long, n long, same long, tokens long")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end (document tokens, end exclusive), n_same, share (of the item's tokens that agree): the best overlap of each document and item.

    The best has the most tokens that agree, then is the longest, then the first. Null and empty texts and
    items match nothing, nor do items with a null id; items of fewer than 8 tokens match whole only; equal items
    are one. An empty table gives no rows. Repeated document rows give a row each per item, null ids too. Columns
    besides doc_id, text and item_id are ignored. All tokens of every text are compared."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    base = texts_of(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    items = scratch.keep(_items(benchmark))
    windows = scratch.keep(_windows(items))
    short = sorted(r["n"] for r in items.select(F.size("tokens").alias("n")).where(F.col("n") < LEAST).distinct().collect())
    seeds = _seeds(base.select("key", "text"), _bitmap(windows, windows.count()), short)
    found = seeds.join(windows, "h").groupBy("key", "k", (F.col("p") - F.col("q")).alias("at")).agg(F.count("*").alias("hits"))
    sizes = items.select("k", F.size("tokens").alias("n"))
    found = found.join(sizes, "k").where((F.col("hits") >= HITS) | (F.col("n") < LEAST))
    asked = scratch.keep(found.groupBy("key").agg(F.collect_list(F.struct("k", "at", "n")).alias("asked")))
    few = (asked.agg(F.sum(F.size("asked") + 1).alias("n")).first()["n"] or 0) <= TOLD
    own = base.join(F.broadcast(asked) if few else asked, "key")
    laid = scratch.keep(_slices(own)).join(items, "k")
    best = _verified(laid).groupBy("key", "doc_id", "k", "first", "n").agg(F.count("*").alias("copies"), F.first("item_id").alias("item_id"), F.first("same").alias("same"), F.first("tokens").alias("tokens"))
    best = best.groupBy("key", "doc_id", "k").agg(F.max(F.struct("same", "n", (-F.col("first")).alias("back"), "copies", "item_id", "tokens")).alias("x"))
    return best.select("doc_id", F.col("x.item_id").alias("item_id"), (-F.col("x.back")).alias("start"), (F.col("x.n") - F.col("x.back")).alias("end"), F.col("x.same").alias("n_same"), (F.col("x.same") / F.col("x.tokens")).alias("share"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("x.copies"))).alias("_copy")).drop("_copy")


#: Documents without which a stage goes on, at most, that are broadcast; more are joined.
GONE = 1 << 18


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """docs without the documents that overlap with a benchmark item in at least so many tokens.

    Items of fewer tokens are no evidence by themselves (one of a single common word is in most texts), so with
    the default they make no document go. Rows with a null id are tested, and go or stay, together; null and
    empty texts stay; an empty table gives none. All columns are kept, whatever their names."""
    scratch = Scratch(docs.sparkSession, "decontaminated")
    hit = scratch.keep(contamination(docs, benchmark).where(F.col("end") - F.col("start") >= least).select(F.col("doc_id").alias("hit_id")).distinct())
    few = hit.count() <= GONE
    return docs.join(F.broadcast(hit) if few else hit, docs["doc_id"].cast("long").eqNullSafe(hit["hit_id"]), "left_anti")


#: The same in DuckDB: every offset at which some window of an item, or a whole short item, agrees.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '\S+'), lambda w: lower(regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))), lambda w: w <> '') AS t FROM documents
), b AS (
  SELECT row_number() OVER () AS k, item_id, t FROM (SELECT DISTINCT item_id, text, list_filter(list_transform(regexp_extract_all(text, '\S+'), lambda w: lower(regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))), lambda w: w <> '') AS t FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(t) > 0
), mask AS (
  SELECT * FROM (VALUES (1, [0, 1, 2, 3]), (2, [0, 1, 2, 4]), (3, [0, 1, 3, 4])) v(m, o)
), bw AS (
  SELECT k, m, q, array_to_string(list_transform(o, lambda x: t[q + x + 1]), ' ') AS h FROM (SELECT k, t, m, o, unnest(range(0, greatest(len(t) - o[4], 0))) AS q FROM b, mask WHERE len(t) >= 8)
  UNION ALL SELECT k, 10 + len(t), 0, array_to_string(t, ' ') FROM b WHERE len(t) < 8
), dw AS (
  SELECT r, m, p, array_to_string(list_transform(o, lambda x: t[p + x + 1]), ' ') AS h FROM (SELECT r, t, m, o, unnest(range(0, greatest(len(t) - o[4], 0))) AS p FROM d, mask)
  UNION ALL SELECT r, 10 + n, p, array_to_string(t[p + 1:p + n], ' ') FROM (SELECT r, t, n, unnest(range(0, greatest(len(t) - n + 1, 0))) AS p FROM d, (SELECT DISTINCT len(t) AS n FROM b WHERE len(t) < 8))
), c AS (
  SELECT DISTINCT r, k, p - q AS o FROM dw JOIN bw USING (m, h)
), laid AS (
  SELECT r, k, o, n, list_prepend(0, list_transform(range(1, n + 1), lambda i: list_sum(same[1:i]))) AS total FROM (
    SELECT r, k, o, len(b.t) AS n, list_transform(range(1, len(b.t) + 1), lambda i: CASE WHEN o + i >= 1 AND d.t[o + i] = b.t[i] THEN 1 ELSE 0 END) AS same FROM c JOIN d USING (r) JOIN b USING (k))
), stretch AS (
  SELECT r, k, o + x AS first, y - x AS size, total[y + 1] - total[x + 1] AS same, n
  FROM (SELECT *, unnest(range(x + least(13, n), n + 1)) AS y FROM (SELECT *, unnest(range(0, n)) AS x FROM laid))
  WHERE (total[y + 1] - total[x + 1]) * 10 >= CASE WHEN n < 8 THEN 10 ELSE 8 END * (y - x)
  QUALIFY row_number() OVER (PARTITION BY r, k, o ORDER BY y - x DESC, x) = 1
)
SELECT doc_id, item_id, first AS start, first + size AS "end", same::BIGINT AS n_same, same::DOUBLE / n AS share FROM (
  SELECT * FROM stretch QUALIFY row_number() OVER (PARTITION BY r, k ORDER BY same DESC, size DESC, first) = 1) JOIN d USING (r) JOIN b USING (k)
"""
