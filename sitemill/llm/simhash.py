"""SimHash near-duplicates by anchor-point covering.

Anchors are the 4,096 words of the perfect binary Golay code of length 23, covering radius 3, laid over 23
bits of a fingerprint (two such codes over 46 bits for large inputs). Let r(x) be the distance of x to its
nearest anchor. If x and y differ in at most 2 bits, some z differs from either in at most 1; its nearest
anchor is within r(z) + 1 <= r(x) + 2 of x, and likewise of y. So a fingerprint goes to every anchor within
its own covering distance plus the threshold, and each pair meets at an anchor: no link is lost.

Texts of a given Jaccard similarity differ in a given share of the bits, which for 0.8 is over a seventh, so
the same code serves for them over several windows of a fingerprint of 256 bits: in each a fingerprint goes to
every anchor within its covering distance plus 1, and an anchor compares whole fingerprints. Windows are as many
as the wanted recall takes. What is close at an anchor gives its minimum spanning forest, whose pairs are then
verified by their shingles.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Cached, Scratch, components, forest, map_arrow, texts_of, words_of

SHINGLE, SEED, THRESHOLD = 3, 42, 2
#: Members of an anchor that are compared in one task; larger anchors are dealt out in pairs of blocks.
BLOCK = 4096
#: From so many distinct fingerprints on, two windows (16.8 million anchors) keep anchors small.
TWO_WINDOWS = 1 << 21
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """64 bits; bit k is set where over half of the shingles' XXH64 have it. No word: 0."""
    words = words_of(text or "")
    n = len(words)
    if not n:
        return 0
    if n < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, counts, total = xxhash.xxh64_digest, np.zeros((8, 8), np.int64), n - SHINGLE + 1
    for at in range(0, total, _CHUNK):
        part = words[at : at + _CHUNK + SHINGLE - 1]
        line = b" ".join(part)
        lens = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lens + 1) - 1
        starts = (ends - lens)[: 1 - SHINGLE].tolist()
        h = np.frombuffer(b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())]), np.uint8).reshape(-1, 8)
        for c in range(8):
            counts[c] += np.bincount(h[:, c], minlength=256) @ _BITS
    return int.from_bytes(np.packbits((2 * counts > total).ravel()).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([_signed(fingerprint(t)) for t in b.column("text").to_pylist()], pa.int64())], names=["doc_id", "fp"])

    return map_arrow(texts_of(docs), run, "doc_id long, fp long")


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: error patterns that lead to anchors within r + 2, their excess over r (9: none), and the syndromes of 12-bit halves."""

    def rest(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        return x

    single = [rest(1 << k) for k in range(23)]
    found: list[list[tuple[int, int]]] = [[] for _ in range(2048)]
    for weight in range(6):
        for bits in combinations(range(23), weight):
            s = e = 0
            for k in bits:
                s ^= single[k]
                e |= 1 << k
            found[s].append((weight, e))
    pattern, excess = np.zeros((2048, 22), np.int64), np.full((2048, 22), 9, np.int8)
    for s, all_ in enumerate(found):
        near = all_[0][0]
        for k, (weight, e) in enumerate((w, e) for w, e in all_ if w <= near + THRESHOLD):
            pattern[s, k], excess[s, k] = e, weight - near
    halves = np.array([[rest(x) for x in range(4096)], [rest(x << 12) if x < 2048 else 0 for x in range(4096)]])
    return pattern, excess, halves


def anchors_of(fps: np.ndarray, windows: int, code=None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes into fps and, for each, one anchor."""
    pattern, excess, halves = code or _golay()
    x = fps.astype(np.uint64)
    parts = []
    for w in range(windows):
        v = ((x >> np.uint64(23 * w)) & np.uint64((1 << 23) - 1)).astype(np.int64)
        s = halves[0][v & 4095] ^ halves[1][v >> 12]
        parts.append((v[:, None] ^ pattern[s], excess[s]))
    if windows == 1:
        at, k = np.nonzero(parts[0][1] <= THRESHOLD)
        return at, parts[0][0][at, k]
    at, k, m = np.nonzero(parts[0][1][:, :, None] + parts[1][1][:, None, :] <= THRESHOLD)
    return at, parts[0][0][at, k] << 23 | parts[1][0][at, m]


def near_pairs(fps: np.ndarray):
    """(row, rows within the threshold) in slices of bounded memory."""
    step = max(1, (1 << 22) // max(1, len(fps)))
    for at in range(0, len(fps), step):
        close = np.bitwise_count(fps[at : at + step, None] ^ fps[None]) <= THRESHOLD
        several = np.flatnonzero(close.sum(1) > 1)
        for i in several:
            yield at + i, np.flatnonzero(close[i])


def links(distinct: DataFrame, windows: int) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that join whatever is within the threshold; each anchor gives a spanning forest of its pairs."""

    def replicate(batches):
        code = _golay()
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False)
            for k in range(0, len(fps), 8192):
                at, anchor = anchors_of(fps[k : k + 8192], windows, code)
                for lo in range(0, len(at), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[lo : lo + (1 << 17)]), pa.array(fps[k : k + 8192][at[lo : lo + (1 << 17)]])], names=["anchor", "fp"])

    def compare(t: pa.Table) -> pa.Table:
        fps = np.unique(t.column("fp").to_numpy())
        label = forest(near_pairs(fps.view(np.uint64)), len(fps))
        moved = np.flatnonzero(label != np.arange(len(fps)))
        return pa.table({"a": fps[label[moved]], "b": fps[moved]})

    members = map_arrow(distinct.select("fp"), replicate, "anchor long, fp long")
    large = members.groupBy("anchor").count().where(F.col("count") > BLOCK).select("anchor", F.ceil(F.col("count") / BLOCK).cast("int").alias("n"))
    dealt = members.join(large, "anchor", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("anchor", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return dealt.groupBy("anchor", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (smallest doc_id whose fingerprint is reachable by links of at most 2 bits).

    Null, empty and blank texts have fingerprint zero and are linked like any other. Repeated rows give a
    row each; rows with a null doc_id count for no component's smallest id (null where there is no other).
    No row in, no row out. Columns besides doc_id and text are ignored. Equal fingerprints are one node, so
    copies cost nothing; only minima are gathered for a node."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    prints = scratch.keep(fingerprints(docs))
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    windows = 1 if distinct.count() < TWO_WINDOWS else 2
    label = components(links(distinct, windows), scratch)
    own = scratch.keep(distinct.join(label, distinct["fp"] == label["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    least = scratch.keep(own.groupBy("component").agg(F.min("least").alias("component_id")))
    ids = scratch.keep(own.select("fp", "component").join(least, "component").select("fp", "component_id"))
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Longs of a fingerprint for similarity, the bits that an anchor's window has, members of an anchor aimed at.
LONGS, WINDOW, MEMBERS = 4, 23, 512
#: What a pair may differ in besides the bits expected of the similarity, in standard deviations.
MARGIN = 3.0
#: Up to so many nodes are broadcast to pick their texts; more are joined.
PICKED = 1 << 18
_EPS = 1e-9


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, shingle: int, known: Cached) -> np.ndarray:
    """Different hashes of the runs of so many words; a shorter text is one run, an empty one none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    size = min(shingle, len(words))
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    return np.unique(out)


def long_print(s: np.ndarray) -> np.ndarray:
    """LONGS numbers of 64 bits of a set of shingles; a bit is set where over half of the shingles' hashes have it."""
    h = np.concatenate([_mixed(s + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)).astype(">u8").view(np.uint8).reshape(-1, 8) for k in range(LONGS)], 1)
    at = h + (np.arange(8 * LONGS) << 8)
    counts = np.bincount(at.ravel(), minlength=256 * 8 * LONGS).reshape(-1, 256) @ _BITS
    return np.packbits((2 * counts > len(s)).ravel()).view(">u8").astype(np.uint64)


def differing(similarity: float) -> float:
    """Share of the bits in which fingerprints of texts of that Jaccard similarity differ, if they are of one length; if not, they differ in fewer."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _near(v: np.ndarray, excess: int, code) -> tuple[np.ndarray, np.ndarray]:
    """Indexes into v and, for each, one anchor within the covering distance plus excess."""
    pattern, over, halves = code
    s = halves[0][v & 4095] ^ halves[1][v >> 12]
    at, k = np.nonzero(over[s] <= excess)
    return at, v[at] ^ pattern[s[at], k]


@lru_cache(maxsize=16)
def windows_for(n: int, similarity: float, recall: float) -> tuple[np.ndarray, int]:
    """Bits of each window, of which the first 23 are covered by anchors and the others must agree, and the bits that close fingerprints may differ in.

    The others are added with the number of fingerprints n so that anchors keep their size, and windows until, of
    pairs of fingerprints of that similarity that are drawn with a fixed seed, the share recall meets in one."""
    share, bits = differing(similarity), 64 * LONGS
    exact = max(0, math.ceil(math.log2(max(1.0, n * 5.3 / (4096 * MEMBERS)))))
    rng, code = np.random.default_rng(7), _golay()
    x = rng.integers(0, 2, (1 << 13, bits), np.uint8)
    y = x ^ (rng.random(x.shape) < share)
    met, rows, left = np.zeros(len(x), bool), [], []
    while met.mean() < recall:
        # disjoint windows as long as there are bits left
        if len(left) < WINDOW + exact:
            left = rng.permutation(bits).tolist()
        row, left = left[: WINDOW + exact], left[WINDOW:]
        where = [np.unique(at << WINDOW | anchor) for at, anchor in (_near(z[:, row[:WINDOW]].astype(np.int64) @ (1 << np.arange(WINDOW)), 1, code) for z in (x, y))]
        hit = np.zeros(len(x), bool)
        hit[np.intersect1d(*where) >> WINDOW] = True
        met |= hit & (x[:, row[WINDOW:]] == y[:, row[WINDOW:]]).all(1)
        rows.append(row)
    return np.array(rows), math.floor(bits * share + MARGIN * math.sqrt(bits * share * (1 - share)))


def spanning(ids: np.ndarray, prints: np.ndarray, most: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of ids and their differing bits: a minimum spanning forest of the rows of prints that differ in at most so many bits.

    Rows without a close one are left out first, by 64 bits: what differs in that share of all bits has more than
    4.5 standard deviations above it there once in 300,000 times."""
    n = len(ids)
    some = np.zeros(n, bool)
    first = 64 * share + 4.5 * math.sqrt(64 * share * (1 - share))
    step = max(1, (1 << 21) // max(1, n))
    for at in range(0, n, step):
        i, j = np.nonzero(np.bitwise_count(prints[at : at + step, None, 0] ^ prints[None, :, 0]) <= first)
        i, j = i[i + at < j] + at, j[i + at < j]
        for lo in range(0, len(i), 1 << 19):
            a, b = i[lo : lo + (1 << 19)], j[lo : lo + (1 << 19)]
            close = np.bitwise_count(prints[a] ^ prints[b]).sum(1) <= most
            some[a[close]] = some[b[close]] = True
    own = np.flatnonzero(some)
    x, m = prints[own], len(own)
    far = 64 * LONGS + 1
    key, parent, out = np.full(m, far), np.full(m, -1), np.ones(m, bool)
    pairs = []
    for _ in range(m):
        u = int(np.argmin(np.where(out, key, far + 1)))
        out[u] = False
        if parent[u] >= 0:
            pairs.append((parent[u], u, key[u]))
        d = np.bitwise_count(x[u] ^ x).sum(1)
        better = out & (d <= most) & (d < key)
        key[better], parent[better] = d[better], u
    a, b, d = (np.array(c, np.int64) for c in zip(*pairs)) if pairs else (np.empty(0, np.int64),) * 3
    return ids[own[a]], ids[own[b]], d


def _close(nodes: DataFrame, n: int, similarity: float, recall: float) -> DataFrame:
    """a, b, d: pairs a < b of nodes (node, f0 to f3) that an anchor's spanning forest has, with the bits that they differ in."""
    (windows, most), share = windows_for(n, similarity, recall), differing(similarity)
    names = [f"f{k}" for k in range(LONGS)]

    def replicate(batches):
        code, powers = _golay(), 1 << np.arange(WINDOW)
        above = 1 << np.arange(windows.shape[1] - WINDOW)
        for b in batches:
            node, prints = b.column("node"), np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names], 1).view(np.uint64)
            bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1)
            for w, row in enumerate(windows):
                at, anchor = _near(bits[:, row[:WINDOW]].astype(np.int64) @ powers, 1, code)
                rest = (bits[:, row[WINDOW:]].astype(np.int64) @ above)[at] if len(above) else np.zeros(len(at), np.int64)
                key = ((rest << WINDOW) | anchor) * len(windows) + w
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(key), node.take(take), *(b.column(c).take(take) for c in names)], names=["anchor", "node", *names])

    def compare(t: pa.Table) -> pa.Table:
        prints = np.stack([t.column(c).to_numpy() for c in names], 1).view(np.uint64)
        node, at = np.unique(t.column("node").to_numpy(), return_index=True)
        a, b, d = spanning(node, prints[at], most, share)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "d": d})

    members = map_arrow(nodes, replicate, "anchor long, node long, " + ", ".join(f"{c} long" for c in names))
    large = members.groupBy("anchor").count().where(F.col("count") > BLOCK).select("anchor", F.ceil(F.col("count") / BLOCK).cast("int").alias("n"))
    dealt = members.join(large, "anchor", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("anchor", "node", *names, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return dealt.groupBy("anchor", "i", "j").applyInArrow(compare, "a long, b long, d long").groupBy("a", "b").agg(F.min("d").alias("d"))


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float, scratch: Scratch) -> DataFrame:
    """a, b: those pairs of nodes of texts (node, text) whose shingles have that Jaccard similarity."""

    def run(batches):
        known = Cached(xxhash.xxh64_intdigest)
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                part = b.slice(lo, 100)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([shingles(t, shingle, known).view(np.int64) for t in part.column("text").to_pylist()], pa.list_(pa.int64()))], names=["node", "s"])
            known.trim()

    wanted = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    picked = texts.join(F.broadcast(wanted) if wanted.count() <= PICKED else wanted, "node").groupBy("node").agg(F.first("text").alias("text"))
    sets = scratch.keep(map_arrow(picked, run, "node long, s array<long>"))
    x, y = sets.select(F.col("node").alias("a"), F.col("s").alias("x")), sets.select(F.col("node").alias("b"), F.col("s").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("k"), (F.size("x") + F.size("y")).alias("n"))
    return both.where(F.col("k") * (1 + similarity) >= similarity * F.col("n") - _EPS).select("a", "b")


def _node(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(b" ".join(words_of(text))))


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.998) -> DataFrame:
    """doc_id, component_id (smallest doc_id that links lead to): documents link whose sets of word shingles have that Jaccard similarity.

    Texts of the same words in lower case are one node, null, empty and blank ones among them; a text shorter
    than a shingle is similar to none but these. Of other pairs, one of exactly that similarity is found with
    probability recall, the more similar ones with more; none below it is linked. Repeated rows give a row
    each; null ids count for no component's smallest id (null where there is no other). An empty table gives
    no rows. Columns besides doc_id and text are ignored, very long texts are taken whole.

    At an anchor a large group of copies gives a spanning forest, never all its pairs. Of all forests' pairs
    the closest of each node is verified first, then those whose ends are still apart."""
    if not 0 < similarity <= 1 or shingle < 1 or not 0 < recall < 1:
        raise ValueError("similarity must be above 0 and at most 1, recall between 0 and 1, shingle at least 1")
    scratch = Scratch(docs.sparkSession, "similar")
    names = [f"f{k}" for k in range(LONGS)]

    def read(batches):
        known = Cached(xxhash.xxh64_intdigest)
        for b in batches:
            texts = b.column("text").to_pylist()
            prints = np.zeros((len(texts), LONGS), np.uint64)
            for k, t in enumerate(texts):
                s = shingles(t, shingle, known)
                if len(s):
                    prints[k] = long_print(s)
            known.trim()
            # blank texts aren't similar to any but blank ones, which are the same node
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([_node(t) for t in texts], pa.int64()), pa.array([bool(t) and not t.isspace() for t in texts]), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in prints.T)], names=["doc_id", "node", "some", *names])

    rows = scratch.keep(map_arrow(texts_of(docs), read, "doc_id long, node long, some boolean, " + ", ".join(f"{c} long" for c in names)))
    nodes = scratch.keep(rows.where("some").groupBy("node").agg(*(F.first(c).alias(c) for c in names)))
    pairs = scratch.keep(_close(nodes, nodes.count(), similarity, recall))
    named = _named(docs)
    ends = pairs.select(F.col("a").alias("node"), F.struct("d", F.col("b").alias("to")).alias("x")).union(pairs.select("b", F.struct("d", F.col("a").alias("to"))))
    best = ends.groupBy("node").agg(F.min("x").alias("x")).select(F.least("node", "x.to").alias("a"), F.greatest("node", "x.to").alias("b")).distinct()
    best = scratch.keep(best)
    links = scratch.keep(_verified(best, named, shingle, similarity, scratch))
    label = components(links, scratch)
    la, lb = label.toDF("a", "la"), label.toDF("b", "lb")
    rest = pairs.join(best, ["a", "b"], "left_anti").join(la, "a", "left").join(lb, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    links = scratch.keep(links.union(_verified(scratch.keep(rest), named, shingle, similarity, scratch)))
    label = components(links, scratch).toDF("own", "component")
    least = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    own = scratch.keep(least.join(label, least["node"] == label["own"], "left").select("node", "least", F.coalesce("component", "node").alias("component")))
    least = scratch.keep(own.groupBy("component").agg(F.min("least").alias("component_id")))
    ids = scratch.keep(own.join(least, "component").select("node", "component_id"))
    return rows.select("doc_id", "node").join(ids, "node").select("doc_id", "component_id")


def _named(docs: DataFrame) -> DataFrame:
    """node, text of every document."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_node(t) for t in b.column("text").to_pylist()], pa.int64()), b.column("text")], names=["node", "text"])

    return map_arrow(texts_of(docs).select("text"), run, "node long, text string")


#: Documents without which a stage goes on, at most, that are broadcast; more are joined.
GONE = 1 << 18


def deduplicate(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.998) -> DataFrame:
    """docs without the documents whose id isn't the smallest of their component of similar texts; repeated rows of that id are one document and stay.

    Rows with a null doc_id stay if their component has no document with an id. Null, empty and blank texts are
    one component. An empty table gives none; all columns are kept, whatever their names."""
    scratch = Scratch(docs.sparkSession, "deduplicated")
    found = scratch.keep(similar(docs, shingle, similarity, recall))
    # an id of which some row is the smallest of its component stays
    gone = found.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")).where("NOT stays").select(F.col("doc_id").alias("gone_id"))
    gone = scratch.keep(gone)
    few = gone.count() <= GONE
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]), "left_anti")
