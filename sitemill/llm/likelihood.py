"""Language-model scores by subword lattices.

Words are scored with the pieces of an existing vocabulary: a word's probability is the sum, over all its
segmentations, of the product of its pieces' probabilities (forward recursion in log space), a text's the
product over its words and an end. The vocabulary's own scores weight the segmentations. Beside that, two
expectation steps over the training words, each counted once, turn them into piece probabilities of words that
are new to a corpus. The learned score is of a lattice to which every training word is added as one piece, that
spans it whole: such a piece has the word's count less a discount, and what the discounts leave goes to the ways
of spelling a word by smaller pieces.

Counts of words are a distributed table. Words that hold at least 1 / HEAD of all training tokens, at most
HEAD many, are broadcast and looked up where texts are read; the others, none of them hot by definition, are
joined by word.
"""

from __future__ import annotations

from collections import Counter
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, crc_rest, map_arrow, texts_of, together, words_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HEAD, FLUSH = 500_000, 200_000
_MUL, _MIX, _BITS = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), 21
_WORD_START = "▁"


class Lattice:
    """Log probabilities of pieces; scores many words of one length at a time."""

    def __init__(self, pieces: list[str], logp: np.ndarray, bytes_at: dict[int, int], end: float = 0.0):
        self.pieces, self.logp, self.bytes_at, self.end = pieces, logp, bytes_at, end
        self.longest = max(map(len, pieces), default=1)
        self.sizes, self.codes = np.array([len(p) for p in pieces], np.int64), np.zeros((self.longest, len(pieces)), np.uint64)
        for k, p in enumerate(pieces):
            self.codes[: len(p), k] = [ord(c) for c in p]
        h = np.array([self._hash(p) for p in pieces], np.uint64)
        self.order = np.argsort(h)
        self.sorted = h[self.order]
        self.some, self.begun = np.zeros(1 << _BITS, bool), np.zeros(1 << _BITS, bool)
        self.some[(h * _MIX >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        begun = np.array([self._hash(b) for b in {p[:k] for p in pieces for k in range(1, len(p) + 1)}], np.uint64)
        self.begun[(begun * _MIX >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    @staticmethod
    def load(path: str = VOCABULARY) -> Lattice:
        """The vocabulary with its own scores: a piece of rank r (its score is -r) weighs as 1 / (r + 2), and so does its mark of an end, whose score is 0."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i)]
        plain = [i for i in ids if not sp.is_byte(i)]
        raw = [i for i in ids if sp.is_byte(i)]
        weight = np.array([1 / (2 - min(0.0, sp.get_score(i))) for i in plain] + [1 / (2 + len(plain))] * len(raw))
        end = 1 / (2 - min(0.0, sp.get_score(sp.eos_id()))) if sp.eos_id() >= 0 else weight.min()
        total = weight.sum() + end
        return Lattice([sp.id_to_piece(i) for i in plain], np.log(weight / total), {int(sp.id_to_piece(i)[3:5], 16): len(plain) + k for k, i in enumerate(raw)}, float(np.log(end / total)))

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_MUL) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def edges(self, codes: np.ndarray):
        """from, to, rows, piece numbers, log probabilities: of all pieces, or bytes where a character is no piece, in words of one length."""
        n, length = codes.shape
        out = []
        for i in range(length):
            h, alive = np.zeros(n, np.uint64), np.arange(n)
            for j in range(i + 1, min(length, i + self.longest) + 1):
                h = h * _MUL + codes[alive, j - 1] + np.uint64(1)
                place = (h * _MIX >> np.uint64(64 - _BITS)).astype(np.int64)
                # only what some piece begins with goes on
                on = np.flatnonzero(self.begun[place])
                h, alive, place = h[on], alive[on], place[on]
                some = np.flatnonzero(self.some[place])
                rows = alive[some]
                at = np.minimum(np.searchsorted(self.sorted, h[some]), len(self.sorted) - 1)
                ok = self.sorted[at] == h[some]
                rows, piece = rows[ok], self.order[at[ok]]
                if len(rows):  # the hash alone could be that of another piece
                    ok = self.sizes[piece] == j - i
                    for k in range(j - i):
                        ok &= codes[rows, i + k] == self.codes[k, piece]
                    if not ok.all():
                        rows, piece = rows[ok], piece[ok]
                if len(rows):
                    out.append((i, j, rows, piece, self.logp[piece]))
                if j == i + 1 and len(rows) < n:
                    rest = np.ones(n, bool)
                    rest[rows] = False
                    rest = np.flatnonzero(rest)
                    chars, inverse = np.unique(codes[rest, i], return_inverse=True)
                    for k, c in enumerate(chars):
                        own = [self.bytes_at.get(b) for b in chr(int(c)).encode("utf-8", "surrogatepass")]
                        # a vocabulary without that byte: as rare as its rarest piece
                        lp = sum(self.logp[b] if b is not None else self.logp.min() for b in own)
                        out.append((i, j, rest[inverse == k], None, lp, [b for b in own if b is not None]))
                if not len(alive):
                    break
        return out

    @staticmethod
    def _forward(n: int, length: int, edges) -> np.ndarray:
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0
        for i, j, rows, _, lp, *_ in edges:  # in order of i, so alpha[i] is complete
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + lp)
        return alpha

    def groups(self, words: list[str]):
        """Indexes and character codes of words by length, in parts of bounded size."""
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        for length, at in sorted(by.items()):
            step = max(1, 400_000 // (length + 1))
            for lo in range(0, len(at), step):
                own = at[lo : lo + step]
                if length:
                    codes = np.array([words[k] for k in own], f"<U{length}").view(np.uint32).reshape(len(own), length)
                else:
                    codes = np.empty((len(own), 0), np.uint32)
                yield own, np.hstack([np.full((len(own), 1), ord(_WORD_START)), codes]).astype(np.uint64)

    def scores(self, words: list[str]) -> np.ndarray:
        """Natural logarithm of each word's probability."""
        out = np.zeros(len(words))
        for own, codes in self.groups(words):
            out[own] = self._forward(*codes.shape, self.edges(codes))[-1]
        return out

    def expected(self, words: list[str], count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected occurrences of every piece in words that occur so often; the natural logarithm of each word's probability."""
        total, lp_of = np.zeros(len(self.logp)), np.zeros(len(words))
        for own, codes in self.groups(words):
            n, length = codes.shape
            edges = self.edges(codes)
            alpha = self._forward(n, length, edges)
            beta = np.full((length + 1, n), -np.inf)
            beta[-1] = 0
            c, lp_of[own] = count[own], alpha[-1]
            for i, j, rows, piece, lp, *raw in reversed(edges):
                beta[i, rows] = np.logaddexp(beta[i, rows], beta[j, rows] + lp)
                share = np.exp(alpha[i, rows] + lp + beta[j, rows] - alpha[-1, rows]) * c[rows]
                if piece is not None:
                    total += np.bincount(piece, share, len(total))
                else:
                    for b in raw[0]:
                        total[b] += share.sum()
        return total, lp_of

    def estimated(self, expected: np.ndarray, ends: float, prior: float = 1000.0) -> Lattice:
        """Pieces and ends as expected, smoothed by the vocabulary's own scores."""
        weight = expected + prior * np.exp(self.logp)
        total = weight.sum() + ends + 1
        return Lattice(self.pieces, np.log(weight / total), self.bytes_at, float(np.log((ends + 1) / total)))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c (occurrences in training documents, 0 if it is in others only); the null word is the end of a text."""

    def run(batches):
        def rows(c: Counter, known: set):
            words = [*c, *(w for w in known if w not in c)]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([c[w] for w in words], pa.int64())], names=["word", "c"])

        c: Counter = Counter()
        known: set = set()
        for b in batches:
            for text, held in zip(b.column("text").to_pylist(), b.column("held_out").to_pylist()):
                if held:
                    known.update(words_of(text))
                else:
                    c.update(words_of(text))
                    c[None] += 1
                if len(c) + len(known) > FLUSH:
                    yield rows(c, known)
                    c, known = Counter(), set()
        yield rows(c, known)

    base = texts_of(docs.withColumn("held_out", crc_rest(10) == 0), "held_out").select("held_out", "text")
    return map_arrow(base, run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, learned_score of every document.

    Words of the text after A-Z are lower-cased, and an end. base_score: log10 likelihood under the smoothed
    word counts of the training documents; score: log10 of the lattice's marginal probability of the words
    and the end, under the vocabulary's own scores; learned_score: the same under what training documents give,
    P(word) = (max(c - D, 0) + (D V + 1) L(word)) / (N + 2) and P(end) = (ends + 1) / (N + 2), L being the lattice of
    learned pieces, V the distinct training words and D the discount n1 / (n1 + 2 n2), from 0.1 to 0.9, of n1 words
    that occur once and n2 that occur twice; it is finite and sums to at most 1. Null and empty texts have the end alone. Repeated rows count, and are returned,
    each; a null id counts as empty text where rows are held out; an empty table gives no rows; columns besides
    doc_id and text are not read. Words of any length are scored whole, in time linear in them."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "likelihood")
    counts = scratch.keep(word_counts(docs))
    total = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.sum(F.when(F.col("word").isNull(), F.col("c"))).alias("ends"), *(F.count_if(F.col("word").isNotNull() & (F.col("c") == k)).alias(f"n{k}") for k in (1, 2))).first()
    n, v, ends = total["n"] or 0, total["v"] or 0, total["ends"] or 0
    discount = min(0.9, max(0.1, total["n1"] / max(1, total["n1"] + 2 * total["n2"])))
    spelt = discount * (v - int(ends > 0)) + 1
    own = Lattice.load(vocabulary)
    first = spark.sparkContext.broadcast(own)

    def expect(lattice, keep: bool):
        """The words with their probability, if they are kept, then, without a word, the expected occurrences of pieces (numbered in c) in each training word once."""

        def run(batches):
            sums = np.zeros(len(lattice.value.logp))
            for b in together(batches):
                more, lp = lattice.value.expected(b.column("word").to_pylist(), (b.column("c").to_numpy(zero_copy_only=False) > 0).astype(float))
                sums += more
                if keep:
                    yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(lp / np.log(10))], names=["word", "c", "lp"])
            at = np.flatnonzero(sums)
            # sums of 1/65536, so that they don't depend on the order of addition
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), pa.array(at), pa.array(np.rint(sums[at] * 65536))], names=["word", "c", "lp"])

        return run

    def learnt(rows: DataFrame) -> Lattice:
        sums = np.zeros(len(own.logp))
        for r in rows.where("word IS NULL").groupBy("c").agg(F.sum(F.col("lp").cast("long")).alias("x")).collect():
            sums[r["c"]] = r["x"] / 65536
        return own.estimated(sums, 0)

    words = scratch.keep(map_arrow(counts.where("word IS NOT NULL"), expect(first, True), "word string, c long, lp double"), counts)
    second = spark.sparkContext.broadcast(learnt(words))
    model = spark.sparkContext.broadcast(learnt(map_arrow(words.where("word IS NOT NULL AND c > 0").select("word", "c"), expect(second, False), "word string, c long, lp double")))

    def marginal(batches):
        for b in together(batches):
            c = b.column("c").to_numpy(zero_copy_only=False)
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(c - discount, 0) / (n + 2))
            more = np.logaddexp(whole, np.log(spelt / (n + 2)) + model.value.scores(b.column("word").to_pylist())) / np.log(10)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), b.column("lp"), pa.array(more)], names=["word", "c", "lp", "more"])

    table = scratch.keep(map_arrow(words.where("word IS NOT NULL"), marginal, "word string, c long, lp double, more double"), words)
    floor = 0.1 * (v + 1) + n
    least = max(1.0, n / HEAD)
    common = table.where(F.col("c") >= least).collect()
    values = np.array([(np.log10((r["c"] + 0.1) / floor), r["lp"], r["more"]) for r in common]).reshape(-1, 3)
    head = spark.sparkContext.broadcast(({r["word"].encode(): k for k, r in enumerate(common)}, values))
    ends_at = (float(np.log10((ends + 0.1) / floor)) if floor else 0.0, own.end / np.log(10), float(np.log10((ends + 1) / (n + 2))))
    names, end_known = ("base_score", "score", "learned_score"), int(ends > 0)

    def read(batches):
        known, values = head.value
        for b in batches:
            n = b.num_rows
            size, seen, sums, words, times, ends = np.empty(n, np.int64), np.empty(n, np.int64), np.empty((n, 3)), [], [], np.zeros(n + 1, np.int32)
            for j, text in enumerate(b.column("text").to_pylist()):
                c = Counter(words_of(text))
                at, k = np.fromiter(map(known.get, c, repeat(-1)), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))
                own = at >= 0
                size[j], seen[j], sums[j] = k.sum() + 1, k[own].sum() + end_known, k[own] @ values[at[own]] + ends_at
                words += compress(c, ~own)
                times.append(k[~own])
                ends[j + 1] = len(words)
            rare = pa.StructArray.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(np.concatenate(times) if times else [], pa.int64())], names=["word", "k"])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(size), pa.array(seen), *(pa.array(np.ascontiguousarray(x)) for x in sums.T), pa.ListArray.from_arrays(pa.array(ends), rare)],
                names=["doc_id", "held_out", "n_tokens", "n_known", *names, "rare"],
            )

    base = texts_of(docs.withColumn("held_out", crc_rest(10) == 0), "held_out")
    rows = map_arrow(base, read, f"doc_id long, held_out boolean, n_tokens long, n_known long, {', '.join(f'{x} double' for x in names)}, rare array<struct<word: string, k: bigint>>")
    rows = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.k").join(table.where(F.col("c") < least), "word")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k"))).alias("more_known"),
        F.sum(F.col("k") * F.log10((F.col("c") + 0.1) / F.lit(float(floor)))).alias("more_base"),
        F.sum(F.col("k") * F.col("lp")).alias("more_score"),
        F.sum(F.col("k") * F.col("more")).alias("more_learned"),
    )
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return rows.drop("rare").join(rare, "row", "left").select("doc_id", "held_out", "n_tokens", plus("n_known", "more_known"), F.lit(n).cast("long").alias("train_tokens"), plus("base_score", "more_base"), plus("score", "more_score"), plus("learned_score", "more_learned"))
