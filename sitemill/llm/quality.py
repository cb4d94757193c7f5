"""Quality: random-indexing word vectors, pooled by document, under a two-layer network.

A word is a run of what isn't white space, case and marks included. Every word has a sparse ternary index vector
of its own, made from its hash. The HEAD most frequent words each have a context vector: the sum, over all
documents, of the index vectors of the words within two places of it. All rarer words share context vectors by
their written form (case, what follows, length), and keep their own index vectors. Sums are of integers, so they
don't depend on the order of addition. A document is the mean of its words' vectors (context, scaled to length
one, and index), and a network with one hidden layer, fitted in numpy to a bounded sample of labelled documents,
gives its probability, calibrated by a temperature on held-back documents.
"""

from __future__ import annotations

from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from .common import Cached, map_arrow, texts_of
from .labelled import PER_CLASS, held_out, sample, sigmoid

#: Words with a context vector of their own at most, which bounds what is broadcast (8 MB of vectors).
HEAD = 1 << 16
WIDTH, NONZERO, REACH, HIDDEN = 32, 4, 2, 16
#: Words that a worker counts before it sends them on.
FLUSH = 200_000


def form(word: str) -> int:
    """0 to 255: by case (lower, first letter, all, other, none), what follows (nothing, one mark of a sentence, several, other signs) and length."""
    size = len(word)
    long = size if size < 15 else 15
    if word.isalnum():
        body, after = word, 0
    else:
        end = size
        while end and not word[end - 1].isalnum():
            end -= 1
        if not end:
            return 240 + long
        body, tail = word[:end], word[end:]
        after = 0 if not tail else 3 if tail.strip(".,;:!?)\"'") else 1 if len(tail) == 1 else 2
    if body.islower():
        case = 0
    elif body[0].isupper() and (len(body) == 1 or body[1:].islower()):
        case = 1
    else:
        case = 2 if len(body) > 1 and body.isupper() else 3
    return min(14, case * 4 + after) * 16 + long


FORMS = 256


class Words:
    """Numbers words as they are met; keeps their index vectors, as places and signs, and the row of their context vector."""

    def __init__(self, head: dict[str, int]):
        self.head, self.known = head, Cached(self.add)
        self.n, self.hashes, self.found = len(head), array("Q"), array("q")
        self.rows, self.places, self.signs = np.zeros(0, np.int64), np.zeros((0, NONZERO), np.int64), np.zeros((0, NONZERO), np.int8)

    def add(self, word: str) -> int:
        row = self.head.get(word)
        self.hashes.append(xxh64_intdigest(word.encode("utf-8", "surrogatepass")))
        self.found.append(self.n + form(word) if row is None else row)
        return len(self.known)

    def read(self, texts: list[str]) -> list[np.ndarray]:
        self.known.trim()
        if not self.known:
            self.rows, self.places, self.signs = self.rows[:0], self.places[:0], self.signs[:0]
        get = self.known.__getitem__
        lines = [np.fromiter(map(get, w), np.int64, len(w)) for w in map(str.split, texts)]
        if self.hashes:
            h, rows = np.array(self.hashes, np.uint64), np.array(self.found, np.int64)
            self.hashes, self.found = array("Q"), array("q")
            places = np.stack([(h >> np.uint64(8 * j)) % np.uint64(WIDTH) for j in range(NONZERO)], 1).astype(np.int64)
            signs = np.stack([1 - 2 * (h >> np.uint64(40 + j) & np.uint64(1)).astype(np.int8) for j in range(NONZERO)], 1).astype(np.int8)
            self.rows, self.places, self.signs = np.concatenate([self.rows, rows]), np.concatenate([self.places, places]), np.concatenate([self.signs, signs])
        return lines

    def contexts(self, lines: list[np.ndarray], n: int) -> np.ndarray:
        """Sums, for each of n rows, of index vectors around its words."""
        total = np.zeros(n * WIDTH)
        gap = np.full(REACH, -1)
        flat = np.concatenate([x for line in lines for x in (line, gap)] or [gap])
        for step in range(1, REACH + 1):
            a, b = flat[:-step], flat[step:]
            ok = (a >= 0) & (b >= 0)
            a, b = a[ok], b[ok]
            for x, y in ((a, b), (b, a)):
                for lo in range(0, len(x), 1 << 19):
                    i, j = x[lo : lo + (1 << 19)], y[lo : lo + (1 << 19)]
                    total += np.bincount((self.rows[i, None] * WIDTH + self.places[j]).ravel(), self.signs[j].ravel(), n * WIDTH)
        return total.reshape(n, WIDTH)

    def vectors(self, contexts: np.ndarray, first: int = 0) -> np.ndarray:
        """Vectors of all words met, from the first one asked for on."""
        out = contexts[self.rows[first:]]
        at = np.arange(len(out))
        for j in range(NONZERO):
            out[at, self.places[first:, j]] += self.signs[first:, j] / np.float32(np.sqrt(NONZERO))
        return out


def most_frequent(docs: DataFrame, most: int = HEAD) -> dict[str, int]:
    """The most frequent words of all texts, numbered in order; of equally frequent ones, the first by code point.

    Words are counted where they are read, then by word; none is frequent enough in sums of partial counts to be a hot key."""

    def run(batches):
        c: Counter = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                c.update(text.split())
                if len(c) > FLUSH:
                    yield _counted(c)
                    c = Counter()
        yield _counted(c)

    counts = map_arrow(texts_of(docs).select("text"), run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return {w: k for k, w in enumerate(counts.orderBy(F.desc("c"), "word").limit(most).select("word").toArrow().column("word").to_pylist())}


def _counted(c: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "c"])


def word_vectors(docs: DataFrame, head: dict[str, int]) -> np.ndarray:
    """Context vectors of length one (or zero) of the frequent words, then of the forms, from all texts."""
    n = len(head) + FORMS
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        total, words = np.zeros((n, WIDTH)), Words(shared.value)
        for b in batches:
            total += words.contexts(words.read(b.column("text").to_pylist()), n)
        used = np.flatnonzero(total.any(1))
        for lo in range(0, len(used), 1 << 14):
            part = used[lo : lo + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(total[part, d].astype(np.int64)) for d in range(WIDTH))], names=["row", *names])

    names = [f"v{d}" for d in range(WIDTH)]
    sums = map_arrow(texts_of(docs).select("text"), run, "row int, " + ", ".join(f"{x} long" for x in names)).groupBy("row").agg(*(F.sum(x).alias(x) for x in names)).toArrow()
    c = np.zeros((n, WIDTH))
    c[sums.column("row").to_numpy()] = np.stack([sums.column(x).to_numpy() for x in names], 1)
    return (c / np.maximum(1e-9, np.linalg.norm(c, axis=1, keepdims=True))).astype(np.float32)


def pooled(lines: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Mean vector of each text, and the logarithm of its number of words."""
    out = np.zeros((len(lines), WIDTH + 1))
    for k, line in enumerate(lines):
        if len(line):
            out[k, :WIDTH] = vectors[line].sum(0, dtype=np.float64) / len(line)
            out[k, WIDTH] = np.log1p(len(line)) / 10
    return out


class Reader:
    """Texts to pooled vectors; vectors of words are made once."""

    def __init__(self, head: dict[str, int], contexts: np.ndarray):
        self.words, self.contexts, self.made, self.n = Words(head), contexts.astype(np.float32), np.zeros((1 << 16, WIDTH), np.float32), 0

    def __call__(self, texts: list[str]) -> np.ndarray:
        lines = self.words.read(texts)
        k = len(self.words.rows)
        if k < self.n:  # they were forgotten
            self.n = 0
        if k > self.n:
            while k > len(self.made):
                self.made = np.concatenate([self.made, np.zeros_like(self.made)])
            self.made[self.n : k] = self.words.vectors(self.contexts, self.n)
            self.n = k
        return pooled(lines, self.made)


class Net:
    """x -> sigmoid((tanh(x A + a) B + b) / temperature) after x is standardised."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, back: np.ndarray, steps: int = 1500, rate: float = 0.01, ridge: float = 1e-3):
        self.temperature = 1.0
        if len(set(y.tolist())) < 2:
            share = (y.sum() + 0.5) / (len(y) + 1)
            n = x.shape[1] if x.ndim == 2 else WIDTH + 1
            self.mean, self.sd, self.p = np.zeros(n), np.ones(n), [np.zeros((n, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.log(share / (1 - share))]
            return
        own = ~back
        self.mean, self.sd = x[own].mean(0), x[own].std(0) + 1e-3
        rng = np.random.default_rng(0)
        self.p = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(())]
        m, v = [np.zeros_like(q) for q in self.p], [np.zeros_like(q) for q in self.p]
        z, t, u = (x[own] - self.mean) / self.sd, y[own], w[own] / w[own].sum()
        for k in range(1, steps + 1):
            h = np.tanh(z @ self.p[0] + self.p[1])
            d = u * (sigmoid(h @ self.p[2] + self.p[3]) - t)
            dh = np.outer(d, self.p[2]) * (1 - h * h)
            grads = [z.T @ dh + ridge * self.p[0], dh.sum(0), h.T @ d + ridge * self.p[2], d.sum()]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.p[i] = self.p[i] - rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
        s, t, u = self.logit(x[back]), y[back], w[back]
        if len(set(t.tolist())) == 2:
            loss = lambda c: float(np.sum(u * (np.logaddexp(0, s / c) - t * s / c)))
            self.temperature = min(np.exp(np.linspace(-1.5, 2.5, 81)), key=loss)

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.sd) @ self.p[0] + self.p[1])
        return (h @ self.p[2] + self.p[3]) / self.temperature


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[dict[str, int], np.ndarray, Net]:
    """Frequent words, context vectors and the network; labels only of documents outside the held-out fold.

    Of the labelled sample only pooled vectors, 33 numbers a document, come to the driver."""
    head = most_frequent(docs)
    vectors = word_vectors(docs, head)
    shared = docs.sparkSession.sparkContext.broadcast((head, vectors))

    def reduce():
        read = Reader(*shared.value)
        return lambda texts: [x.tobytes() for x in read(texts)]

    rows = sample(docs, labels, "quality", reduce, per_class)
    x = np.array([np.frombuffer(r[3]) for r in rows]).reshape(len(rows), WIDTH + 1)
    y, w = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    return head, vectors, Net(x, y, w, np.arange(len(rows)) % 5 == 0)


def rate(docs: DataFrame, model: tuple[dict[str, int], np.ndarray, Net]) -> DataFrame:
    """doc_id, held_out, score (0 to 1) of every document.

    Null and empty texts are the zero vector and get the network's score of it; texts of any length are read
    whole; repeated rows, and those with a null id, give a row each, a null id counting as empty text where rows
    are held out; an empty table gives none; columns besides doc_id and text are not read. Scores are rounded to 9
    decimals, so that equal texts have equal ones in any batch; where nothing was learnt all have the same."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        head, vectors, net = shared.value
        read = Reader(head, vectors)
        for b in batches:
            x = read(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(np.round(sigmoid(net.logit(x)), 9))], names=["doc_id", "held_out", "score"])

    return map_arrow(texts_of(docs.withColumn("held_out", held_out()), "held_out"), run, "doc_id long, held_out boolean, score double")
