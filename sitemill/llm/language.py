"""Language identification: averaged hashed subword embeddings and a linear softmax, by stochastic gradient descent.

A word's subwords are itself, its trigrams within "<" and ">", and its first and last letters, each hashed to
a row of an embedding table; a document is the mean of all its subwords' rows. As the softmax is linear in
that mean, a trained model is one table of class scores by subword, and a word's scores are added up once
and kept. Confidences are calibrated by a temperature on held-back documents, where also the confidence is
found below which a prediction is rejected.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Cached, crc_rest, map_arrow, texts_of
from .decontaminate import token

BUCKETS, WIDTH = 1 << 16, 16
#: Documents of each language, about, that the model is trained on; the largest share of errors left after rejection.
PER_LANGUAGE, MAX_ERROR = 500, 0.01
#: Documents of all languages that the model is trained on, about.
SAMPLE = 20_000
UNKNOWN = "und"


def subwords(word: str) -> list[int]:
    t = f"<{token(word)}>"
    if len(t) < 3:
        return []
    return [crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in (t, t[:3] + "-", "-" + t[-4:], *(t[k : k + 3] for k in range(len(t) - 2)))]


class Model:
    """Class scores by subword, bias, temperature and the confidence below which a prediction is rejected."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, least: float = 0.0):
        self.languages, self.table, self.bias, self.temperature, self.least = languages, table.astype(np.float32), bias, temperature, least

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """Reads texts; keeps the added-up scores of the words it has met."""

    def __init__(self, model: Model):
        self.model, self.most = model, 200_000
        self.rows = np.zeros((4096, model.table.shape[1] + 1), np.float32)
        self.known = Cached(self.add, self.most)

    def add(self, word: str) -> int:
        k = len(self.known)
        if k >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        s = subwords(word)
        self.rows[k, :-1] = self.model.table[s].sum(0) if s else 0
        self.rows[k, -1] = len(s)
        return k

    def logits(self, text: str) -> np.ndarray:
        """Class scores of the mean of the text's subwords."""
        words = text.split()
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))  # may enlarge rows
        x = self.rows[at].sum(0, dtype=np.float64)
        return x[:-1] / max(1.0, x[-1]) + self.model.bias

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers and calibrated confidences."""
        self.known.trim()
        z = np.array([self.logits(t) for t in texts]).reshape(len(texts), -1) / self.model.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def counted(text: str, known: Cached) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding table that a text's subwords have, and how often; at most BUCKETS, however long the text is."""
    words = Counter(text.split())
    ids = [s for w in words for s in known[w]]
    times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(known[w]) for w in words])
    n = np.bincount(np.array(ids, np.int64), times, BUCKETS) if ids else np.zeros(0)
    k = np.flatnonzero(n)
    return k, n[k]


def train(counts: list[tuple[np.ndarray, np.ndarray]], names: list[str], epochs: int = 8, rate: float = 0.5, batch: int = 32, seed: int = 0) -> Model:
    languages = sorted(set(names))
    if len(languages) < 2:
        return Model(languages or [UNKNOWN], np.zeros((BUCKETS, 1)), np.zeros(1))
    y = np.array([languages.index(n) for n in names])
    docs = [(k, (n / max(1.0, n.sum())).astype(np.float32)) for k, n in counts]
    rng = np.random.default_rng(seed)
    e, w, b = (rng.standard_normal((BUCKETS, WIDTH)) / WIDTH).astype(np.float32), np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages))
    w += rng.standard_normal(w.shape).astype(np.float32) * 0.1
    back = np.arange(len(docs)) % 5 == 0
    steps = epochs * max(1, int((~back).sum()) // batch)
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(np.flatnonzero(~back)), max(1, int((~back).sum()) // batch)):
            idx = np.concatenate([docs[k][0] for k in part])
            val = np.concatenate([docs[k][1] for k in part])
            row = np.repeat(np.arange(len(part)), [len(docs[k][0]) for k in part])
            h = np.stack([np.bincount(row, val * e[idx, d], len(part)) for d in range(WIDTH)], 1)
            z = h @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            lr = rate * (1 - step / steps)
            gh = (p @ w.T).astype(np.float32)
            w -= lr * (h.T @ p / len(part)).astype(np.float32) * 4
            b -= lr * p.mean(0)
            # a row's step is its own share of the mean, enlarged as shares of a thousand subwords are small
            np.subtract.at(e, idx, (lr * 100 / len(part)) * val[:, None] * gh[row])
            step += 1
    model = Model(languages, e @ w, b)
    held = np.flatnonzero(back)
    z = np.array([docs[k][1].astype(float) @ model.table[docs[k][0]] + model.bias for k in held]).reshape(len(held), -1)
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(np.log(0.05), np.log(5), 80)):
        s = z / t
        s = s - s.max(1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(held)), y[held]]))
        best = min(best, (loss, float(t)))
    model.temperature = best[1]
    s = np.exp((z - z.max(1, keepdims=True)) / model.temperature)
    p = s / s.sum(1, keepdims=True)
    order = np.argsort(-p.max(1))
    wrong = np.cumsum(p.argmax(1)[order] != y[held][order]) / np.arange(1, len(held) + 1)
    fine = np.flatnonzero(wrong <= MAX_ERROR)
    model.least = float(p.max(1)[order][fine[-1]]) if len(fine) else 1.0
    return model


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """From about per_language documents of each language (those of the smallest hashes of doc_id), or fewer where SAMPLE for all is less, whose crc32(doc_id as text) mod 4 isn't 2.

    The documents of all are at most twice the number asked for. Only counts of their subwords come to the driver,
    which are at most BUCKETS for a document of any length."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL").where(crc_rest(4) != 2)
    count = own.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not count:
        return train([], [])
    most = max(2, min(per_language, SAMPLE // len(count)))
    share = F.create_map(*(x for r in count for x in (F.lit(r["lang"]), F.lit(min(1.0, most / r["n"])))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    some = own.where(place < share[F.col("lang")])

    def run(batches):
        known = Cached(subwords)
        for b in batches:
            found = [counted(t, known) for t in b.column("text").to_pylist()]
            known.trim()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array([k.astype(np.int32).tobytes() for k, _ in found], pa.binary()), pa.array([n.astype(np.float32).tobytes() for _, n in found], pa.binary())], names=["doc_id", "lang", "k", "n"])

    rows = map_arrow(some, run, "doc_id long, lang string, k binary, n binary").orderBy(F.xxhash64("doc_id"), "doc_id", "k", "n").limit(2 * most * len(count)).collect()
    rows.sort(key=lambda r: (crc32(str(r["doc_id"]).encode()), r["k"], r["n"]))
    return train([(np.frombuffer(r["k"], np.int32), np.frombuffer(r["n"], np.float32)) for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_best, confidence, lang (lang_best, or "und" where it is rejected or there is no letter) of every document.

    A text that is null or has no letter has "und" for both and confidence 0. Of equally likely languages the
    first by name is taken; equal texts have equal results. Texts of any length are read whole. Repeated rows, and
    those with a null id, give a row each, a null id counting as empty text where rows are held out; an empty
    table gives none; columns besides doc_id and text are not read. With one language to learn from, all texts
    with a letter are of it; with none, all are "und"."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        reader = model.reader()
        for b in batches:
            texts = b.column("text").to_pylist()
            at, p = reader.predict(texts)
            some = [any(map(str.isalpha, t)) for t in texts]
            best = [model.languages[k] if s else UNKNOWN for k, s in zip(at, some)]
            sure = [float(x) if s else 0.0 for x, s in zip(p, some)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(best, pa.string()), pa.array(sure, pa.float64()), pa.array([n if x >= model.least else UNKNOWN for n, x in zip(best, sure)], pa.string())], names=["doc_id", "held_out", "lang_best", "confidence", "lang"])

    return map_arrow(texts_of(docs.withColumn("held_out", crc_rest(4) == 2), "held_out"), run, "doc_id long, held_out boolean, lang_best string, confidence double, lang string")
