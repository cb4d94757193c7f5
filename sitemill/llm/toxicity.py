"""Toxic spans by a linear-chain conditional random field.

Labels are of whole documents, so tokens get theirs first: the fewest words or beginnings of words that, greedily, cover the toxic
documents without occurring, or occurring as often, in clean ones mark the toxic tokens of those documents;
all other tokens are clean. The field has features of a token (its form, beginnings, end and shape, hashed) and of pairs of neighbouring
labels, and is trained by gradient steps on its exact marginals. A document's score is a calibrated function
of the sum of its tokens' marginals from forward-backward over the whole text.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Cached, map_arrow, texts_of
from .decontaminate import token
from .labelled import PER_CLASS, held_out, logistic, sampled_texts, sigmoid

BUCKETS = 1 << 16
#: Cells (tokens times documents) of one forward-backward pass.
CELLS = 1 << 20
#: How often, at most, a document may be asked to have a form or beginning for it to count as toxic.
OFTEN = 3
_TOKEN = re.compile(r"\S+")


def parts(t: str) -> list[str]:
    """A token's form and its beginnings (ended by "*")."""
    return ["=" + t, *(t[:k] + "*" for k in range(3, min(8, len(t) + 1)))]


def features(word: str) -> list[int]:
    """Hashes of a token's form (two, so that a collision in one is outweighed), its beginnings, its last letters and its shape."""
    t = token(word)
    if not t:
        return [crc32(b"none") % BUCKETS]
    kind = "d" if any(c.isdigit() for c in t) else "U" if word.isupper() and len(t) > 1 else "l"
    return [crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in (*parts(t), "f" + t, "s" + t[-4:], "k" + kind + str(min(len(t), 12)))]


def repeats(text: str) -> Iterator[tuple[str, int]]:
    """Each form or beginning of a text's tokens with 1, 2 and so on, up to how often it occurs or OFTEN."""
    count = Counter(x for w in text.split() if (k := token(w)) for x in parts(k))
    return ((x, m) for x, n in count.items() for m in range(1, min(n, OFTEN) + 1))


def rationale(texts: list[str], y: list[int]) -> set[tuple[str, int]]:
    """Forms or beginnings of tokens, each with how often a document must have it, that cover the documents of label 1.

    They are chosen greedily; a share of the clean documents that has one costs as much as five times that share of the toxic ones gains.
    Forms that 5% of the toxic, and no clean one, have are added."""
    toxic, clean = [t for t, v in zip(texts, y) if v], [t for t, v in zip(texts, y) if not v]
    rate = 5 * len(toxic) / max(1, len(clean))
    least, often = max(2, len(toxic) // 200), max(8, len(toxic) // 20)
    # only what enough toxic documents have is looked up in the others, so that little is held at a time
    count = Counter(x for t in toxic for x in repeats(t))
    count = {x: n for x, n in count.items() if n >= least}
    in_clean = Counter(x for t in clean for x in repeats(t) if x in count)
    where: dict[tuple[str, int], set[int]] = {x: set() for x, n in count.items() if n - rate * in_clean[x] >= least}
    for k, t in enumerate(toxic):
        for x in repeats(t):
            if x in where:
                where[x].add(k)
    left, chosen = set(range(len(toxic))), set()
    while left and where:
        gain, _, _, best = max((len(where[x] & left) - rate * in_clean[x], len(x[0]), -x[1], x) for x in where)
        if gain < least:
            break
        chosen.add(best)
        left -= where.pop(best)
    # whole words that many toxic and no clean documents have, though others cover those documents too
    return chosen | {x for x, n in count.items() if x[0][0] == "=" and x[1] == 1 and n >= often and not in_clean[x]}


def passes(psi: list[np.ndarray], trans: np.ndarray):
    """Documents in blocks: their indexes (longest first), lengths, and forward and backward odds as (token, document) arrays.

    psi: odds of a token by itself. trans: potentials of [from, to], then of a first token."""
    (a00, a01), (a10, a11) = trans[:4].reshape(2, 2)
    order = sorted(range(len(psi)), key=lambda k: -len(psi[k]))
    while order and not len(psi[order[-1]]):
        order.pop()
    at = 0
    while at < len(order):
        t = len(psi[order[at]])
        own = order[at : at + max(1, CELLS // t)]
        # not too unequal: short documents wait for a block of their own
        own = [k for k in own if 4 * len(psi[k]) >= t] if t > 64 else own
        at += len(own)
        lens = np.array([len(psi[k]) for k in own])
        grid = np.ones((t, len(own)))
        for j, k in enumerate(own):
            grid[: lens[j], j] = psi[k]
        active = np.searchsorted(-lens, -np.arange(1, t + 1), "right")
        fwd, bwd = grid.copy(), np.ones_like(grid)
        fwd[0] *= trans[4]
        for i in range(1, t):
            n = active[i]
            r = fwd[i - 1, :n]
            fwd[i, :n] *= (a11 * r + a01) / (a10 * r + a00)
        for i in range(t - 2, -1, -1):
            n = active[i + 1]
            s = bwd[i + 1, :n] * grid[i + 1, :n]
            bwd[i, :n] = (a11 * s + a10) / (a01 * s + a00)
        yield own, lens, grid, fwd, bwd


def gathered(p: list[np.ndarray]) -> np.ndarray:
    """Of each document: expected toxic tokens on two scales, their share, and the largest marginal."""
    mass, n, most = np.array([x.sum() for x in p]), np.array([len(x) for x in p]), np.array([x.max(initial=0.0) for x in p])
    return np.stack([np.log(mass + 1e-3), np.log1p(mass), np.log((mass + 0.05) / (n + 10)), most], 1)


class Field:
    """Weights of the features, potentials of label pairs, and the calibration of document scores."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, scale: np.ndarray):
        self.weights, self.trans, self.scale = weights, trans, scale

    def odds(self) -> Cached:
        w = self.weights.tolist()
        return Cached(lambda word: float(np.exp(max(-25.0, min(25.0, sum(w[k] for k in features(word)))))))

    def marginals(self, psi: list[np.ndarray]) -> list[np.ndarray]:
        """P(toxic) of every token of every document."""
        out = [np.empty(0)] * len(psi)
        for own, lens, _, fwd, bwd in passes(psi, self.trans):
            odds = fwd * bwd
            p = odds / (1 + odds)
            for j, k in enumerate(own):
                out[k] = p[: lens[j], j]
        return out

    def score(self, p: list[np.ndarray]) -> np.ndarray:
        """Of documents with these marginals; rounded, so that equal documents have equal scores in any batch."""
        return np.round(sigmoid(gathered(p) @ self.scale[:-1] + self.scale[-1]), 9)


def train(texts: list[str], y: list[int], weight: list[float], steps: int = 90, rate: float = 0.5, ridge: float = 1e-6) -> Field:
    """Four of five documents give the token labels and the field, the fifth the calibration.

    Without any document the field scores every text 0.25: where nothing was learnt, nothing is predicted as toxic."""
    trans, weights = np.array([1.0, 0.02, 0.5, 0.5, 0.02]), np.zeros(BUCKETS)
    if len(set(y)) < 2:  # nothing to tell apart: the share of the only class, drawn to one half
        share = (sum(y) + 0.5) / (len(y) + 1) if y else 0.25
        return Field(weights, trans, np.array([0.0, 0.0, 0.0, 0.0, np.log(share / (1 - share))]))
    fit = [k for k in range(len(texts)) if k % 5]
    chosen = rationale([texts[k] for k in fit], [y[k] for k in fit])
    types: dict[str, int] = {}
    ids = [np.array([types.setdefault(w, len(types)) for w in texts[k].split()], np.int64) for k in fit]
    hashed, owner, marked = array("q"), array("q"), {x: np.zeros(len(types), bool) for x, _ in chosen}
    for w, k in types.items():
        hashed.extend(found := features(w))
        owner.extend([k] * len(found))
        for x in parts(token(w)):
            if x in marked:
                marked[x][k] = True
    flat, owner = np.array(hashed, np.int64), np.array(owner, np.int64)
    marks = [(marked[x], m) for x, m in sorted(chosen)]
    goal = [np.zeros(len(i), bool) for i in ids]
    for i, k, g in zip(ids, fit, goal):
        for mark, m in marks if y[k] else ():
            if (hit := mark[i]).sum() >= m:
                g |= hit
    weights[crc32(b"none") % BUCKETS] = -1.0
    bias = np.log(max(1, sum(g.sum() for g in goal)) / max(1, sum(map(len, goal))))
    logt, g2w, g2t = np.log(trans), np.full(BUCKETS, 1e-8), np.full(5, 1e-8)
    weights += bias / 6
    rng = np.random.default_rng(0)
    batches = max(1, len(fit) // 256)
    for _ in range(-(-steps // batches)):
        for part in np.array_split(rng.permutation(len(fit)), batches):
            by_type = np.exp(np.clip(np.bincount(owner, weights[flat], len(types)), -25, 25))
            own = [ids[k] for k in part]
            grad, gt, n = np.zeros(len(types)), np.zeros(5), max(1, sum(map(len, own)))
            for at, lens, grid, fwd, bwd in passes([by_type[i] for i in own], np.exp(logt)):
                odds = fwd * bwd
                p = odds / (1 + odds)
                a = np.exp(logt)
                for j, k in enumerate(at):
                    i, want = own[k], goal[part[k]]
                    grad += np.bincount(i, p[: lens[j], j] - want, len(types))
                    gt[4] += p[0, j] - want[0]
                    if lens[j] > 1:
                        r, s = fwd[: lens[j] - 1, j], (grid * bwd)[1 : lens[j], j]
                        pair = np.stack([np.full(len(r), a[0]), a[1] * s, a[2] * r, a[3] * r * s])
                        gt[:4] += (pair / pair.sum(0)).sum(1) - np.bincount(2 * want[:-1] + want[1:], minlength=4)
            gw = np.bincount(flat, grad[owner], BUCKETS) / len(part) + ridge * weights
            g2w += gw * gw
            weights -= rate * gw / np.sqrt(g2w)
            gt[0] = 0  # the clean pair is the measure of the others
            gt /= len(part)
            g2t += gt * gt
            logt = np.clip(logt - 0.2 * gt / np.sqrt(g2t), -8, 4)
    field = Field(weights, np.exp(logt), np.zeros(5))
    rest = [k for k in range(len(texts)) if k % 5 == 0]
    odds = field.odds()
    p = field.marginals([np.array([odds[w] for w in texts[k].split()]) for k in rest])
    field.scale = logistic(gathered(p), np.array([y[k] for k in rest], float), np.array([weight[k] for k in rest]))
    return field


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Field:
    """From a sample of labelled documents outside the held-out fold: at most per_class of either label and labelled.SAMPLE_CHARS characters of each."""
    rows = sampled_texts(docs, labels, "toxic", per_class)
    return train([r[3] for r in rows], [r[1] for r in rows], [r[2] for r in rows])


def _scored(texts: list[str], field: Field, odds: Cached) -> tuple[np.ndarray, list[np.ndarray]]:
    get = odds.__getitem__
    odds.trim()
    psi = [np.fromiter(map(get, words), float, len(words)) for words in map(str.split, texts)]
    p = field.marginals(psi)
    return field.score(p), p


def offsets(text: str, p: np.ndarray) -> str:
    """start:end of runs of tokens that are likelier toxic than not, as code points."""
    out: list[list[int]] = []
    last = -2
    for k, m in enumerate(_TOKEN.finditer(text)):
        if p[k] >= 0.5:
            if last == k - 1:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
            last = k
    return ",".join(f"{a}:{b}" for a, b in out)


def tag(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on), spans (toxic ones, start:end) of every document.

    Null and empty texts have the score of a text without toxic tokens; texts of any length are read whole;
    repeated rows, and those with a null id, give a row each, a null id counting as empty text where rows are held
    out; an empty table gives none; columns besides doc_id and text are not read. Equal texts have equal scores; a
    token that is as likely toxic as not counts as toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        field = shared.value
        odds = field.odds()
        for b in batches:
            texts = b.column("text").to_pylist()
            score, p = _scored(texts, field, odds)
            spans = [offsets(t, x) if len(x) and x.max() >= 0.5 else "" for t, x in zip(texts, p)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, pa.string())], names=["doc_id", "held_out", "score", "predicted", "spans"])

    return map_arrow(texts_of(docs.withColumn("held_out", held_out()), "held_out"), run, "doc_id long, held_out boolean, score double, predicted int, spans string")


def keep_clean(docs: DataFrame, field: Field) -> DataFrame:
    """docs without those that the field predicts as toxic; all of them stay where it was fitted to no document.

    Null and empty texts are scored as in tag, and stay null; texts of any length are read whole; repeated rows go
    or stay alike, rows with a null id by their text; an empty table gives none. All columns are kept, whatever
    their names. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        field = shared.value
        odds = field.odds()
        for b in batches:
            score, _ = _scored([t or "" for t in b.column("text").to_pylist()], field, odds)
            yield b.filter(pa.array(score < 0.5))

    own = docs.withColumn("text", F.col("text").cast("string"))
    return map_arrow(own, run, own.schema)
