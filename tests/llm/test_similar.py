"""Near-duplicates of the pipeline against brute-force Jaccard."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from sitemill.llm import simhash


def brute(rows, k, t):
    """doc_id: smallest doc_id reachable over pairs of similarity at least t."""
    sets = {}
    for i, x in rows:
        w = (x or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else {()}
    label = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n >= t * (len(sets[a]) + len(sets[b]) - n) - 1e-9 and label[a] != label[b]:
            lo, hi = sorted((label[a], label[b]))
            label = {i: lo if x == hi else x for i, x in label.items()}
    return label


def edited():
    """Texts with chains of copies of 1 to 8 edited words, a common passage, copies, short and empty texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(30)]
    texts = [None, "", " \n", "one", "One", "one two three", "a b c d e", "A  b c\nd e"]
    for _ in range(25):
        w = [word() for _ in range(rng.randint(20, 300))]
        w[:0] = passage if rng.random() < 0.5 else []
        texts.append(" ".join(w))
        for _ in range(rng.randint(1, 6)):
            for _ in range(rng.randint(1, 8)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    base = [word() for _ in range(120)]
    for _ in range(25):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("shingle, similarity", [(5, 0.8), (3, 0.6)])
def test_components_are_those_of_brute_force(spark, monkeypatch, shingle, similarity):
    """With so many windows that next to nothing is missed, also where blocks of an anchor are compared pair by pair."""
    rows = edited()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (4096, 10):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar(df, shingle, similarity, 0.9999).collect()}
        assert got == brute(rows, shingle, similarity)


def test_windows_keep_the_recall_at_every_size():
    """More fingerprints: longer windows, and as many more of them as pairs of the similarity need to meet."""
    share, code = simhash.differing(0.8), simhash._golay()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (2000, 256), np.uint8)
    y = x ^ (rng.random(x.shape) < share)
    for n in (1000, 10**7, 10**9):
        windows, most = simhash.windows_for(n, 0.8, 0.95)
        met = np.zeros(len(x), bool)
        for row in windows:
            assert len(set(row.tolist())) == len(row)
            where = []
            for z in (x, y):
                at, anchor = simhash._near(z[:, row[:23]].astype(np.int64) @ (1 << np.arange(23)), 1, code)
                where.append(np.unique(at << 23 | anchor))
            same = (x[:, row[23:]] == y[:, row[23:]]).all(1)
            hit = np.zeros(len(x), bool)
            hit[np.intersect1d(*where) >> 23] = True
            met |= hit & same
        assert met.mean() > 0.94 and ((x ^ y).sum(1) <= most).mean() > 0.995


def test_spanning_forest_is_minimal():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, (3, 4)).astype(np.uint64)
    prints = np.array([base[k % 3] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 63, (rng.integers(0, 9), 4)).astype(np.uint64), axis=0) for k in range(40)])
    a, b, d = simhash.spanning(np.arange(40), prints, 30, 0.05)
    apart = {(i, j): int(np.bitwise_count(prints[i] ^ prints[j]).sum()) for i, j in combinations(range(40), 2)}
    label, want = list(range(40)), []
    for x, i, j in sorted((v, i, j) for (i, j), v in apart.items() if v <= 30):
        if label[i] != label[j]:
            want.append(x)
            label = [label[i] if y == label[j] else y for y in label]
    assert sorted(d.tolist()) == want and all(apart[min(p), max(p)] == x for p, x in zip(zip(a.tolist(), b.tolist()), d.tolist()))


def test_stage_drops_edited_copies(spark):
    rows = edited()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    label = brute(rows, 5, 0.8)
    kept = {r["doc_id"] for r in P.drop_near_duplicates(spark, df, "").collect()}
    want = {i for i, x in label.items() if i == x}
    assert want <= kept and len(kept - want) <= 2
    assert P.drop_near_duplicates(spark, df.where(F.lit(False)), "").count() == 0


def test_columns_and_rows_of_any_kind(spark):
    long = " ".join(f"w{k % 977}" for k in range(20000))
    rows = [(1, long, 7), (2, long + " end", 7), (2, long + " end", 7), (3, None, 7), (4, "", 7), (None, "one two", 7), (5, "ONE two", 7), (None, "alone", 7), (6, "é 你好 \U0001f600", 7), (6, "other words", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x int")
    for name in ("node", "f0", "n", "own", "some", "component_id", "gone_id", "a.b"):
        df = df.withColumn(name, F.lit(-1))
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"][:5]) for r in kept.where("text IS NOT NULL").collect()) == sorted([(1, long[:5]), (0, "alone"), (0, "one t"), (5, "ONE t"), (6, "é 你好 "[:5]), (6, "other")])
    assert kept.where("text IS NULL").count() == 1 and kept.where("doc_id = 4").count() == 0
