"""The model's score of held-out documents against the base of word counts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from sitemill.llm import likelihood, queries


def held(k):
    return zlib.crc32(str(k).encode()) % 10 == 0


def test_held_out_scores_are_near_the_base_and_match_the_definition(spark, tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(400)], k=120)) for _ in range(200)] + ["unseenword " * 3, "", None, "x" * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.lm_scoring(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got.values())
    mean = lambda c: np.mean([r[c] for k, r in got.items() if held(k) and k < 200])
    assert mean("score") > 1.1 * mean("base_score") > mean("vocabulary_score")

    c = Counter(w for k, t in enumerate(texts) if not held(k) for w in (t or "").split())
    ends = sum(not held(k) for k in range(len(texts)))
    n, once, twice = sum(c.values()) + ends, sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    d = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
    own = likelihood.Lattice.load()
    for _ in range(2):
        lattice = own if _ == 0 else learned
        learned = own.estimated(lattice.expected(list(c), np.ones(len(c)))[0], 0)
    some = ["unseenword", *words[:20], "x" * 5000]
    spelt = dict(zip(some, learned.scores(some)))
    word = lambda w: np.logaddexp(np.log(max(c[w] - d, 1e-300) / (n + 2)), np.log((d * len(c) + 1) / (n + 2)) + spelt[w]) / np.log(10)
    end = math.log10((ends + 1) / (n + 2))
    for k, t in enumerate(texts):
        if all(w in spelt for w in (t or "").split()):
            assert np.isclose(got[k]["score"], sum(word(w) for w in (t or "").split()) + end, atol=1e-3)
