"""The pipeline: each stage's effect on its own input against brute force, and on odd rows and empty tables."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from sitemill.llm import decontaminate, pii, toxicity
from sitemill.llm.common import Scratch

ROOT = "/root/testdata/sf0.001"


def similar(a, b, k=5):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else {()})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the driver's tables")
def test_stages_take_effect(spark):
    """Kept rows of every stage, one by one: scores of single texts, similarities of all pairs, every offset of every item, patterns, copies by source."""
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    bench = {(r["item_id"], r["text"]) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()}
    kept = docs
    for name, stage in P.STAGES:
        before = kept.collect()
        out = stage(spark, kept, ROOT)
        rows = out.collect()
        ids = {r["doc_id"] for r in rows}
        if name != "source_mixing":
            assert out.columns == docs.columns
            kept = spark.createDataFrame(rows, docs.schema)
        if name == "toxicity":
            field = toxicity.fit(docs, spark.read.parquet(f"{ROOT}/labels.parquet"))
            odds = field.odds()
            assert ids == {r["doc_id"] for r in before if toxicity._scored([r["text"] or ""], field, odds)[0][0] < 0.5} and len(ids) < len(before)
        if name == "simhash_near_dedup":
            texts, label = {r["doc_id"]: r["text"] for r in before}, {r["doc_id"]: r["doc_id"] for r in before}
            order = sorted(texts)
            for i, a in enumerate(order):
                for b in order[i + 1 :]:
                    if label[a] != label[b] and similar(texts[a], texts[b]) >= 0.8:
                        lo, hi = sorted((label[a], label[b]))
                        label = {k: lo if x == hi else x for k, x in label.items()}
            assert ids == {k for k, x in label.items() if k == x} and len(ids) < len(before)
        if name == "decontamination":
            def hit(text):
                t = decontaminate.tokens(text)
                for _, item in bench:
                    own = decontaminate.tokens(item)
                    for at in range(1 - len(own), len(t)) if len(own) >= 8 else ():
                        same = [0 <= at + k < len(t) and t[at + k] == w for k, w in enumerate(own)]
                        n = min(13, len(own))
                        if sum(same) >= 0.8 * n and any(sum(same[x:y]) >= 0.8 * (y - x) - 1e-9 for x in range(len(own)) for y in range(x + n, len(own) + 1)):
                            return True
                return False

            assert ids == {r["doc_id"] for r in before if not hit(r["text"])}
        if name == "personal_data":
            assert pii.find(kept).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
            pieces = {r["doc_id"]: re.split(r"<(?:EMAIL|IP|CARD|PHONE)>", r["text"]) for r in rows}
            for r in before:  # what is left of a text is in it, in order
                at = 0
                for x in pieces[r["doc_id"]]:
                    assert (at := r["text"].find(x, at)) >= 0
                    at += len(x)
        if name == "source_mixing":
            taken = {}
            for r in rows:
                taken.setdefault(r["doc_id"], []).append(r["copy"])
            assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= 3 for c in taken.values()) and set(taken) <= {r["doc_id"] for r in before}
    assert [tuple(r) for r in P.run(spark, ROOT).orderBy("doc_id", "copy").collect()] == sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[-1]))


def _written(spark, path, docs, labels, bench):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_odd_rows_and_clashing_names(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    long, passage = text(30000), text(30)
    rows = [(k, text(60), "en", f"s{k % 3}") for k in range(20)]
    rows += [(100, None, None, None), (101, "", "en", "s1"), (102, " \n ", "en", "s1"), (103, long, "en", "s2"), (104, long + " x", "en", "s2"), (105, f"{text(20)} {passage} {text(5)}", "en", "s0"), (106, f"write to a.b@example.com {text(20)}", "en", "s0")]
    rows += [rows[3], (None, text(50), None, None), (None, None, None, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("n_chars", "node", "key", "k", "copies", "hit_id", "gone_id", "component_id", "a.b"):
        docs = docs.withColumn(name, F.lit(7).cast("long"))
    root = _written(spark, tmp_path / "odd", docs, spark.createDataFrame([(None, None), (3, None)], "doc_id long, toxic int"), spark.createDataFrame([(1, passage), (None, text(20)), (2, None), (3, "w1")], "item_id long, text string"))
    out = P.run(spark, root)
    assert out.columns == [*docs.columns, "copy"]
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    # of the three blank texts one may be left, of the two long ones the first; the passage's document is gone
    assert not {101, 102, 104, 105} & set(got) and set(got) <= {r[0] for r in rows} and "example.com" not in got.get(106, "")
    kept = P.drop_near_duplicates(spark, docs, root).collect()
    assert {r["doc_id"] for r in kept} == {*range(20), 100, 103, 105, 106, None} and sum(r["doc_id"] == 3 for r in kept) == 2 and [r["text"] for r in kept if r["doc_id"] == 103] == [long]


def test_empty_tables(spark, tmp_path):
    empty = lambda schema: spark.createDataFrame([], schema)
    root = _written(spark, tmp_path / "none", empty("doc_id long, text string, lang string, source string, n_chars long"), empty("doc_id long, toxic int"), empty("item_id long, text string"))
    assert P.run(spark, root).collect() == []


def test_tables_of_stages_are_deleted_when_they_are_spent(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k} of words", "en", "s") for k in range(10)], "doc_id long, text string, lang string, source string")
    root = _written(spark, tmp_path / "few", docs, spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], "item_id long, text string"))
    monkeypatch.setattr("sitemill.llm.common.shared_folder", lambda spark: f"file://{tmp_path}/shared")
    with Scratch.made() as made:
        P.run(spark, root).collect()
    left = {p.name.split("-")[1] for p in (tmp_path / "shared").iterdir() if any(p.iterdir())}
    assert len(made) > 5 and left == {"pipeline", "mix"} and len(list((tmp_path / "shared").glob("sitemill-pipeline-*/*"))) == 1
