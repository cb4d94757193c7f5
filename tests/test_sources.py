"""Slices of shards whose bounds aren't keys' bounds, and exports that no task holds whole."""

import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameReader

from sitemill.plans import registry
from sitemill.sources import files


@pytest.mark.parametrize("n", [1, 2, 6, 7, 9, 10])
def test_slice_of_a_table_that_four_does_not_divide(spark, tmp_path, n):
    spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(tuple(r) for r in registry.queries()["src_lazy_slice"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(registry.oracle_sql()["src_lazy_slice"]).fetchall())


def test_exports_are_written_in_parts_and_read_as_streams(spark, tmp_path, monkeypatch):
    form = DataFrameReader.format
    monkeypatch.setattr(DataFrameReader, "format", lambda self, name: pytest.fail("a file as one row") if name == "binaryFile" else form(self, name))
    frame = spark.range(0, 5000, 1, 4).select(F.format_string("%06d", (F.col("id") * 7919) % 5000).alias("a"), F.col("id").alias("b"))
    wide = []
    keep = files.write_text
    monkeypatch.setattr(files, "write_text", lambda lines, path: (wide.append("Range" in str(lines._jdf.queryExecution().optimizedPlan()) and lines._jdf.queryExecution().toString().count("RepartitionByExpression")), keep(lines, path)))
    at = f"file://{tmp_path}/x"
    m = files.export({"rank": frame, "none": frame.where("false")}, at, {})
    data = (tmp_path / "x" / "rank.jsonl").read_bytes()
    rows = [json.loads(x) for x in data.splitlines()]
    assert [r["a"] for r in rows] == [f"{k:06d}" for k in range(5000)] and not any(wide)
    assert m["counts"] == {"rank": 5000, "none": 0} and m["files"]["rank.jsonl"] == hashlib.sha256(data).hexdigest() and m["files"]["none.jsonl"] == hashlib.sha256(b"").hexdigest()
    assert files.verify_export(spark, at) == []
    (tmp_path / "x" / "rank.jsonl").write_bytes(data[:-1])
    assert files.verify_export(spark, at) == ["rank.jsonl has another digest"]


def test_windows_are_aligned_once(spark):
    df = registry.queries()["str_resolve"](spark, "/root/testdata/sf0.001")
    assert "TARGETCIT" not in df._jdf.queryExecution().optimizedPlan().toString() and df.count()


def test_best_of_vectors_are_exact_and_few_leave_a_task(spark):
    import numpy as np
    from sitemill.operators import scorers

    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (300, 5)).astype(float) + 0.5
    x[200:] = x[:100]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, y array<double>").repartition(3)
    q = spark.createDataFrame([(k, x[k].tolist()) for k in range(0, 300, 20)], "query long, x array<double>")
    dot = lambda a, b: sum((p * r for p, r in zip(a.tolist(), b.tolist())), 0.0)
    want = {(k, i + 1, j) for k in range(0, 300, 20) for i, j in enumerate(sorted(range(300), key=lambda j: (-dot(x[k], x[j]), j))[:7])}
    for most in (1 << 20, 200):
        df = scorers.top_k(q, v, 7, most)
        assert {(r["query"], r["rank"], r["id"]) for r in df.collect()} == want
        assert "NestedLoopJoin" not in df._jdf.queryExecution().executedPlan().toString()
