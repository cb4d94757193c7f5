"""Queries that must be over whole tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from sitemill.plans import registry
from sitemill.plans.base import Corpus

ROOT = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the driver's tables")


def both(spark, name):
    con = duckdb.connect()
    for f in os.listdir(ROOT):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{ROOT}/{f}'")
    got = [tuple(r) for r in registry.queries()[name](spark, ROOT).collect()]
    assert sorted(got) == sorted(con.execute(registry.oracle_sql()[name]).fetchall())
    return got


def test_title_containment_has_every_item(spark):
    got = both(spark, "str_title_containment")
    assert {r[1] for r in got} - set(range(8))


def test_graph_digest_is_of_every_edge(spark, monkeypatch):
    whole = both(spark, "agg_graph_digest")
    edges = Corpus.edges
    monkeypatch.setattr(Corpus, "edges", property(lambda self: edges.__get__(self, Corpus).withColumn("n", F.col("n") + (F.col("a") == "9").cast("int"))))
    assert registry.queries()["agg_graph_digest"](spark, ROOT).collect()[0][0] != whole[0][0]
