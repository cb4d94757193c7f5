"""Candidate lists of wanted contexts, on tables with orders of more than ten lines."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from sitemill.plans import registry
from sitemill.plans.base import Corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Customer 10 with orders of 21, 11, 1 and 0 lines, a year apart; customer 20 with one order, so without pools."""
    at = str(tmp_path_factory.mktemp("tables"))
    orders = [(1, 10, 2020), (2, 10, 2021), (3, 10, 2022), (4, 10, 2023), (5, 20, 2020)]
    lines = [(o, 100 * o + k, 1, k, *[1.0] * 4, "N", "O", datetime.datetime(2024, 1, 1)) for o, n in ((1, 21), (2, 11), (3, 1), (5, 11)) for k in range(1, n + 1)]
    spark.createDataFrame([(o, c, datetime.datetime(y, 1, 1)) for o, c, y in orders], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{at}/lineitem.parquet")
    return at


def test_wanted_contexts_are_those_of_the_statement(spark, folder):
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in registry.queries()["src_prefetch"](spark, folder).collect())
    assert [r[0] for r in got] == ["1_1", "1_11", "1_21", "2_1", "2_11", "3_1"]
    assert got == sorted(con.execute(registry.oracle_sql()["src_prefetch"]).fetchall())


def test_a_wanted_context_without_candidates_is_an_error(spark, folder, monkeypatch):
    pools = Corpus.pools
    for lost, wanted in (("1_2", False), ("2_11", True)):
        monkeypatch.setattr(Corpus, "pools", property(lambda self: pools.__get__(self, Corpus).where(F.col("context_id") != lost)))
        df = registry.queries()["src_prefetch"](spark, folder)
        if wanted:
            with pytest.raises(Exception, match="has no candidates"):
                df.collect()
        else:
            assert len(df.collect()) == 6
