"""Vectors of nodes come from whole walks."""

from sitemill.operators import graph


def test_vectors_are_of_ten_walks_of_forty_nodes(spark, monkeypatch):
    asked, paths = [], graph.paths
    monkeypatch.setattr(graph, "paths", lambda edges, length, per_node, *more: (asked.append((length, per_node)), paths(edges, 3, 2, *more))[1])
    edges = spark.createDataFrame([("a", "b", 2), ("b", "a", 2), ("b", "c", 1), ("c", "b", 1)], "a string, b string, n long")
    got = {r["word"]: r["vector"] for r in graph.node2vec(edges).collect()}
    assert asked == [(40, 10)] and set(got) == set("abc") and all(len(v) == 128 for v in got.values())
