"""Hand-computed values of the text, probe, graph and file operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitemill.functions import probes as P, report, text as T
from sitemill.operators import annotation, graph, pools, scorers, sites, stats
from sitemill.sources import files, validate

H10 = sum(1 / k for k in range(1, 11))


@pytest.mark.parametrize(
    "raw, masked, want",
    [
        ("parallaxes) [4] [5] and Gaia DR2", "parallaxes) OTHERCIT TARGETCIT and Gaia DR2", [("OTHERCIT", "4"), ("TARGETCIT", "5")]),
        ("see [7] here", "see TARGETCIT OTHERCIT here", None),
        ("prior work [12]", "prior work TARGETCIT", [("TARGETCIT", "12")]),
        ("[3] first", "TARGETCIT first", [("TARGETCIT", "3")]),
        ("other words", "no match TARGETCIT", None),
        ("plain", "plain", []),
        ("a [1], [2] b [3]", "a TARGETCIT, OTHERCIT b OTHERCIT", [("TARGETCIT", "1"), ("OTHERCIT", "2"), ("OTHERCIT", "3")]),
    ],
)
def test_markers(spark, raw, masked, want):
    got = spark.createDataFrame([(raw, masked)], "raw string, masked string").select(T.markers_with_numbers(F.col("raw"), F.col("masked")).alias("m")).first()["m"]
    assert (got if got is None else [tuple(x) for x in got]) == want


@pytest.mark.parametrize("between, want", [(", ", "group"), (" and ", "group"), ("] [", "group"), (" as in ", "sentence"), (" works. Then ", "beyond"), (" of Smith et al. and so ", "sentence"), (" ends. ", "beyond")])
def test_tiers(spark, between, want):
    assert spark.createDataFrame([(between,)], "b string").select(T.tier(F.col("b"))).first()[0] == want


def test_shingles_and_easiness(spark):
    d = spark.createDataFrame([("one two three", "deep learning of graphs", ["Yu, Pengqian Graphs"]), ("", "", None)], "t string, title string, authors array<string>")
    r = d.select(T.shingles(F.col("t"), 2).alias("s"), T.shingles(F.col("t"), 4).alias("none"), T.is_easy(F.lit("we learn graphs"), F.col("title"), F.col("authors"), 0.5).alias("easy")).collect()
    assert r[0]["s"] == ["one two", "two three"] and r[0]["none"] == [] and r[0]["easy"] is True and r[1]["s"] == [] and r[1]["easy"] is False


@pytest.mark.parametrize("scores, rr", [([1.0] * 10, H10 / 10), ([2.0, 2.0, 1.0], 0.75), ([1.0, 2.0, 1.0, 1.0], (1 / 2 + 1 / 3 + 1 / 4) / 3)])
def test_expected_reciprocal_rank(spark, scores, rr):
    d = spark.createDataFrame([("c", s, k == 0) for k, s in enumerate(scores)], "context_id string, s double, is_gold boolean")
    got = P.bands(d, "s").select(P.expected_rr(F.col("above"), F.col("tied"))).first()[0]
    assert got == pytest.approx(rr, abs=1e-15)


def test_nan_scores_are_refused(spark):
    d = spark.createDataFrame([("c", 1.0, True), ("c", float("nan"), False)], "context_id string, s double, is_gold boolean")
    with pytest.raises(Exception, match="NaN"):
        P.bands(d, "s").collect()


def test_constant_scores_are_at_the_floor_exactly(spark):
    d = spark.createDataFrame([("c", 1.0, k == 0) for k in range(10)], "context_id string, s double, is_gold boolean")
    got, floor = P.bands(d, "s").select(P.expected_rr(F.col("above"), F.col("tied")), P.harmonic_floor(F.lit(10))).first()
    assert got == floor == 0.2928968253968254


def test_graph_of_three_sites(spark):
    ctx = spark.createDataFrame([("p", 0, "a"), ("p", 0, "b"), ("p", 0, "b"), ("p", 1, "a"), ("p", 1, "b"), ("q", 0, "a"), ("q", 0, "c"), ("q", 1, "d")], "citing_id string, location long, refid string")
    n = {(r["a"], r["b"]): r["n"] for r in graph.cocounts(ctx).collect()}
    assert n == {("a", "b"): 2, ("b", "a"): 2, ("a", "c"): 1, ("c", "a"): 1}
    v = {(r["a"], r["b"]): r["v"] for r in graph.ppmi(graph.cocounts(ctx)).collect()}
    assert v["a", "c"] == pytest.approx(math.log(1 * 6 / (3 * 1)))
    with pytest.raises(ValueError):
        graph.association(graph.cocounts(ctx), "other")


def test_location_labels_by_first_appearance(spark):
    w = spark.createDataFrame([("p", 0), ("p", 1), ("p", 2), ("p", 3)], "grp string, i long")
    pairs = spark.createDataFrame([("p", 1, 3, 1.0)], "grp string, i long, j long, jaccard double")
    assert sorted(tuple(r) for r in sites.location_labels(w, pairs).collect()) == [("p", 0, 0), ("p", 1, 1), ("p", 2, 2), ("p", 3, 1)]
    with pytest.raises(ValueError):
        sites.window_pairs(w, 2, 0.0)


def test_pools_have_gold_and_no_reference_of_the_site(spark):
    ctx = spark.createDataFrame([(f"c{loc}_{k}", "p", f"r{2 * loc + k}", loc) for loc in range(6) for k in range(2)], "context_id string, citing_id string, refid string, location long")
    none = spark.createDataFrame([], "citing_id string, location long, refid string")
    anchored = sites.anchors(ctx, none)
    e = pools.eligibility(anchored, anchored.select("context_id", F.lit(True).alias("aligned")), size=5)
    for r in pools.rank_pools(e, 5).groupBy("context_id", "gold").agg(F.collect_set("candidate").alias("c")).collect():
        loc = int(r["context_id"][1])
        assert len(r["c"]) == 5 and r["gold"] in r["c"] and len({f"r{2 * loc}", f"r{2 * loc + 1}"} & set(r["c"])) == 1
    assert {tuple(r) for r in pools.rank_pools(e.repartition(3), 5).collect()} == {tuple(r) for r in pools.rank_pools(e, 5).collect()}
    assert all(len(r["candidates"]) == 5 for r in pools.rank_pools_python(e, 5).collect())


def test_bootstrap_of_constants_has_no_width():
    assert stats.cluster_ci(np.full(30, 0.5)) == (0.5, 0.5)
    assert all(map(math.isnan, stats.cluster_ci(np.array([]))))
    lo, hi = stats.cluster_ci(np.random.default_rng(0).random(200))
    assert lo < 0.5 < hi


def test_kappa(spark):
    d = spark.createDataFrame([("G", "G")] * 4 + [("G", "S")] + [("S", "S")] * 5, "a string, b string")
    assert stats.kappa(d, "a", "b").first()["kappa"] == pytest.approx((0.9 - 0.5) / 0.5)
    assert stats.kappa(spark.createDataFrame([("G", "G")], "a string, b string"), "a", "b").first()["kappa"] is None


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("x", "a b b"), ("y", "a c")], "id string, text string")
    q = spark.createDataFrame([("q", "b b z")], "query string, text string")
    idf = math.log(1 + (2 - 1 + 0.5) / 1.5)
    want = 2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2.5))
    assert [tuple(r) for r in scorers.bm25(q, docs).collect()] == [("q", "x", pytest.approx(want))]


def test_json_objects_are_read_in_any_buffer(tmp_path):
    data = {f"k{i}": {"text": "a } , { \\ é" * i, "n": [i, -1.5]} for i in range(20)} | {"last": 123456}
    f = tmp_path / "o.json"
    f.write_text(json.dumps(data, ensure_ascii=False))
    for size in (1, 7, 64, 1 << 20):
        assert {k: json.loads(v) for k, v in files.object_items(str(f), size)} == data
    f.write_text("")
    assert list(files.object_items(str(f))) == []
    f.write_text('{"a": 1, "b": {"c"')
    assert list(files.object_items(str(f))) == [("a", "1")]


def test_missing_papers_are_an_error(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id": "1", "title": "t"}\n')
    want = spark.createDataFrame([("1",)], "id string")
    assert tuple(files.read_papers(spark, str(tmp_path), want).first()) == ("1", "t", "", [])
    with pytest.raises(Exception, match="no paper"):
        files.read_papers(spark, str(tmp_path), spark.createDataFrame([("2",)], "id string")).collect()


def test_export_bundle_and_fetch(spark, tmp_path):
    d = spark.createDataFrame([("b", 1), ("a", 2)], "id string, n long")
    files.export({"rows": d}, str(tmp_path / "e"), {})
    assert (tmp_path / "e/rows.jsonl").read_text().splitlines()[0] == '{"id":"a","n":2}'
    assert files.verify_export(spark, str(tmp_path / "e")) == []
    files.bundle(str(tmp_path / "e"), str(tmp_path / "b"), ["rows.jsonl", "manifest.json"])
    assert files.fetch(f"file://{tmp_path}/b", str(tmp_path / "f")) == ["manifest.json", "rows.jsonl"]
    (tmp_path / "b/rows.jsonl").write_text("x")
    with pytest.raises(ValueError):
        files.fetch(str(tmp_path / "b"), str(tmp_path / "g"))
    assert not (tmp_path / "g").exists()
    (tmp_path / "e/rows.jsonl").write_text("x")
    assert files.verify_export(spark, str(tmp_path / "e")) == ["rows.jsonl has another digest"]
    with pytest.raises(ValueError):
        files.bundle(str(tmp_path / "e"), str(tmp_path / "b"), ["rows.jsonl"])
    with pytest.raises(ValueError):
        files.bundle(str(tmp_path / "e"), str(tmp_path / "h"), ["contexts.jsonl"])


def test_fetch_over_http_is_confined(spark, tmp_path):
    import functools
    import http.server
    import threading

    files.export({"rows": spark.createDataFrame([("a", 1)], "id string, n long")}, str(tmp_path / "e"), {})
    files.bundle(str(tmp_path / "e"), str(tmp_path / "b"), ["rows.jsonl", "manifest.json"])

    class Server(http.server.SimpleHTTPRequestHandler):
        def do_GET(self):
            for start, to in (("/moved/", "/"), ("/loop/", "/loop/"), ("/file/", "file:///etc/")):
                if self.path.startswith(start):
                    self.send_response(302)
                    self.send_header("Location", to + self.path[len(start) :])
                    return self.end_headers()
            super().do_GET()

        def log_message(self, *a):
            pass

    httpd = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Server, directory=str(tmp_path / "b")))
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{httpd.server_port}"
    try:
        assert files.fetch(at, str(tmp_path / "f")) == ["manifest.json", "rows.jsonl"]
        assert files.fetch(f"{at}/moved", str(tmp_path / "g")) == ["manifest.json", "rows.jsonl"]
        for bad in ("loop", "file"):
            with pytest.raises(Exception):
                files.fetch(f"{at}/{bad}", str(tmp_path / "h"))
        with pytest.raises(ValueError):
            files.fetch(at, str(tmp_path / "h"), limit=1)
        assert not (tmp_path / "h").exists()
    finally:
        httpd.shutdown()


def test_second_order_walks_go_back_by_the_return_parameter(spark):
    """On a square with one diagonal, the share of third steps that lead back is that of the weights."""
    e = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("a", "c")]
    edges = spark.createDataFrame([(x, y, 1) for x, y in e] + [(y, x, 1) for x, y in e], "a string, b string, n long")
    rows = graph.walks(edges, 3, 600, p=0.25, q=4.0).where("start = 'b'").collect()
    steps = {}
    for r in rows:
        steps.setdefault(r["walk_no"], {})[r["step"]] = r["node"]
    to_a = [x for x in steps.values() if x[1] == "a"]
    # from a, having come from b: back to b 4, to c, which is linked to b, 1, to d, which isn't, 1/4
    share = {n: sum(x[2] == n for x in to_a) / len(to_a) for n in "bcd"}
    assert len(to_a) > 200 and share == pytest.approx({"b": 4 / 5.25, "c": 1 / 5.25, "d": 0.25 / 5.25}, abs=0.07)


def test_paired_comparison_by_hand(spark):
    rows = [("x", p, a, b) for p, a, b in (("1", 1.0, 0.0), ("1", 0.0, 0.0), ("2", 1.0, 1.0), ("3", 1.0, 0.5))] + [("same", "1", 1.0, 1.0)]
    got = {r["name"]: r for r in stats.paired(spark.createDataFrame(rows, "name string, citing_id string, a double, b double")).collect()}
    x = got["x"]
    assert (x["n"], x["papers"], x["a"], x["b"], x["delta"]) == (4, 3, round(2.5 / 3, 6), 0.5, round(1 / 3, 6)) and (x["pool_a"], x["pool_b"], x["pool_delta"]) == (0.75, 0.375, 0.375)
    assert 0 <= x["lo"] <= x["delta"] <= x["hi"] <= 0.5 and not x["excludes_zero"] or x["lo"] > 0
    assert (got["same"]["lo"], got["same"]["hi"], got["same"]["excludes_zero"]) == (0, 0, False)


def test_places_in_an_order_are_told_without_one_task(spark):
    rows = [((k * 7) % 50, k) for k in range(200)]
    got = stats.numbered(spark.createDataFrame(rows, "v long, k long").repartition(5), "v", "k").collect()
    assert [(r["v"], r["k"]) for r in sorted(got, key=lambda r: r["number"])] == sorted(rows) and sorted(r["number"] for r in got) == list(range(200))


def test_partial_best_are_merged(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.standard_normal((60, 4)), 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(str(k), r.tolist()) for k, r in enumerate(x)] + [("60", x[3].tolist())], "id string, y array<double>").repartition(7)
    q = spark.createDataFrame([(k, x[k].tolist()) for k in range(5)], "query long, x array<double>")
    all_ = np.vstack([x, x[3:4]])
    want = {(k, i + 1, str(j)) for k in range(5) for i, j in enumerate(sorted(range(61), key=lambda j: (-round(float(x[k] @ all_[j]), 9), str(j)))[:6])}
    for most in (1 << 20, 64):
        assert {(r["query"], r["rank"], r["id"]) for r in scorers.top_k_blocks(q, v, 6, most).collect()} == want


def test_base_factory_wants_exactly_one(spark):
    d = spark.createDataFrame([("c", [1.0, 0.0]), ("p", [3.0, 4.0])], "key string, x array<double>")
    pools_ = spark.createDataFrame([("c", "p")], "context_id string, candidate string")
    assert scorers.base_factory(embeddings=d)(pools_).first()["base"] == pytest.approx(0.6)
    for bad in ({}, {"embeddings": d, "texts": d}):
        with pytest.raises(ValueError):
            scorers.base_factory(**bad)
    with pytest.raises(Exception, match="missing"):
        scorers.base_factory(embeddings=d.where("key = 'c'"))(pools_).collect()


@pytest.mark.parametrize("words, code", [(["doctor"], 0), (["list"], 0), (["run", "no_such_query"], 2)])
def test_command_line(spark, capsys, words, code):
    from sitemill import cli

    assert cli.main(words) == code
    assert all(set(q) <= set(__import__("sitemill.plans.registry", fromlist=["x"]).queries()) for q in cli.VERBS.values())


def test_all_problems_of_a_corpus_are_listed(spark):
    c = spark.createDataFrame([("1", "p", "r", "x TARGETCIT"), ("1", "p", "r", "x TARGETCIT"), ("2", "p", "gone", " "), ("3", "q", "r", "TARGETCIT TARGETCIT")], "context_id string, citing_id string, refid string, masked string")
    papers = spark.createDataFrame([("r",)], "id string")
    splits = spark.createDataFrame([("1", "train"), ("2", "test"), ("3", "test")], "context_id string, split string")
    got = {tuple(r) for r in validate.validate(c, papers, splits).collect()}
    assert got == {("duplicate_context", "1"), ("unknown_reference", "2"), ("empty_window", "2"), ("targets", "2"), ("targets", "3"), ("split_overlap", "p")}


def test_reports():
    r = {"a.b": {"c": [1, {"d": 2}]}, "a": {"b": 5}}
    assert report.look_up(r, "a.b.c.1.d") == 2 and report.parse("−1,234.50") == (-1234.5, 2) and report.agrees("0.12", 0.1234)
    with pytest.raises(KeyError):
        report.look_up(r, "x")
    good = {"alignment_failure": 0.1, "anchor_coverage": 0.7, "hard_fraction": 0.1, "headline": 3, "leakage": 0}
    assert report.gates(good, custom=True) == [] and len(report.gates(good)) == 2
    assert report.on_edge(0.0, [0.0, 1.0]) and not report.on_edge(0.5, [0.0, 0.5, 1.0])
    assert annotation.quotas(10, [1, 1, 1]) == [4, 3, 3]


def test_stream_equals_batch(spark):
    from sitemill.streaming.cograph import maintained

    ctx = spark.createDataFrame([(f"p{k % 9}", k % 2, f"r{k % 7}") for k in range(200)], "citing_id string, location long, refid string")
    assert {tuple(r) for r in maintained(ctx).collect()} == {tuple(r) for r in graph.cocounts(ctx).collect()}


def test_empty_inputs(spark):
    ctx = spark.createDataFrame([], "context_id string, citing_id string, refid string, location long")
    none = spark.createDataFrame([], "citing_id string, location long, refid string")
    anchored = sites.anchors(ctx, none)
    assert anchored.count() == 0 and pools.swap_pairs(anchored).count() == 0 and graph.ppmi(graph.cocounts(ctx)).count() == 0
    assert graph.walks(graph.cocounts(ctx)).count() == 0
