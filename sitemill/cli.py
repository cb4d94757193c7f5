"""Command line: build, evaluate and analyse a folder of tables, and move bundles."""

from __future__ import annotations

import argparse
import importlib.util
import shutil
import sys

#: Verbs and the queries that they run.
VERBS = {
    "ingest": ("an_validate_corpus",),
    "embed": ("sc_embed",),
    "sweep": ("sc_sweep", "warn_boundary"),
    "retrieve": ("an_retrieve", "agg_recall_cutoffs"),
    "walks": ("gr_walks", "gr_word2vec"),
    "build pipeline": ("an_build_pipeline",),
    "build graph": ("an_build_graph",),
    "build embed-inputs": ("an_embed_inputs",),
    "build export": ("sink_export", "an_verify_export"),
    "build completion-inputs": ("sink_completion_task",),
    "eval rank": ("an_primary_result", "an_rank_gates", "agg_coverage_strata"),
    "eval swap": ("an_swap",),
    "eval controls": ("an_controls",),
    "eval all": ("an_primary_result", "an_rank_gates", "agg_coverage_strata", "an_swap", "an_controls"),
    "exp completion": ("an_completion",),
    "exp influence": ("an_influence",),
    "exp anchors": ("an_anchor_analysis", "agg_anchor_map"),
    "exp proximity": ("an_proximity", "an_proximity_tiers"),
    "exp theta": ("an_theta", "agg_theta_composition"),
    "exp hard-easy": ("an_hard_easy",),
    "exp annotation-sample": ("an_annotation_sample", "smp_cell_quotas"),
    "exp annotation-score": ("an_annotation_score", "bs_poststrat"),
}
#: What a verb may end on: the columns that name what fails.
FAILING = {"an_build_pipeline": "failed <> ''", "an_build_graph": "failed <> ''", "an_rank_gates": "passes = false", "an_verify_export": "problems + changed > 0"}


def doctor() -> list[str]:
    """What is there of what the library needs: a line for each, those that lack begin with "no"."""
    out = [f"python {sys.version.split()[0]}"]
    out += [f"{'' if importlib.util.find_spec(n) else 'no '}{n}" for n in ("pyspark", "pyarrow", "pandas", "numpy", "duckdb")]
    return [*out, "java" if shutil.which("java") else "no java"]


def _session(a):
    from pyspark.sql import SparkSession

    make = SparkSession.builder.appName("sitemill")
    for x in a.conf:
        make = make.config(*x.split("=", 1))
    return make.getOrCreate()


def _run(a, names: list[str]) -> int:
    from .plans import registry

    found, bad = registry.queries(), 0
    if lost := [n for n in names if n not in found]:
        print(f"no query {', '.join(lost)}", file=sys.stderr)
        return 2
    spark = _session(a)
    for name in names:
        df = found[name](spark, a.tables)
        if a.out:
            df.write.mode("overwrite" if a.force else "error").format(a.format).save(f"{a.out}/{name}")
            df = spark.read.format(a.format).schema(df.schema).load(f"{a.out}/{name}")
        else:
            df.show(a.rows, truncate=False)
        if a.gates and name in FAILING and not df.where(FAILING[name]).isEmpty():
            print(f"{name}: a gate fails", file=sys.stderr)
            bad = 1
    return bad


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sitemill", description=__doc__, epilog="verbs: " + ", ".join(["list", "run QUERY...", "doctor", "bundle FROM TO FILE...", "fetch FROM TO", "verify FOLDER", *VERBS]))
    p.add_argument("words", nargs="+", metavar="verb", help="a verb, and what it is about")
    p.add_argument("--tables", default="/root/testdata/sf0.001", help="folder of the tables")
    p.add_argument("--out", help="folder for results instead of a printout")
    p.add_argument("--format", default="parquet", choices=["parquet", "json", "csv", "orc"])
    p.add_argument("--force", action="store_true", help="replace results that are there")
    p.add_argument("--rows", type=int, default=50, help="rows to print")
    p.add_argument("--gates", action="store_true", help="end with 1 if a gate fails")
    p.add_argument("--conf", action="append", default=[], metavar="KEY=VALUE", help="setting of the session")
    a = p.parse_args(argv)
    verb, rest = a.words[0], a.words[1:]
    if verb == "doctor":
        found = doctor()
        print("\n".join(found))
        return int(any(x.startswith("no ") for x in found))
    if verb == "list":
        from .plans import registry

        print(*sorted(registry.queries()), sep="\n")
        return 0
    if verb == "run":
        return _run(a, rest)
    if verb in ("bundle", "fetch") or verb == "verify" and rest:
        from .sources import files

        if verb == "verify":
            wrong = files.verify_export(_session(a), rest[0])
            print("\n".join(wrong) or "all files agree")
            return int(bool(wrong))
        print(*(files.fetch(*rest[:2]) if verb == "fetch" else files.bundle(rest[0], rest[1], rest[2:])))
        return 0
    name = " ".join(a.words[:2]) if verb in ("build", "eval", "exp") else verb
    if name == "verify":
        return _run(a, ["an_verify_export", "an_primary_result"])
    if name not in VERBS:
        p.error(f"no verb {name!r}")
    return _run(a, list(VERBS[name]))


if __name__ == "__main__":
    raise SystemExit(main())
