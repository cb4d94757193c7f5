"""Resampled means by definition, without a row for each drawn paper."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitemill.operators import stats


def place(draw, i, n):
    return int(hashlib.md5(f"0:{draw}:{i}".encode()).hexdigest()[:8], 16) % n


def test_means_of_resamples_by_definition(spark):
    rows = [("x", f"{k:03d}", k / 7) for k in range(50)] + [("y", f"{k:03d}", float(k % 3) if k % 4 else None) for k in range(20)] + [("z", "a", None)]
    per = spark.createDataFrame(rows, "name string, citing_id string, d double").repartition(3)
    got = {(r["name"], r["draw"]): r["d"] for r in stats.resampled(per, "name", "d", draws=30).collect()}
    assert len(got) == 90
    for name in "xyz":
        own = [r[2] for r in rows if r[0] == name]
        for d in range(30):
            drawn = [v for v in (own[place(d, i, len(own))] for i in range(len(own))) if v is not None]
            assert got[name, d] == (pytest.approx(np.mean(drawn)) if drawn else None)
    assert stats.resampled(per.where("false"), "name", "d").count() == 0


def test_intervals_have_no_row_for_a_drawn_paper(spark):
    rows = spark.range(40).select(F.lit("x").alias("name"), F.col("id").cast("string").alias("citing_id"), (F.col("id") % 5).cast("double").alias("a"), F.lit(1.0).alias("b"))
    for df in (stats.paired(rows), stats.hash_bootstrap(rows, "a")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "explode" not in plan and len(df.collect()) == 1
    order = [int(x) % 5 for x in sorted(map(str, range(40)))]
    means = [np.mean([order[place(d, i, 40)] for i in range(40)]) for d in range(1000)]
    got = stats.hash_bootstrap(rows, "a").first()
    assert (got["lo"], got["hi"]) == pytest.approx((np.quantile(means, 0.025), np.quantile(means, 0.975)))
