"""Rows that queries deal out between tasks, against the rows of their tables: pools and anchors stay with their paper."""

import os

import pytest

from sitemill.plans import registry

ROOT = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the driver's tables")


def dealt_out(spark, name):
    """Rows written for other tasks, in all exchanges that ran."""
    df = registry.queries()[name](spark, ROOT)
    df.collect()
    seen, total, todo = set(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        elif node.getClass().getSimpleName().startswith("ReusedExchange"):
            continue
        if node.getClass().getSimpleName() == "ShuffleExchangeExec" and node.id() not in seen:
            seen.add(node.id())
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return total


# times the 7,500 rows of lineitem and orders; with pools or anchors dealt out it was 2.5 times to 40 times
@pytest.mark.parametrize(("name", "times"), [("set_distinct_candidates", 1.5), ("win_zscore_pool", 2), ("agg_paper_mean", 2), ("gr_alpha1_identity", 2), ("an_completion_semantic", 2), ("gr_walks", 3), *((n, 3) for n in ("gr_value", "agg_assoc_mean", "jn_assoc_scatter", "agg_categorise", "jn_reciprocal", "sc_sweep", "win_swap_outcome")), *((n, 1.5) for n in ("gr_node_similarity", "gr_null_control", "sc_graph_embedding"))])
def test_rows_dealt_out(spark, name, times):
    assert dealt_out(spark, name) <= times * 7500
