"""Traversals of tables with parallel edges."""

from orrery.operators import graph
from orrery.plans import registry


def test_parallel_edges_change_nothing_and_are_not_made_distinct(spark):
    kind = "src string, edge_type string, dst string, weight double"
    once = [("s", "T", "a", 0.5), ("a", "T", "b", 0.5), ("s", "U", "b", 0.1), ("b", "T", "c", 1.0)]
    more = [*once, ("s", "T", "a", 0.9), ("a", "U", "b", 0.2), ("s", "T", "a", 0.5), ("b", "T", "c", 1.0)]
    seeds = spark.createDataFrame([("s",)], "name string")
    hop = lambda e, n: sorted(tuple(r) for r in graph.k_hop(seeds, spark.createDataFrame(e, kind), n).collect())
    for n in (1, 2, 3):
        assert hop(more, n) == hop(once, n)
    best = {r.name: (round(r.score, 6), r.hops, r.path) for r in graph.traverse(seeds, spark.createDataFrame(more, kind), 2, 0.5).collect()}
    assert best == {"a": (0.45, 1, ["s", "a"]), "b": (0.1125, 2, ["s", "a", "b"]), "c": (0.025, 2, ["s", "b", "c"])}
    # All edges were made distinct before the join; now only what they reach is.
    plan = graph.k_hop(seeds, spark.createDataFrame(more, kind), 1)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [src" in line]


def test_edges_once(spark, sf):
    all_, once = (registry.edges(spark, sf, x) for x in (False, True))
    pairs = lambda df: df.where("edge_type IN ('CONTAINS', 'SUPPLIED_BY')").select("src", "edge_type", "dst")
    assert pairs(once).count() == pairs(once).distinct().count() == pairs(all_).distinct().count() < pairs(all_).count()
