"""Judgements that are counted and those that are listed."""

import math

from orrery.operators import flat
from orrery.plans import registry


def test_ndcg_by_hand(spark):
    found = spark.createDataFrame([(1, 1, 1), (1, 5, 2), (1, 6, 3), (1, 7, 4), (2, 9, 1), (3, 3, 1)], "query_id long, doc_id long, rank long")
    grades = spark.createDataFrame([(1, 5, 1), (1, 7, 3), (1, 8, 2), (1, 1, 3), (1, 6, 0), (2, 4, 1), (2, 5, 1), (2, 6, 1)], "query_id long, doc_id long, grade int")
    got = {r.query_id: (round(r.ndcg, 9), round(r.recall, 9)) for r in flat.ndcg(found, grades, 2).collect()}
    at = lambda g, r: (2**g - 1) / math.log2(r + 1)
    assert got == {1: (round(at(1, 1) / (at(3, 1) + at(2, 2)), 9), round(1 / 3, 9)), 2: (0.0, 0.0)}


def test_rows_of_a_label_are_not_paired(spark, sf):
    """The join of queries with all rows of their label grew with the square of the rows."""
    plan = registry.ndcg_at_k(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "JoinInner(label" not in plan.replace(" ", "") and "own_label" in plan
    assert registry.ndcg_at_k(spark, sf).count() == registry.search_queries(spark, sf).count()
