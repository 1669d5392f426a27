"""Tiles, candidates that are scored where they are found, and places counted in one scan, against plain numpy."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.operators import approximate as A
from orrery.operators import flat, tiles
from orrery.operators import quantize as Q


@pytest.fixture(scope="module")
def rows(spark):
    x = np.random.default_rng(2).normal(size=(900, 8)).astype(np.float32)
    x[300:320] = x[7]  # equal vectors tie
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row long, vec array<float>").repartition(4).cache()


def matrix(rows):
    found = sorted(rows.collect(), key=lambda r: r.row)
    return np.array([r.vec for r in found], np.float64)


def queries(rows):
    return rows.where("row % 9 = 7").select(F.col("row").alias("query_id"), "vec")


def batches(x, size):
    for a in range(0, len(x), size):
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, min(len(x), a + size)))], names=["row"])


def test_memory_of_a_scan_does_not_grow_with_queries_times_rows():
    rnd = np.random.default_rng(1)
    x, q = rnd.normal(size=(20_000, 16)), rnd.normal(size=(4096, 16))
    tracemalloc.start()
    out = list(tiles.search(batches(x, 10_000), lambda b: (b.column(0).to_numpy(), x[b.column(0).to_numpy()], None), np.arange(4096), q, 10, "dot", "row"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # the scores of one batch alone are 328 MB
    assert sum(b.num_rows for b in out) == 40_960  # k of each query and task, not of each batch
    got = {i: set() for i in range(4096)}
    for b in out:
        for i, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got[i].add(r)
    for i in range(0, 4096, 511):
        assert got[i] == set(np.argsort(-(x @ q[i]))[:10].tolist())


@pytest.mark.parametrize("metric", ["dot", "l2"])
@pytest.mark.parametrize("tile", [64, 1 << 19])
def test_equal_vectors_tie_in_any_tile(spark, rows, metric, tile):
    x, q = matrix(rows), matrix(rows)[7:300:9]
    held = (tiles.TILE, tiles.MOST_HELD)
    try:
        for tiles.TILE, tiles.MOST_HELD in ((tile, held[1]), (tile, 50)):
            out = pa.Table.from_batches(tiles.search(batches(x, 77), lambda b: (b.column(0).to_numpy(), x[b.column(0).to_numpy()], None), np.arange(len(q)), q, 12, metric, "row")).to_pylist()
            for i in range(len(q)):
                key = np.cumsum(-(q[i] * x) if metric == "dot" else (q[i] - x) ** 2, axis=1)[:, -1]
                own = sorted(((r["score"] * (-1 if metric == "dot" else 1), r["row"]) for r in out if r["query_id"] == i))[:12]
                assert own == [(key[r], r) for r in np.lexsort((np.arange(len(x)), key))[:12]]
    finally:
        tiles.TILE, tiles.MOST_HELD = held


@pytest.mark.parametrize("metric", ["dot", "l2"])
@pytest.mark.parametrize("codec", ["f16", "int8", "binary", "pq"])
def test_many_candidates_are_not_listed_and_none_is_lost(spark, rows, codec, metric):
    book = Q.train_pq(Q.sample(rows), 4, 5) if codec == "pq" else None
    codes, score, qs = A.encoded(rows, codec, book).cache(), A.scorer(codec, metric, book), queries(rows)
    n = 200
    listed = flat.rerank(A.coarse(codes, qs, n, score, metric), rows, qs, 10, metric)
    found = A.two_tier(rows, codes, qs, 10, codec, metric, n, book)
    assert "vec" not in found.columns and n > A.MOST_LISTED
    best = lambda df: {(r.query_id, r["rank"]): r.score for r in df.collect()}
    a, b = best(listed), best(found)
    sign = 1 if metric == "dot" else -1
    assert a.keys() == b.keys() and all(sign * (b[k] - a[k]) >= -1e-9 for k in a)
    # All rows as candidates: exact.
    whole = {(r.query_id, r["rank"], r.row) for r in A.two_tier(rows, codes, qs, 10, codec, metric, 900, book).collect()}
    assert whole == {(r.query_id, r["rank"], r.row) for r in flat.batch_topk(rows, qs, 10, metric).collect()}


def test_places_are_counted_as_they_are_listed(spark, rows):
    for codec in ("binary", "int8", "pq"):
        book = Q.train_pq(Q.sample(rows), 4, 5) if codec == "pq" else None
        codes, score = A.encoded(rows, codec, book).cache(), A.scorer(codec, "dot", book)
        assert A.candidates_by_place(rows, codes, score, 10, "dot") == A.candidates_by_recall(rows, lambda q, n: A.coarse(codes, q, n, score, "dot"), 10, "dot")  # noqa: B023
    centroids = A.fit_lists(rows, 12)
    assigned = A.assign(rows, centroids).cache()
    book = A.residual_book(assigned, centroids, 4)
    codes = A.residual_codes(assigned, centroids, book).cache()
    n = A.candidates_by_recall(assigned, lambda q, n: A.code_search(codes, centroids, book, q, n, 12, "l2"), 10, "l2")
    assert A.candidates_by_place(assigned, codes, A.Scorer("l2", book.decode), 10, "l2", centroids) == n
    qs = queries(rows)
    answers = lambda n: {(r.query_id, r["rank"], r.row) for r in A.coded_lists_search(assigned, codes, centroids, book, qs, 10, n, 5, "l2").collect()}
    assert answers(900) == {(r.query_id, r["rank"], r.row) for r in A.ivf_search(assigned, centroids, qs, 10, 5, "l2").collect()}
