"""Exact nearest neighbours, merging of sources, rescoring of candidates, and evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce, wraps
from inspect import signature

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators import tiles

#: Queries broadcast at once (at 1024 dimensions 32 MB in doubles); more are taken in blocks, each with its own scan.
MOST_QUERIES = 4096


def visible(rows: DataFrame, allowed: DataFrame | None, key: str = "name") -> DataFrame:
    """Only rows that may be seen: below any ranking, so that k visible rows are still found."""
    return rows if allowed is None else rows.join(allowed.select(key).distinct(), key, "left_semi")


def topk(rows: DataFrame, query: list[float], k: int, metric: str = "cosine", allowed: Column | None = None, vec: str = "vec", tie: str = "row") -> DataFrame:
    """The k nearest rows with score and rank (from 1). Absent vectors are never scored; k = 0 gives none."""
    rows = rows.where(F.col(vec).isNotNull())
    if allowed is not None:
        rows = rows.where(allowed)
    width = F.when(F.size(vec) == len(query), F.col(vec)).otherwise(F.raise_error(F.lit(f"the query has {len(query)} dimensions")))
    scored = rows.withColumn("score", V.score(width, V.literal(query), metric)).drop(vec)
    best = scored.orderBy(*V.nearest_first("score", tie, metric)).limit(max(0, k))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*V.nearest_first("score", tie, metric))).cast("long"))  # k rows


def by_blocks(search: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Gives search(..., queries, ...) its queries as (ids, matrix), in blocks of at most MOST_QUERIES; the answers of all blocks."""
    place = list(signature(search).parameters).index("queries")

    @wraps(search)
    def in_blocks(*args, **named) -> DataFrame:
        args = list(args)
        queries = (args.pop(place) if len(args) > place else named.pop("queries")).select("query_id", "vec")
        call = lambda block: search(*args[:place], block, *args[place:], **named)
        found = queries.limit(MOST_QUERIES + 1).toArrow()
        if found.num_rows <= MOST_QUERIES:
            return call(_matrix(found))
        # Blocks by a hash of the id, three quarters full on average.
        parts = -(-4 * queries.count() // (3 * MOST_QUERIES))
        out = [call(_matrix(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).toArrow())) for i in range(parts)]
        return reduce(DataFrame.unionByName, out)

    return in_blocks


def _matrix(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    found = found.sort_by("query_id")
    q = np.array(found.column("vec").to_pylist(), np.float64)
    return found.column("query_id").to_numpy(), q.reshape(found.num_rows, -1 if found.num_rows else 0)


def rank_by(df: DataFrame, by: str, k: int, metric: str, tie: str) -> DataFrame:
    """Per value of by: the k nearest, with their rank."""
    w = Window.partitionBy(by).orderBy(*V.nearest_first("score", tie, metric))
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


@by_blocks
def batch_topk(rows: DataFrame, queries, k: int, metric: str = "cosine", vec: str = "vec", tie: str = "row", digits: int | None = None) -> DataFrame:
    """query_id, row, score, rank for many queries at once.

    digits: scores are rounded to so many places before they are ranked, so that equal vectors tie whatever the order of sums.

    Products of matrices in tiles; each task holds the k best so far of each query of a block, and only those are
    shuffled. rows: tie (long), vec; queries: query_id (long), vec.
    """
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, None]:
        return batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1), None

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tiles.search(batches, read, *shared.value, k, metric, tie, digits=digits)

    near = rows.where(F.col(vec).isNotNull()).select(F.col(tie).cast("long").alias(tie), vec).mapInArrow(scan, f"query_id long, {tie} long, score double")
    return rank_by(near, "query_id", k, metric, tie)


def merge_sources(found: DataFrame, k: int, metric: str, tie: str = "name") -> DataFrame:
    """found: query_id, source, tie, score of several sources. The k best of all, ties by name then source."""
    w = Window.partitionBy("query_id").orderBy(*V.nearest_first("score", tie, metric), F.col("source"))
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def merge_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("query_id").agg(F.count_if(F.col("source") == "buffer").alias("from_buffer"), F.count_if(F.col("source") != "buffer").alias("from_sealed"))


def rerank(candidates: DataFrame, rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", tie: str = "row") -> DataFrame:
    """candidates: query_id, row, rank. Exact scores of the candidates that have a vector; old_rank beside the new."""
    q = queries.select("query_id", F.col("vec").alias("_query"))
    joined = candidates.select("query_id", tie, F.col("rank").alias("old_rank")).join(rows.where(F.col("vec").isNotNull()).select(tie, "vec"), tie).join(q, "query_id")
    scored = joined.select("query_id", tie, "old_rank", V.score(F.col("vec"), F.col("_query"), metric).alias("score"))
    return rank_by(scored, "query_id", k, metric, tie)


def recall(truth: DataFrame, found: DataFrame, k: int, tie: str = "row") -> DataFrame:
    """recall of each query of truth (query_id, row, rank): the found part of its first k; 1.0 with no truth."""
    t = truth.where(F.col("rank") <= k).select("query_id", tie)
    f = found.where(F.col("rank") <= k).select("query_id", tie, F.lit(1).alias("hit"))
    return t.join(f, ["query_id", tie], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def recall_report(recalls: DataFrame) -> DataFrame:
    return recalls.agg(F.count("*").alias("queries"), F.coalesce(F.avg("recall"), F.lit(1.0)).alias("mean_recall"), F.coalesce(F.min("recall"), F.lit(1.0)).alias("worst_recall"))


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def first_others(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query (query_id, doc_id, rank) without itself, with new ranks."""
    own = found.where(F.col("query_id") != F.col("doc_id"))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id"))).where(F.col("rank") <= k)


def ndcg(found: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """found: query_id, doc_id, rank; grades: query_id, doc_id, grade. ndcg and recall of each judged query; self-matches go first."""
    judged = grades.where((F.col("grade") > 0) & (F.col("query_id") != F.col("doc_id")))
    return ndcg_by_counts(first_others(found, k).join(judged, ["query_id", "doc_id"]), judged.groupBy("query_id", "grade").agg(F.count("*").alias("n")), k)


def ndcg_by_counts(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """hits: query_id, rank (k at most), grade of what was found; relevant: query_id, grade, n. So judgements need not be listed where they can be counted."""
    w = Window.partitionBy("query_id").orderBy(F.col("grade").desc())
    first = relevant.withColumn("_to", F.sum("n").over(w)).withColumn("_from", F.col("_to") - F.col("n") + 1)
    # Places of a grade in the ideal order, as far as k.
    places = F.when(F.col("_from") <= k, F.sequence(F.col("_from"), F.least(F.col("_to"), F.lit(k).cast("long")))).otherwise(F.array().cast("array<bigint>"))
    worth = F.aggregate(places, F.lit(0.0), lambda s, r: s + _gain(F.col("grade"), r))
    ideal = first.groupBy("query_id").agg(F.sum(worth).alias("ideal"), F.sum("n").alias("relevant"))
    got = hits.groupBy("query_id").agg(F.sum(_gain(F.col("grade"), F.col("rank"))).alias("gained"), F.count("*").alias("hits"))
    return ideal.join(got, "query_id", "left").select("query_id", (F.coalesce("gained", F.lit(0.0)) / F.col("ideal")).alias("ndcg"), (F.coalesce("hits", F.lit(0)) / F.col("relevant")).alias("recall"))


def percentiles(times: DataFrame, by: str, value: str) -> DataFrame:
    """Median and 99th percentile by nearest rank, and the rate of one after another (value in milliseconds)."""
    each = times.groupBy(by).agg(F.count("*").alias("n"), F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("p50"), F.expr(f"percentile_disc(0.99) within group (order by {value})").alias("p99"), F.sum(value).alias("total"))
    return each.select(by, "n", "p50", "p99", F.when(F.col("total") > 0, F.col("n") * 1000 / F.col("total")).alias("qps"))
