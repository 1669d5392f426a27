"""Approximate search: compressed tiers with exact rescoring, inverted lists, and small-world graphs."""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators import quantize as Q
from orrery.operators import tiles
from orrery.operators.flat import batch_topk, by_blocks, rank_by, rerank
from orrery.sources import files

# Two tiers ---------------------------------------------------------------------------------------------


@dataclass
class Scorer:
    """Rough scores as products: what stands for rows (of their bytes) and for queries, the metric of their product, and a score of it."""

    metric: str
    rows: Callable[[np.ndarray], np.ndarray]
    queries: Callable[[np.ndarray], np.ndarray] = lambda q: q
    final: Callable[[np.ndarray], np.ndarray] = lambda s: s


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


@by_blocks
def coarse(codes: DataFrame, queries, n: int, score: Scorer, metric: str, tie: str = "row") -> DataFrame:
    """query_id, row, score, rank by codes (row, codes)."""
    ids, q = queries
    shared = codes.sparkSession.sparkContext.broadcast((ids, score.queries(q) if len(q) else q))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tiles.search(batches, lambda batch: (batch.column(0).to_numpy(), score.rows(_codes(batch.column(1))), None), *shared.value, n, score.metric, tie, final=score.final)

    return rank_by(codes.select(F.col(tie).cast("long").alias(tie), "codes").mapInArrow(scan, f"query_id long, {tie} long, score double"), "query_id", n, metric, tie)


def scorer(codec: str, metric: str, book: Q.Codebook | None = None) -> Scorer:
    """Scores of a codec's rows (bytes) for queries."""
    sign = -1.0 if V.higher_is_nearer(metric) else 1.0
    return {
        "f16": lambda: Scorer(metric, lambda data: data.view("<f2").astype(np.float64)),
        "int8": lambda: Scorer(metric, Q.int8_rows),
        # Of bits the squared distance is the number of those that differ.
        "binary": lambda: Scorer("l2", lambda data: np.unpackbits(data, axis=1).astype(np.float64), lambda q: np.unpackbits(np.packbits(q >= 0, axis=1), axis=1).astype(np.float64), lambda s: sign * s),
        "pq": lambda: Scorer(metric, book.decode),
    }[codec]()


def encoded(rows: DataFrame, codec: str, book: Q.Codebook | None = None) -> DataFrame:
    """row, codes of a codec."""
    return Q.with_pq_codes(rows, book) if codec == "pq" else Q.with_codes(rows, codec)


#: Candidates of a query that are listed; more are scored where they are found.
MOST_LISTED = 128


def two_tier(rows: DataFrame, codes: DataFrame, queries: DataFrame, k: int, codec: str, metric: str = "cosine", n: int | None = None, book: Q.Codebook | None = None) -> DataFrame:
    """A scan of codes for n candidates of each query, then their exact scores from rows."""
    n, score = n or V.over_fetch(k), scorer(codec, metric, book)
    if n <= max(k, MOST_LISTED):
        return rerank(coarse(codes, queries, n, score, metric), rows, queries, k, metric)
    beside = codes.select("row", "codes").join(rows.where(F.col("vec").isNotNull()).select("row", "vec"), "row")
    return wide(files.kept(beside, "beside"), queries, k, n, metric, score)


def two_tier_pq(rows: DataFrame, queries: DataFrame, k: int, book: Q.Codebook, metric: str = "cosine", ratio: float | None = None) -> DataFrame:
    return two_tier(rows, encoded(rows, "pq", book), queries, k, "pq", metric, V.over_fetch(k, ratio), book)


def two_tier_f16(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    return two_tier(rows, encoded(rows, "f16"), queries, k, "f16", metric)


def two_tier_columns(rows: DataFrame, query: list[float], k: int, codec: str, metric: str = "cosine", ratio: float | None = None, tie: str = "row") -> DataFrame:
    """int8 or binary codes for one query, in columns: a coarse scan for candidates, exact scores for those."""
    q = V.literal(query)
    rows = rows.where(F.col("vec").isNotNull())
    if codec == "int8":
        coded = rows.withColumn("range", V.int8_scale(F.col("vec"))).withColumn("codes", V.int8_encode(F.col("vec"), F.col("range.scale"), F.col("range.offset")))
        rough = V.score(V.int8_decode(F.col("codes"), F.col("range.scale"), F.col("range.offset")), q, metric)
    elif codec == "binary":
        coded = rows.withColumn("codes", V.sign_bits(F.col("vec")))
        rough = V.binary_score(F.col("codes"), V.sign_bits(q), metric)
    else:
        raise ValueError(f"no such codec: {codec!r}")
    found = coded.withColumn("rough", rough).orderBy(*V.nearest_first("rough", tie, metric)).limit(V.over_fetch(k, ratio))
    best = found.select(tie, "rough", V.score(F.col("vec"), q, metric).alias("score")).orderBy(*V.nearest_first("score", tie, metric)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*V.nearest_first("score", tie, metric))).cast("long"))  # k rows


# Inverted lists ----------------------------------------------------------------------------------------


def lists_for(n: int) -> int:
    return min(max(1, round(math.sqrt(n))), max(1, n))


def probes_for(lists: int) -> int:
    return max(lists // 16, 1)


def fit_lists(rows: DataFrame, lists: int | None = None, seed: int = 11) -> np.ndarray:
    x = Q.sample(rows)
    return Q.kmeans(x, lists or lists_for(rows.count()), seed=seed)


def assign(rows: DataFrame, centroids: np.ndarray, key: str = "row") -> DataFrame:
    """key, vec, list: the nearest centroid by squared distance."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def assigned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = Q.nearest(Q.matrix(batch.column(1)), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.float32())), pa.array(own.astype(np.int32))], names=[key, "vec", "list"])

    return rows.where(F.col("vec").isNotNull()).select(F.col(key).cast("long").alias(key), "vec").mapInArrow(assigned, f"{key} long, vec array<float>, list int")


def write_lists(assigned: DataFrame, path: str) -> None:
    """A folder for each list, so that a search reads only those it probes."""
    assigned.repartition("list").write.partitionBy("list").mode("overwrite").parquet(path)


def probe(centroids: np.ndarray, q: np.ndarray, nprobe: int, metric: str) -> np.ndarray:
    """The nearest lists of each query, by the field's metric."""
    if not len(q):
        return np.zeros((0, 0), int)
    s = q @ centroids.T
    key = (centroids * centroids).sum(axis=1)[None, :] - 2 * s if metric == "l2" else -s
    return np.argsort(key, axis=1, kind="stable")[:, : min(nprobe, centroids.shape[0])]


@by_blocks
def ivf_search(assigned: DataFrame, centroids: np.ndarray, queries, k: int, nprobe: int, metric: str = "cosine", tie: str = "row") -> DataFrame:
    """Exact scores in the probed lists only."""
    ids, q = queries
    near = probe(centroids, q, nprobe, metric)
    wanted = sorted({int(x) for x in near.ravel()})
    shared = assigned.sparkSession.sparkContext.broadcast((ids, q, near))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, near = shared.value
        return tiles.search(batches, lambda batch: (batch.column(0).to_numpy(), Q.matrix(batch.column(1)), batch.column(2).to_numpy()), ids, q, k, metric, tie, near)

    found = assigned.where(F.col("list").isin(wanted)).select(tie, "vec", "list").mapInArrow(scan, f"query_id long, {tie} long, score double")
    return rank_by(found, "query_id", k, metric, tie)


def residual_book(assigned: DataFrame, centroids: np.ndarray, parts: int = 8, tie: str = "row") -> Q.Codebook:
    """A codebook of what rows differ from their centroid, fitted on a bounded sample by a hash of the row."""
    shared = assigned.sparkSession.sparkContext.broadcast(centroids)

    def less(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left = (Q.matrix(batch.column(1)) - shared.value[batch.column(2).to_numpy()]).astype(np.float32)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(left.ravel()), left.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[tie, "vec"])

    return Q.train_pq(Q.sample(assigned.select(tie, "vec", "list").mapInArrow(less, f"{tie} long, vec array<float>"), key=tie), parts)


def residual_codes(assigned: DataFrame, centroids: np.ndarray, book: Q.Codebook, tie: str = "row") -> DataFrame:
    """row, codes, list: written once, at build, and read by every search."""
    shared = assigned.sparkSession.sparkContext.broadcast((centroids, book))

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, book = shared.value
        for batch in batches:
            if batch.num_rows:
                codes = book.encode(Q.matrix(batch.column(1)) - centroids[batch.column(2).to_numpy()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(2)], names=[tie, "codes", "list"])

    return assigned.select(tie, "vec", "list").mapInArrow(encoded, f"{tie} long, codes binary, list int")


@by_blocks
def code_search(coded: DataFrame, centroids: np.ndarray, book: Q.Codebook, queries, n: int, nprobe: int, metric: str = "cosine", tie: str = "row") -> DataFrame:
    """query_id, row, score, rank: the n best of the probed lists by codes (row, codes, list).

    A row's rough score is that of its centroid and its coded difference, so that lists can be compared.
    """
    ids, q = queries
    near = probe(centroids, q, nprobe, metric)
    shared = coded.sparkSession.sparkContext.broadcast((ids, q, near, centroids, book))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, near, centroids, book = shared.value
        return tiles.search(batches, lambda batch: (batch.column(0).to_numpy(), centroids[batch.column(2).to_numpy()] + book.decode(_codes(batch.column(1))), batch.column(2).to_numpy()), ids, q, n, metric, tie, near)

    found = coded.where(F.col("list").isin(sorted({int(x) for x in near.ravel()}))).select(tie, "codes", "list").mapInArrow(scan, f"query_id long, {tie} long, score double")
    return rank_by(found, "query_id", n, metric, tie)


def coded_lists_search(assigned: DataFrame, coded: DataFrame, centroids: np.ndarray, book: Q.Codebook, queries: DataFrame, k: int, n: int, nprobe: int, metric: str = "cosine", tie: str = "row") -> DataFrame:
    """The k nearest by exact scores (assigned: row, vec) of n candidates in the probed lists by codes (row, codes, list)."""
    rows = assigned.where(F.col("vec").isNotNull()).select(tie, "vec")
    if n <= max(k, MOST_LISTED):
        return rerank(code_search(coded, centroids, book, queries, n, nprobe, metric, tie), rows, queries, k, metric, tie)
    beside = coded.select(tie, "codes", "list").join(rows, tie).select(tie, "codes", "vec", "list").sortWithinPartitions("list")
    return wide(files.kept(beside, "beside"), queries, k, n, metric, Scorer(metric, book.decode), centroids, nprobe, tie)


def ivfpq_search(assigned: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, nprobe: int, parts: int = 8, metric: str = "cosine", tie: str = "row", n: int | None = None) -> DataFrame:
    """Candidates by codes of residuals in the probed lists, then exact scores. For tables that keep no codes; an index keeps them."""
    book = residual_book(assigned, centroids, parts, tie)
    return coded_lists_search(assigned, residual_codes(assigned, centroids, book, tie), centroids, book, queries, k, n or V.over_fetch(k), nprobe, metric, tie)


# Many candidates ---------------------------------------------------------------------------------------

#: Steps of a query's rough scores that are counted.
STEPS = 512


def wide(beside: DataFrame, queries: DataFrame, k: int, n: int, metric: str, score: Scorer, centroids: np.ndarray | None = None, nprobe: int = 0, tie: str = "row") -> DataFrame:
    """query_id, row, score, rank: the k nearest by exact scores of at least n candidates of each query by rough ones.

    beside: row, codes, vec (and list). Rows are counted by steps of their rough scores, from which follows the score that n of them
    reach; in a second scan those that reach it are scored where they are found, so candidates are never listed. All of the last step come along.
    """
    most = float(beside.mapInArrow(_lengths(beside, score, centroids), "most double").agg(F.max("most")).first()[0] or 0.0)
    limits = _limits(beside, queries, n, metric, score, most, centroids, nprobe, tie)
    # The limit goes with its query as a last component.
    limited = files.kept(queries.select("query_id", "vec").join(limits, "query_id").select("query_id", F.concat(F.col("vec").cast("array<double>"), F.array("limit")).alias("vec")), "limited")
    return _within(beside, limited, k, metric, score, centroids, nprobe, tie)


def _rough(score: Scorer, centroids: np.ndarray | None) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray | None]]:
    """Of a batch (row, codes, vec or not, list last if there are lists): what stands for its rows, and their lists."""

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray | None]:
        x = score.rows(_codes(batch.column(1)))
        if centroids is None:
            return x, None
        lists = batch.column(batch.num_columns - 1).to_numpy()
        return centroids[lists] + x, lists

    return read


def _lengths(beside: DataFrame, score: Scorer, centroids: np.ndarray | None):
    shared = beside.sparkSession.sparkContext.broadcast(centroids)

    def longest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _rough(score, shared.value)
        most = max((float(np.sqrt((x * x).sum(axis=1)).max()) for x, _ in (read(b) for b in batches if b.num_rows)), default=0.0)
        yield pa.RecordBatch.from_arrays([pa.array([most])], names=["most"])

    return longest


def _ranges(q: np.ndarray, most: float, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """For each query between which keys (lower is nearer) those of rows of at most that length lie."""
    own = np.sqrt((q * q).sum(axis=1))
    low, high = (-own * most, own * most) if V.higher_is_nearer(metric) else (np.maximum(own - most, 0) ** 2, (own + most) ** 2)
    return low, np.maximum(high, low + 1e-9)


@by_blocks
def _limits(beside: DataFrame, queries, n: int, metric: str, score: Scorer, most: float, centroids: np.ndarray | None, nprobe: int, tie: str) -> DataFrame:
    """query_id, limit: a key that at least n rows of those seen reach, or all."""
    ids, q = queries
    near = None if centroids is None else probe(centroids, q, nprobe, metric)
    q = score.queries(q) if len(q) else q
    shared = beside.sparkSession.sparkContext.broadcast((ids, q, near, centroids))

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, near, centroids = shared.value
        if not ids.size:
            return
        read, probed = _rough(score, centroids), None if near is None else tiles.Probed(near)
        low, high = _ranges(q, most, score.metric)
        counts = np.zeros((ids.size, STEPS), np.int32)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, lists = read(batch)
            for at, own in tiles.plain(ids.size, len(x)) if probed is None else probed.tiles(lists):
                key = tiles.keys(q[at], x[own], score.metric)
                step = ((key - low[at, None]) * (STEPS / (high - low)[at, None])).astype(np.int32)
                step = np.clip(step, 0, STEPS - 1, out=step) + np.arange(at.size, dtype=np.int32)[:, None] * STEPS
                counts[at] += np.bincount(step.ravel(), minlength=at.size * STEPS).reshape(at.size, STEPS).astype(np.int32)
        for a in range(0, ids.size, 256):
            own = counts[a : a + 256]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 256]), pa.array([c.tobytes() for c in own], pa.binary())], names=["query_id", "counts"])

    def merged(table: pa.Table) -> pa.Table:
        own, place = np.unique(table.column("query_id").to_numpy(), return_inverse=True)
        total = np.zeros((own.size, STEPS), np.int64)
        for batch, at in zip(table.to_batches(256), np.split(place, np.cumsum([b.num_rows for b in table.to_batches(256)])[:-1]), strict=True):
            np.add.at(total, at, np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.int32).reshape(-1, STEPS))
        ids, q, _, _ = shared.value
        low, high = _ranges(q[np.searchsorted(ids, own)], most, score.metric)
        at = np.minimum((np.cumsum(total, axis=1) < n).sum(axis=1), STEPS - 1)
        # A step's end is reached by all in it; the last has no end.
        limit = np.where(at == STEPS - 1, np.inf, low + (at + 1) * (high - low) / STEPS + 1e-9 * (high - low))
        return pa.table({"query_id": pa.array(own), "limit": pa.array(limit)})

    names = [tie, "codes"] if centroids is None else [tie, "codes", "list"]
    steps = beside.select(*names).mapInArrow(counted, "query_id long, counts binary")
    return steps.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(64))).groupBy("part").applyInArrow(merged, "query_id long, limit double")


@by_blocks
def _within(beside: DataFrame, queries, k: int, metric: str, score: Scorer, centroids: np.ndarray | None, nprobe: int, tie: str) -> DataFrame:
    """The k nearest by exact scores of the rows whose rough key is within the limit, a query's last component."""
    ids, both = queries
    q, limit = both[:, :-1], both[:, -1] if len(both) else np.zeros(0)
    near = None if centroids is None else probe(centroids, q, nprobe, metric)
    shared = beside.sparkSession.sparkContext.broadcast((ids, q, limit, near, centroids))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, limit, near, centroids = shared.value
        if not ids.size:
            return
        read, probed, rough = _rough(score, centroids), None if near is None else tiles.Probed(near), score.queries(q)
        best = tiles.Best(ids.size, k, metric)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, vec, (x, lists) = batch.column(0).to_numpy(), Q.matrix(batch.column(2)), read(batch)
            for at, own in tiles.plain(ids.size, rows.size) if probed is None else probed.tiles(lists):
                best.offer(at, q[at], rows[own], vec[own], tiles.keys(rough[at], x[own], score.metric) <= limit[at, None])
        yield from best.answers(ids, tie)

    found = beside.mapInArrow(scan, f"query_id long, {tie} long, score double")
    return rank_by(found, "query_id", k, metric, tie)


# Settings by measured recall ---------------------------------------------------------------------------

#: Rows that stand for queries when settings are measured, and the recall aimed at.
TRIALS, AIM = 64, 0.95


def trials(rows: DataFrame, tie: str = "row") -> DataFrame:
    """A bounded number of rows, by a hash, as queries."""
    own = rows.where(F.col("vec").isNotNull()).select(F.col(tie).alias("query_id"), "vec")
    return own.orderBy(F.xxhash64("query_id", F.lit(17)), "query_id").limit(TRIALS)


def _neighbours(rows: DataFrame, tried: DataFrame, k: int, metric: str, tie: str) -> DataFrame:
    """The true k nearest others of the trials: that a row finds itself says nothing of queries."""
    return batch_topk(rows, tried, k + 1, metric, tie=tie).where(F.col("query_id") != F.col(tie)).select("query_id", tie)


def enough(places: DataFrame, aim: float = AIM) -> int | None:
    """places: a row for each true neighbour of the trials, with its place (from 1) in a rough order, or null. The place that reaches the aim."""
    found = sorted(r[0] if r[0] is not None else math.inf for r in places.select("place").collect())  # TRIALS times k at most
    at = found[max(0, math.ceil(aim * len(found)) - 1)] if found else 1
    return None if at == math.inf else int(at)


def probes_by_recall(assigned: DataFrame, centroids: np.ndarray, k: int, metric: str = "cosine", tie: str = "row") -> int:
    """The least number of lists to probe so that the trials find AIM of their true neighbours."""
    tried = trials(assigned, tie).toArrow()
    order = probe(centroids, np.array(tried.column("vec").to_pylist(), np.float64).reshape(tried.num_rows, -1), len(centroids), metric) if tried.num_rows else np.zeros((0, 0), int)
    truth = _neighbours(assigned, assigned.sparkSession.createDataFrame(tried), k, metric, tie).join(assigned.select(tie, "list"), tie)
    place = {(i, int(c)): p + 1 for i, lists in zip(tried.column("query_id").to_pylist(), order, strict=True) for p, c in enumerate(lists)}
    found = sorted(place[r["query_id"], r["list"]] for r in truth.select("query_id", "list").collect())
    return found[max(0, math.ceil(AIM * len(found)) - 1)] if found else 1


def candidates_by_recall(rows: DataFrame, rough: Callable[[DataFrame, int], DataFrame], k: int, metric: str = "cosine", tie: str = "row") -> int:
    """How many rough candidates the trials need to keep AIM of their true neighbours. rough(queries, n): query_id, row, rank."""
    total, tried = max(1, rows.count()), trials(rows, tie)
    truth = _neighbours(rows, tried, k, metric, tie)
    n = V.over_fetch(k)
    while True:
        places = truth.join(rough(tried, n).select("query_id", tie, F.col("rank").alias("place")), ["query_id", tie], "left")
        need = enough(places)
        if need is not None:
            return max(need, k)
        if n >= total:
            return total
        n = min(4 * n, total)


def candidates_by_place(rows: DataFrame, coded: DataFrame, score: Scorer, k: int, metric: str = "cosine", centroids: np.ndarray | None = None, tie: str = "row") -> int:
    """As candidates_by_recall, by codes (row, codes, list if there are centroids): in one scan the rows before each true neighbour are counted."""
    tried = trials(rows, tie).toArrow()
    if not tried.num_rows:
        return k
    names = [tie, "codes"] if centroids is None else [tie, "codes", "list"]
    truth = _neighbours(rows, rows.sparkSession.createDataFrame(tried), k, metric, tie)
    # TRIALS times k rows at most.
    own = truth.join(coded.select(*names), tie).select(*names, "query_id").toArrow().combine_chunks()
    if not own.num_rows:
        return k
    ids, q = tried.column("query_id").to_numpy(), score.queries(np.array(tried.column("vec").to_pylist(), np.float64))
    of = np.array([{int(i): p for p, i in enumerate(ids)}[int(i)] for i in own.column("query_id").to_pylist()])
    x, _ = _rough(score, centroids)(own.select(names).to_batches()[0])
    found = (own.column(tie).to_numpy(), of, tiles.pair_keys(q[of], x, score.metric), tiles.slack(q, x)[of])
    shared = coded.sparkSession.sparkContext.broadcast((q, found, centroids))

    def before(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, (row, of, key, slack), centroids = shared.value
        read, counts = _rough(score, centroids), np.zeros(row.size, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, (x, _) = batch.column(0).to_numpy(), read(batch)
            tile = tiles.keys(q, x, score.metric)
            for p in range(row.size):
                far = tile[of[p]] - key[p]
                counts[p] += np.count_nonzero((far < -slack[p]) | ((far <= slack[p]) & (rows < row[p])))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(row.size)), pa.array(counts)], names=["at", "n"])

    places = coded.select(*names).mapInArrow(before, "at long, n long").groupBy("at").agg((F.sum("n") + 1).alias("place"))
    return max(enough(places) or 1, k)


# Small-world graphs ------------------------------------------------------------------------------------


class SmallWorld:
    """A navigable small world in layers, over the rows of one partition."""

    def __init__(self, x: np.ndarray, metric: str, m: int = 16, ef_build: int = 200, seed: int = 5, batch: int = 128):
        """batch: rows that look for neighbours in one snapshot, all at once; 1 inserts row by row."""
        self.x, self.metric, self.m = x.astype(np.float32), metric, m
        rnd = np.random.default_rng(seed)
        self.levels = np.minimum((-np.log(rnd.uniform(1e-12, 1, len(x))) / math.log(m)).astype(int), 12)
        self.near: list[dict[int, list[int]]] = [{} for _ in range(int(self.levels.max(initial=0)) + 1)]
        self.entry = -1
        for at in range(0, len(x), batch):
            rows = range(at, min(at + batch, len(x)))
            if at == 0 or batch == 1:  # a graph to look in comes first
                for row in rows:
                    self._link(row, self._plan(row, ef_build))
            else:
                for row, plan in zip(rows, self._plans(rows, ef_build), strict=True):
                    self._link(row, plan)

    def _far(self, q: np.ndarray, rows: list[int]) -> np.ndarray:
        x = self.x[rows]
        return ((x - q) ** 2).sum(axis=1) if self.metric == "l2" else -(x @ q)

    def _walk(self, q: np.ndarray, starts: list[tuple[float, int]], ef: int, level: int, allowed=None) -> list[tuple[float, int]]:
        """Best first; hidden rows lead on but are not results."""
        seen = {r for _, r in starts}
        heap = list(starts)
        heapq.heapify(heap)
        best = [(-d, -r) for d, r in starts if allowed is None or allowed[r]]
        heapq.heapify(best)
        while heap:
            d, r = heapq.heappop(heap)
            if len(best) >= ef and d > -best[0][0]:
                break
            new = [n for n in self.near[level].get(r, ()) if n not in seen]
            if not new:
                continue
            seen.update(new)
            for dn, n in zip(self._far(q, new).tolist(), new, strict=True):
                if len(best) < ef or dn < -best[0][0]:
                    heapq.heappush(heap, (dn, n))
                    if allowed is None or allowed[n]:
                        heapq.heappush(best, (-dn, -n))
                        if len(best) > ef:
                            heapq.heappop(best)
        return sorted((-d, -r) for d, r in best)

    def _choose(self, found: list[tuple[float, int]], m: int) -> list[int]:
        """Keep a row only if no kept one is nearer to it than the query is; then fill up."""
        rows = [r for _, r in found]
        x = self.x[rows]
        apart = -(x @ x.T) if self.metric != "l2" else (x * x).sum(axis=1)[:, None] - 2 * (x @ x.T) + (x * x).sum(axis=1)[None, :]
        nearest = np.full(len(rows), np.inf, np.float32)  # of the kept ones, to each row
        kept: list[int] = []
        left: list[int] = []
        for i, (d, r) in enumerate(found):
            if len(kept) >= m:
                break
            if nearest[i] < d:
                left.append(r)
            else:
                kept.append(r)
                np.minimum(nearest, apart[i], out=nearest)
        return kept + left[: m - len(kept)]

    def _plan(self, row: int, ef: int) -> list[list[int]]:
        """Neighbours of a row at each level from 0 up, by walks in the graph as it is."""
        if self.entry < 0:
            return []
        q, top = self.x[row], int(self.levels[row])
        at = [(float(self._far(q, [self.entry])[0]), self.entry)]
        high = int(self.levels[self.entry])
        for level in range(high, top, -1):
            at = self._walk(q, at, 1, level)[:1]
        plan = []
        for level in range(min(top, high), -1, -1):
            at = self._walk(q, at, ef, level)
            plan.append(self._choose(at, self.m))
        return plan[::-1]

    def _plans(self, rows: range, ef: int) -> list[list[list[int]]]:
        """Plans of a batch in one snapshot, in which all rows before it are searched by one product of matrices."""
        before = self.x[: rows[0]]
        far = -(self.x[rows] @ before.T)
        if self.metric == "l2":
            far = (self.x[rows] ** 2).sum(axis=1)[:, None] + 2 * far + (before**2).sum(axis=1)[None, :]
        plans = []
        for row, d in zip(rows, far, strict=True):
            plan = []
            for level in range(min(int(self.levels[row]), int(self.levels[self.entry])) + 1):
                there = np.flatnonzero(self.levels[: rows[0]] >= level) if level else np.arange(rows[0])
                best = there[np.argpartition(d[there], ef)[:ef]] if there.size > ef else there
                best = best[np.lexsort((best, d[best]))]
                plan.append(self._choose(list(zip(d[best].tolist(), best.tolist(), strict=True)), self.m))
            plans.append(plan)
        return plans

    def _link(self, row: int, plan: list[list[int]]) -> None:
        top, high = int(self.levels[row]), int(self.levels[self.entry]) if self.entry >= 0 else -1
        for level in range(top + 1):
            own = plan[level] if level < len(plan) else []
            self.near[level][row] = own
            most = self.m * 2 if level == 0 else self.m
            for n in own:
                back = self.near[level].setdefault(n, [])
                back.append(row)
                if len(back) > most:
                    d = self._far(self.x[n], back)
                    self.near[level][n] = self._choose(sorted(zip(d.tolist(), back, strict=True)), most)
        if top > high:
            self.entry = row

    def search(self, q: np.ndarray, k: int, ef: int = 64, allowed: np.ndarray | None = None) -> list[tuple[float, int]]:
        if self.entry < 0 or k <= 0:
            return []
        q = q.astype(np.float32)
        at = [(float(self._far(q, [self.entry])[0]), self.entry)]
        for level in range(int(self.levels[self.entry]), 0, -1):
            at = self._walk(q, at, 1, level)[:1]
        return self._walk(q, at, max(ef, k), 0, allowed)[:k]

    def dump(self) -> bytes:
        out = io.BytesIO()
        edges = [(level, r, n) for level, rows in enumerate(self.near) for r, own in rows.items() for n in own]
        np.savez(out, x=self.x, levels=self.levels, edges=np.array(edges, np.int32).reshape(-1, 3), head=np.array([1, self.m, self.entry]), metric=np.array(self.metric))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> SmallWorld:
        got = np.load(io.BytesIO(data), allow_pickle=False)
        version, m, entry = got["head"].tolist()
        if version != 1 or got["levels"].size != got["x"].shape[0] or entry >= got["x"].shape[0]:
            raise ValueError("the graph does not fit its head")
        self = cls.__new__(cls)
        self.x, self.levels, self.m, self.entry, self.metric = got["x"], got["levels"], m, entry, str(got["metric"])
        self.near = [{} for _ in range(int(self.levels.max(initial=0)) + 1)]
        for r, level in enumerate(self.levels.tolist()):
            for deep in range(level + 1):
                self.near[deep][r] = []
        for level, r, n in got["edges"].tolist():
            self.near[level][r].append(n)
        return self


def build_graphs(rows: DataFrame, metric: str, parts: int, m: int = 16, ef_build: int = 200, tie: str = "row") -> DataFrame:
    """part, rows (keys in the graph's order), graph (binary): a graph for each part, built on its own."""

    def built(table: pa.Table) -> pa.Table:
        table = table.sort_by(tie)
        graph = SmallWorld(Q.matrix(table.column("vec")), metric, m, ef_build)
        return pa.table({"part": table.column("part")[:1], "rows": pa.array([table.column(tie).to_pylist()], pa.list_(pa.int64())), "graph": pa.array([graph.dump()], pa.binary())})

    dealt = rows.where(F.col("vec").isNotNull()).select(F.col(tie).cast("long").alias(tie), "vec", F.pmod(F.xxhash64(tie), F.lit(parts)).cast("int").alias("part"))
    # As many tasks as parts: small parts are not put together, so a task and a file hold few graphs.
    return dealt.repartition(parts, "part").groupBy("part").applyInArrow(built, "part int, rows array<long>, graph binary")


def hidden_by_part(graphs: DataFrame, hidden: DataFrame, tie: str = "row") -> DataFrame:
    """graphs with gone: those of its rows that are hidden (row)."""
    rows = graphs.select("part", F.explode("rows").alias(tie))
    gone = rows.join(hidden.select(F.col(tie)).distinct(), tie).groupBy("part").agg(F.collect_list(tie).alias("gone"))
    return graphs.join(gone, "part", "left")


@by_blocks
def graph_search(graphs: DataFrame, queries, k: int, ef: int = 64, metric: str = "cosine", hidden: DataFrame | None = None, tie: str = "row") -> DataFrame:
    """The k nearest of each part's graph, merged. hidden (row): rows that lead on but are no results."""
    shared = graphs.sparkSession.sparkContext.broadcast(queries)

    def searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for batch in batches:
            for rows, data, gone in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                graph, rows = SmallWorld.load(data.as_py()), rows.values.to_numpy()
                mask = None if not gone.is_valid else ~np.isin(rows, gone.values.to_numpy())
                out = [(i, rows[r], d if metric == "l2" else -d) for i, query in zip(ids.tolist(), q, strict=True) for d, r in graph.search(query, k, ef, mask)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", tie, "score"])

    own = graphs.withColumn("gone", F.lit(None).cast("array<long>")) if hidden is None else hidden_by_part(graphs, hidden, tie)
    return rank_by(own.select("rows", "graph", "gone").mapInArrow(searched, f"query_id long, {tie} long, score double"), "query_id", k, metric, tie)
