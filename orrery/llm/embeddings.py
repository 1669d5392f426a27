"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart, and a projection never moves points apart. Vectors are
projected on the leading principal dimensions (fitted on a bounded sample), put into a grid with cells of
that width and sorted by label and cells. The sequence is cut into segments of bounded size; intervals of
segments are joined recursively, skipping those whose boxes lie further apart than the width: intervals of some
hundreds of segments on the driver, segments within two such intervals in a task for each. The
segment pairs that are left are joined block by block, by the same rule, with exact cosines in doubles.
A pair task returns link counts and a spanning forest, never the pairs. Equal vectors are joined once.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a
null label, link with nothing; vectors of different lengths neither. Repeated rows count as vectors of their
own, linked with one another if they are valid. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components, local_roots

COSINE = 0.93
#: Principal dimensions of boxes, and of cells; rows sampled to fit them; rows aimed at in a segment, and in a block of it.
BOX_DIMS, CELL_DIMS, SAMPLE, SEGMENT, BLOCK = 12, 4, 8192, 2048, 256
#: Most ranges that the sequence is dealt to (each is cut into segments); segments in an interval that the driver plans with.
RANGES, INTERVAL = 1 << 16, 256
#: Up to so many segment pairs their list is broadcast (under 2 MB).
BROADCAST_PAIRS = 50_000


def unit(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Valid vectors of length dim as unit rows, in doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def plan_pairs(low: np.ndarray, high: np.ndarray, width: float, first: int | None = None) -> list[tuple[int, int]]:
    """Of boxes low..high, in sequence: pairs (i <= j) within width of one another; given first, only of i < first with j >= first."""
    n = low.shape[0]
    boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in boxes:
            boxes[a, b] = low[a:b].min(axis=0), high[a:b].max(axis=0)
        return boxes[a, b]

    out, stack = [], [(0, n, 0, n) if first is None else (0, first, first, n)]
    while stack:
        a, b, c, d = stack.pop()
        (l1, h1), (l2, h2) = box(a, b), box(c, d)
        gap = np.maximum(0, np.maximum(l1 - h2, l2 - h1))
        if (gap * gap).sum() > width * width:
            continue
        if b - a == 1 and d - c == 1:
            out.append((a, c))
        elif (a, b) == (c, d):
            m = (a + b) // 2
            stack += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            stack += [(a, b, c, m), (a, b, m, d)]
    return out


def join_segments(x: np.ndarray, y: np.ndarray | None, px: np.ndarray, py: np.ndarray | None, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with a cosine of at least that; within x (i < j) if y is None. px, py: projections."""
    width = np.sqrt(2 - 2 * cosine) + 1e-9
    same = y is None
    y, py = (x, px) if same else (y, py)
    ends = [[(i, min(i + BLOCK, len(v))) for i in range(0, len(v), BLOCK)] for v in (x, y)]
    boxes = [[(p[a:b].min(axis=0), p[a:b].max(axis=0)) for a, b in e] for p, e in zip((px, py), ends, strict=True)]
    for k, (a, b) in enumerate(ends[0]):
        for m, (c, d) in enumerate(ends[1]):
            if same and c < a:
                continue
            (l1, h1), (l2, h2) = boxes[0][k], boxes[1][m]
            gap = np.maximum(0, np.maximum(l1 - h2, l2 - h1))
            if (gap * gap).sum() > width * width:
                continue
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= cosine)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            if i.size:
                yield i, j


def _segment_pairs(placed: DataFrame, width: float, ranges: int) -> DataFrame:
    """a, b: segments that may hold near vectors; a = b for a segment with itself. ranges: of the sequence, to an interval."""
    bounds = [(f, f"{name}{k}") for k in range(BOX_DIMS) for name, f in (("l", F.min), ("h", F.max))]
    segments = placed.groupBy("label", "dim", "place", "segment").agg(*[f(F.col("p")[int(c[1:])]).alias(c) for f, c in bounds])
    segments = stored(segments.withColumn("interval", F.floor(F.shiftright("place", 24) / ranges)), "segments")
    own = ["label", "dim"]
    intervals = stored(segments.groupBy(*own, "interval").agg(*[f(c).alias(c) for f, c in bounds]), "intervals")
    # Labels of one interval need no plan.
    alone = intervals.groupBy(*own).agg(F.count("*").alias("n"), F.min("interval").alias("i")).where("n = 1").select(*own, F.col("i").alias("i"), F.col("i").alias("j"))
    several = intervals.join(alone.select(*own), own, "left_anti").toPandas().sort_values([*own, "interval"])
    near = []
    for (label, dim), each in several.groupby(own):
        low, high = (each[[f"{s}{k}" for k in range(BOX_DIMS)]].to_numpy(np.float64) for s in "lh")
        ids = each["interval"].tolist()
        near += [(label, int(dim), ids[i], ids[j]) for i, j in plan_pairs(low, high, width)]
    tasks = stored(alone.unionByName(placed.sparkSession.createDataFrame(near, "label string, dim int, i long, j long")), "tasks")
    one = segments.join(tasks, own).where("interval = i").withColumn("side", F.lit(0))
    other = segments.join(tasks.where("i < j"), own).where("interval = j").withColumn("side", F.lit(1))

    def planned(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("side", "ascending"), ("place", "ascending")])
        low, high = (np.stack([rows.column(f"{s}{k}").to_numpy() for k in range(BOX_DIMS)], axis=1) for s in "lh")
        second = int(np.asarray(rows.column("side").to_numpy()).sum())
        found = np.array(plan_pairs(low, high, width, rows.num_rows - second if second else None), np.int64).reshape(-1, 2)
        ids = rows.column("segment").to_numpy()
        return pa.table({"a": ids[found[:, 0]], "b": ids[found[:, 1]]})

    return one.unionByName(other).groupBy(*own, "i", "j").applyInArrow(planned, "a long, b long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept; a row for each row of vectors (vec_id, embedding, label)."""
    width = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    v = F.col("embedding")
    sound = v.isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    marked = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.when(sound, v).alias("embedding"))
    marked = marked.withColumn("h", F.xxhash64(F.lit(3), "embedding")).withColumn("node", F.when(F.col("embedding").isNotNull(), F.xxhash64("label", "h", "embedding")))
    # A row for each distinct vector of a label.
    distinct = marked.where(F.col("node").isNotNull()).groupBy("node", "h", "label", F.size("embedding").alias("dim")).agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    distinct = stored(distinct.drop("h"), "vectors")
    n = distinct.count()

    bases: dict[int, np.ndarray] = {}
    sample = distinct.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(max(1, n // SAMPLE))) == 0).select("dim", "embedding").limit(2 * SAMPLE).toArrow()
    for dim in set(sample.column("dim").to_pylist()):
        own = sample.filter(pa.compute.equal(sample.column("dim"), dim))
        x = unit(own.column("embedding"), dim)
        bases[dim] = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:BOX_DIMS].T
    shared = distinct.sparkSession.sparkContext.broadcast(bases)

    def base(dim: int) -> np.ndarray:
        found = shared.value.get(dim)
        return np.eye(dim)[:, :BOX_DIMS] if found is None else found

    names = ["node", "label", "dim", "first", "copies", "embedding"]

    def projected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in set(batch.column("dim").to_pylist()):
                own = batch.filter(pa.compute.equal(batch.column("dim"), dim))
                p = np.zeros((own.num_rows, BOX_DIMS))
                q = unit(own.column("embedding"), dim) @ base(dim)
                p[:, : q.shape[1]] = q
                cells = pa.FixedSizeListArray.from_arrays(pa.array(np.floor(p[:, :CELL_DIMS] / width).astype(np.int32).ravel()), CELL_DIMS).cast(pa.list_(pa.int32()))
                boxes = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), BOX_DIMS).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), cells, boxes], names=[*names, "cells", "p"])

    kind = distinct.schema["embedding"].dataType.simpleString()
    placed = distinct.select(*names).mapInArrow(projected, f"node long, label string, dim int, first long, copies long, embedding {kind}, cells array<int>, p array<double>")
    # Sorted by grid cells; each range is a stretch of the sequence, and each label and length in a piece of it a segment.
    count = min(RANGES, max(1, -(-n // SEGMENT)))
    placed = placed.repartitionByRange(count, "label", "dim", "cells", "node").sortWithinPartitions("label", "dim", "cells", "node")
    piece = F.floor(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) / SEGMENT)
    placed = placed.withColumn("place", F.shiftleft(F.spark_partition_id().cast("long"), 24) + piece)
    placed = stored(placed.withColumn("segment", F.xxhash64("place", "label", "dim")), "placed")
    pairs = stored(_segment_pairs(placed, width, max(1, INTERVAL * count * SEGMENT // max(n, count * SEGMENT))), "pairs")
    few = pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    sides = pairs.select("a", "b", F.inline(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("segment"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("a").alias("segment"), F.lit(0).alias("side")), F.struct(F.col("b").alias("segment"), F.lit(1).alias("side"))))))
    dealt = placed.select("segment", "node", "dim", "copies", "embedding", "p").join(F.broadcast(sides) if few else sides, "segment")

    def compared(rows: pa.Table) -> pa.Table:
        dim = rows.column("dim")[0].as_py()
        rows = rows.sort_by([("side", "ascending"), ("node", "ascending")])
        node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        x = unit(rows.column("embedding"), dim)
        p = rows.column("p").combine_chunks().flatten().to_numpy().reshape(-1, BOX_DIMS)
        m = int((rows.column("side").to_numpy() == 0).sum())
        order = np.concatenate([np.lexsort(p[:m].T[::-1]), m + np.lexsort(p[m:].T[::-1])])
        node, copies, x, p = node[order], copies[order], x[order], p[order]
        links, root = np.zeros(node.size, np.int64), np.arange(node.size)
        found = join_segments(x, None, p, None, cosine) if m == node.size else join_segments(x[:m], x[m:], p[:m], p[m:], cosine)
        for i, j in found:
            j = j if m == node.size else j + m
            links += np.bincount(i, copies[j], node.size).astype(np.int64) + np.bincount(j, copies[i], node.size).astype(np.int64)
            a, b = np.concatenate([i, np.arange(node.size)]), np.concatenate([j, root])
            root = local_roots(a, b, node.size)
        has = links > 0
        return pa.table({"node": node[has], "links": links[has], "root": node[root[has]]})

    linked = stored(dealt.groupBy("a", "b").applyInArrow(compared, "node long, links long, root long"), "linked")
    counts = stored(linked.groupBy("node").agg(F.sum("links").alias("links")), "counts")
    roots = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    whole = stored(distinct.select("node", "first", "copies").join(roots, "node", "left").select("node", "first", "copies", F.coalesce("root", "node").alias("root")), "whole")
    lowest = stored(whole.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    whole = stored(whole.join(lowest, "root").select("node", "copies", "component_id"), "whole")
    whole = stored(whole.join(counts, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "whole")
    own = stored(marked.select("vec_id", "node"), "ids")
    out = own.join(whole, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
