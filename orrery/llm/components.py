"""Connected components by repeated local contraction.

In each round every node takes the label of the neighbour (itself included) that a hash of node and round
ranks first; the links between labels make the next, smaller graph. Random ranks shorten chains by a
constant factor in expectation, so that the rounds grow with the logarithm of the longest chain. When what
is left is a few links (a fixed bound, 1.6 MB), one task finishes them with union-find. Both sides of each
join are read from the shared folder, so that adaptive execution can split a node with very many links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Links that a single task may finish.
FINISH_LINKS = 100_000


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and links a-b: the smallest node of each one's component."""
    root = np.arange(n)
    while a.size:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, root):
            break
        root = new[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b between any integers as (node, smallest node of its component); a row for each node."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = local_roots(index[: a.size], index[a.size :], nodes.size)
    return nodes, nodes[root]


def _finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = pa.Table.from_batches(batches, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    if links.num_rows:
        nodes, roots = forest(links.column("a").to_numpy(), links.column("b").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def components(links: DataFrame, finish_links: int = FINISH_LINKS) -> DataFrame:
    """links: a, b (long, not null). Returns node, root (some node of the component) for each node with a link to another."""
    left = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    steps: list[DataFrame] = []
    while True:
        n = left.count()
        if n <= finish_links:
            steps.append(stored(left.coalesce(1).mapInArrow(_finish, "node long, root long"), "roots"))
            break
        rank = lambda c, k=len(steps): F.xxhash64(F.col(c), F.lit(k))
        both = left.select(F.col("a").alias("node"), F.col("b").alias("near")).union(left.select("b", "a"))
        best = both.groupBy("node").agg(F.min(F.struct(rank("near"), F.col("near").alias("root"))).alias("best"))
        own = F.struct(rank("node"), F.col("node").alias("root"))
        steps.append(stored(best.select("node", F.least(F.col("best").cast("struct<r:long,root:long>"), own.cast("struct<r:long,root:long>"))["root"].alias("root")), "roots"))
        for end in ("a", "b"):
            left = stored(left.join(steps[-1].select(F.col("node").alias(end), F.col("root").alias("label")), end).drop(end).withColumnRenamed("label", end), "links")
        left = stored(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = steps[0]
    for step in steps[1:]:
        nxt = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
        found = stored(found.join(nxt, "root", "left").select("node", F.coalesce("further", "root").alias("root")), "roots")
    return found
