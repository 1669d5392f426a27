"""Near-duplicate documents by SimHash, linked exactly with vantage-point trees.

Documents are first reduced to distinct fingerprints, so that exact copies cost one entry. A tree of
vantage points, fitted on a bounded sample of fingerprints, divides them: those up to the median distance
from the vantage point go left, the others right. A fingerprint lives in one leaf (shard); as two that
differ in r bits differ by r at most in their distance from any vantage point, it also visits those leaves
that the triangle bound cannot rule out. Each shard is joined by the same rule, recursively, and returns a
spanning forest of its links, never the pairs; components of the forests are the components of all links.

Defined results: null and empty texts have the fingerprint zero and link like any other; repeated rows
have the same fingerprint and one component; a null id is in no component's minimum; an empty table gives no
rows; columns other than those named are ignored (`one_of_each` keeps them, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_doubt_of, lean, renamed, stored
from .components import components, forest

SHINGLE, DISTANCE, SEED = 3, 2, 42
#: Fingerprints aimed at in a shard; the tree's depth, which bounds sample (32 MB) and broadcast (4 MB); sampled for a leaf.
LEAF, DEPTH, SAMPLE_LEAF = 8192, 18, 16
#: Vantage points tried at a node.
TRIED = 16
#: Pairs compared at once.
BLOCK = 1 << 19


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash over shingles of words, as an unsigned 64-bit number."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(words) - shingle + 1)
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        end = ends[at + shingle - 1 : min(n, at + (1 << 16)) + shingle - 1] or ends[-1:]
        h = np.array([hashed(line[s:e], seed) for s, e in zip(starts[at:], end, strict=False)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterable[pa.RecordBatch], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(3)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(prints.view(np.int64))], names=["uid", "id", "doc_id", "print"])


class VantageTree:
    """Vantage points and radii as heap-ordered arrays; node k has children 2k and 2k+1, leaves begin at 2**depth."""

    def __init__(self, sample: np.ndarray, depth: int, distance: int = DISTANCE):
        """Of several vantage points that with the fewest fingerprints near its radius is taken, as those visit both sides."""
        self.depth = depth
        self.points, self.radii = np.zeros(1 << depth, np.uint64), np.zeros(1 << depth, np.int64)
        inside = {1: sample}
        for k in range(1, 1 << depth):
            own = inside.pop(k, sample[:0])
            if own.size:
                some = own[:: -(-own.size // TRIED)]
                splits = [split(own, x) for x in some]
                layer = [np.count_nonzero(np.abs(np.bitwise_count(own ^ x).astype(np.int64) - r) <= distance) for x, r, _ in splits]
                self.points[k], self.radii[k], near = splits[int(np.argmin(layer))]
                inside[2 * k], inside[2 * k + 1] = own[near], own[~near]

    def route(self, prints: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, fingerprints that live there, fingerprints that visit it)."""
        stack = [(1, prints, prints[:0])]
        while stack:
            k, home, guest = stack.pop()
            if not home.size and not guest.size:
                continue
            if k >> self.depth:
                yield k, home, guest
                continue
            d, g = (np.bitwise_count(x ^ self.points[k]).astype(np.int64) - self.radii[k] for x in (home, guest))
            stack.append((2 * k, home[d <= 0], guest[g <= distance]))
            # Of two that the radius parts it is enough that one visits the other.
            stack.append((2 * k + 1, home[d > 0], np.concatenate([home[(d <= 0) & (d > -distance)], guest[g > -distance]])))


def split(prints: np.ndarray, point: np.uint64 | None = None) -> tuple[np.uint64, int, np.ndarray]:
    """A vantage point, the median distance from it, and which fingerprints lie within."""
    point = prints[prints.size // 2] if point is None else point
    d = np.bitwise_count(prints ^ point)
    radius = int(np.partition(d, (d.size - 1) // 2)[(d.size - 1) // 2])
    if radius == d.max():
        radius -= 1
    return point, radius, d <= radius


def near_pairs(a: np.ndarray, b: np.ndarray | None, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of distinct fingerprints (within a if b is None) that differ in at most distance bits."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if b is None:
            if a.size * a.size <= BLOCK:
                i, j = np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= distance, 1))
                yield a[i], a[j]
                continue
            point, radius, near = split(a)
            d = np.bitwise_count(a ^ point).astype(np.int64) - radius
            stack += [(a[near], None), (a[~near], None), (a[near & (d > -distance)], a[~near & (d <= distance)])]
            continue
        if not a.size or not b.size:
            continue
        if a.size * b.size <= BLOCK:
            i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= distance)
            yield a[i], b[j]
            continue
        point, radius, _ = split(a if a.size >= b.size else b)
        d, e = (np.bitwise_count(x ^ point).astype(np.int64) - radius for x in (a, b))
        if max(d.size and d.max(), e.size and e.max()) <= 0 or min(d.min(), e.min()) > 0:  # nothing is parted: cut in two
            half = (a[: a.size // 2], a[a.size // 2 :]) if a.size >= b.size else (b[: b.size // 2], b[b.size // 2 :])
            stack += [(half[0], b), (half[1], b)] if a.size >= b.size else [(a, half[0]), (a, half[1])]
            continue
        stack += [
            (a[d <= 0], b[e <= 0]),
            (a[d > 0], b[e > 0]),
            (a[(d <= 0) & (d > -distance)], b[(e > 0) & (e <= distance)]),
            (a[(d > 0) & (d <= distance)], b[(e <= 0) & (e > -distance)]),
        ]


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """prints: distinct fingerprints (print long). Returns a, b: links that join all that lie within distance of one another."""
    n = prints.count()
    depth = min(DEPTH, max(0, (n // LEAF).bit_length()))
    each = max(1, n // (SAMPLE_LEAF << depth))
    sample = prints.where(F.pmod(F.xxhash64("print", F.lit(1)), F.lit(each)) == 0).limit(4 * SAMPLE_LEAF << depth) if depth else prints.limit(0)
    tree = prints.sparkSession.sparkContext.broadcast(VantageTree(np.array(sorted(r[0] for r in sample.collect()), np.int64).view(np.uint64), depth, distance))

    def routed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leaf, home, guest in tree.value.route(batch.column(0).to_numpy().view(np.uint64), distance):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(home.size + guest.size, leaf, np.int32)), pa.array(np.concatenate([home, guest]).view(np.int64)), pa.array(np.arange(home.size + guest.size) < home.size)], names=["leaf", "print", "home"]
                )

    def joined(rows: pa.Table) -> pa.Table:
        at, home = rows.column("print").to_numpy().view(np.uint64), rows.column("home").to_numpy(zero_copy_only=False)
        own, guest = at[home], at[~home]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for pairs in (near_pairs(own, None, distance), near_pairs(own, guest, distance)):
            for a, b in pairs:
                if a.size:
                    found.append((a, b))
                if len(found) > 64:
                    found = [forest(np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))]
        a, b = forest(np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])) if found else (at[:0], at[:0])
        apart = a != b
        return pa.table({"a": a[apart].view(np.int64), "b": b[apart].view(np.int64)})

    return prints.select("print").mapInArrow(routed, "leaf int, print long, home boolean").groupBy("leaf").applyInArrow(joined, "a long, b long")


def _grouped(docs: DataFrame, distance: int, shingle: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """uid, id, doc_id, print of each row; and print, root (of its component), component_id of each fingerprint."""
    own = docs.select(*row_keys(), "doc_id", "text").mapInArrow(lean(lambda batches: _fingerprints(batches, shingle, seed)), "uid long, id long, doc_id long, print long")
    own = stored(own, "prints")
    distinct = stored(own.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct, distance))
    linked = stored(distinct.join(roots, F.col("print") == F.col("node")).select("print", "root", "first"), "linked")
    lowest = stored(linked.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    linked = linked.join(lowest, "root").select("print", "root", "component_id")
    of = distinct.join(linked, "print", "left").select("print", F.coalesce("root", "print").alias("root"), F.coalesce("component_id", "first").alias("component_id"))
    return own, stored(of, "of")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable); a row for each row of docs."""
    own, of = _grouped(docs, distance, shingle, seed)
    return own.join(of, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def row_keys() -> list:
    """What tells rows of docs apart: a hash of id and text, and the id beside it."""
    return [F.xxhash64("doc_id", "text").alias("uid"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id")]


def first_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows: uid, id, doc_id, root of each row of docs. Of each root the row of the smallest doc_id, see one_of_each."""
    rows = stored(rows, "rows")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "uid", "id")).alias("first")).select("first.uid", "first.id")
    keep = stored(rows.join(stored(first, "first"), ["uid", "id"]).groupBy("uid", "id").agg(F.count("*").alias("n")), "keep")
    # Most rows are kept, once: a bitmap of all others lets them pass without a shuffle of texts.
    doubtful = rows.join(keep.where("n = 1"), ["uid", "id"], "left_anti").select("uid")
    own, names = renamed(docs, "doc_id", "text")
    marked = in_doubt_of(own.select("*", *row_keys()), doubtful, "uid")
    sure = marked.where("NOT _in_doubt").select(*own.columns)
    left = marked.where("_in_doubt").join(keep, ["uid", "id"])
    kept = sure.unionByName(left.where("n = 1").select(*own.columns))
    if not keep.where("n > 1").isEmpty():
        kept = kept.unionByName(left.where("n > 1").dropDuplicates(["uid", "id"]).select(*own.columns))
    return kept.toDF(*names)


def one_of_each(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Of each component the row of the smallest doc_id (of equal ids that of the smallest hash of the text), all columns.

    Of rows that are equal in id and text one is kept.
    """
    own, of = _grouped(docs, distance, shingle, seed)
    return first_of_each(docs, own.join(of, "print").select("uid", "id", "doc_id", "root"))
