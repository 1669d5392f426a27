"""k-means, product quantisation and half floats, in numpy on the driver's sample and in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that fits see at most, and distances held at once (8 MB).
SAMPLE, NEAR = 65_536, 1 << 20


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls as rows, in doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sample(rows: DataFrame, vec: str = "vec", key: str = "row", most: int = SAMPLE) -> np.ndarray:
    """A bounded sample by a hash of the key, in the order of the key."""
    rows = rows.where(F.col(vec).isNotNull())
    n = rows.count()
    part = rows if n <= most else rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < F.lit(int(1_000_003 * most / n)))
    found = part.select(key, vec).limit(2 * most).toArrow().sort_by(key)
    return matrix(found.column(vec)) if found.num_rows else np.zeros((0, 0))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid; the lower index of equals."""
    step, own = max(1, NEAR // max(1, len(centroids))), (centroids * centroids).sum(axis=1)[None, :]
    parts = [np.argmin(own - 2 * x[a : a + step] @ centroids.T, axis=1) for a in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, iterations: int = 12, seed: int = 3) -> np.ndarray:
    """Seeded by squared distance; an empty cluster starts again at a random row; stops when no row moves."""
    rnd = np.random.default_rng(seed)
    n = x.shape[0]
    k = min(k, n)
    if not k:
        return np.zeros((0, x.shape[1]))
    centroids = np.empty((k, x.shape[1]))
    centroids[0] = x[rnd.integers(n)]
    away = ((x - centroids[0]) ** 2).sum(axis=1)
    for c in range(1, k):
        total = away.sum()
        centroids[c] = x[rnd.choice(n, p=away / total)] if total > 0 else x[rnd.integers(n)]
        away = np.minimum(away, ((x - centroids[c]) ** 2).sum(axis=1))
    own = np.full(n, -1)
    for _ in range(iterations):
        now = nearest(x, centroids)
        if np.array_equal(now, own):
            break
        own = now
        sizes = np.bincount(own, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        full = sizes > 0
        centroids[full] = sums[full] / sizes[full, None]
        centroids[~full] = x[rnd.integers(n, size=int((~full).sum()))]
    return centroids


@dataclass
class Codebook:
    """Product quantiser: parts x 256 x width of a part."""

    centroids: np.ndarray

    @property
    def parts(self) -> int:
        return self.centroids.shape[0]

    def encode(self, x: np.ndarray) -> np.ndarray:
        split = x.reshape(x.shape[0], self.parts, -1)
        return np.stack([nearest(split[:, p], self.centroids[p]) for p in range(self.parts)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.centroids[p][codes[:, p]] for p in range(self.parts)], axis=1)

    def table(self, query: np.ndarray, metric: str) -> np.ndarray:
        """Partial scores of a query, parts x 256."""
        q = query.reshape(self.parts, 1, -1)
        return ((self.centroids - q) ** 2).sum(axis=2) if metric == "l2" else (self.centroids * q).sum(axis=2)

    def scores(self, codes: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
        t = self.table(query, metric)
        return t[np.arange(self.parts)[None, :], codes].sum(axis=1)

    def dump(self) -> bytes:
        return np.array(self.centroids.shape, "<i4").tobytes() + self.centroids.astype("<f4").tobytes()

    @classmethod
    def load(cls, data: bytes) -> Codebook:
        shape = np.frombuffer(data[:12], "<i4")
        if len(data) != 12 + 4 * int(np.prod(shape.astype(np.int64))):
            raise ValueError("the codebook's length does not fit its head")
        return cls(np.frombuffer(data[12:], "<f4").reshape(shape).astype(np.float64))


def train_pq(x: np.ndarray, parts: int, iterations: int = 25, seed: int = 7) -> Codebook:
    if x.shape[1] % parts:
        raise ValueError(f"{x.shape[1]} dimensions do not divide into {parts} parts")
    if x.shape[0] < 256:
        raise ValueError("a codebook needs 256 training rows")
    split = x.reshape(x.shape[0], parts, -1)
    return Codebook(np.stack([kmeans(split[:, p], 256, iterations, seed + p) for p in range(parts)]))


def with_pq_codes(rows: DataFrame, book: Codebook, key: str = "row", vec: str = "vec") -> DataFrame:
    """key, codes (binary)."""
    shared = rows.sparkSession.sparkContext.broadcast(book)

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = shared.value.encode(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=[key, "codes"])

    return rows.where(F.col(vec).isNotNull()).select(F.col(key).cast("long").alias(key), vec).mapInArrow(encoded, f"{key} long, codes binary")


def int8_codes(x: np.ndarray) -> np.ndarray:
    """Rows of scale and offset (doubles, little-endian) and a byte for each component; a constant or non-finite row has scale 0."""
    sound = np.isfinite(x).all(axis=1)
    x = np.where(sound[:, None], x, 0.0)
    low = x.min(axis=1)
    scale = (x.max(axis=1) - low) / 255
    with np.errstate(divide="ignore", invalid="ignore"):
        codes = np.where(scale[:, None] > 0, np.clip(np.floor((x - low[:, None]) / scale[:, None] + 0.5), 0, 255), 0).astype(np.uint8)
    return np.concatenate([np.stack([scale, low], axis=1).astype("<f8").view(np.uint8).reshape(len(x), 16), codes], axis=1)


def int8_rows(data: np.ndarray) -> np.ndarray:
    head = np.ascontiguousarray(data[:, :16]).view("<f8")
    return data[:, 16:] * head[:, :1] + head[:, 1:]


def half_floats(x: np.ndarray) -> np.ndarray:
    """Half floats, little-endian; what is too large becomes infinite."""
    with np.errstate(over="ignore"):
        return x.astype("<f2").view(np.uint8)


#: Bytes of rows by codec; "pq" needs a codebook besides.
CODECS = {"f16": half_floats, "int8": int8_codes, "binary": lambda x: np.packbits(x >= 0, axis=1)}


def with_codes(rows: DataFrame, codec: str, key: str = "row", vec: str = "vec") -> DataFrame:
    """key, codes (binary)."""
    code = CODECS[codec]

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in code(matrix(batch.column(1)))], pa.binary())], names=[key, "codes"])

    return rows.where(F.col(vec).isNotNull()).select(F.col(key).cast("long").alias(key), vec).mapInArrow(coded, f"{key} long, codes binary")
