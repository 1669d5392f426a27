"""Index kinds behind one protocol, and the registry that a collection's declaration is looked up in.

An index covers the rows it was built from; what was appended later is searched exactly and merged, and
deleted or hidden rows are left out before ranking, so answers stay full after writes.
"""

from __future__ import annotations

import base64
import json
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators import approximate as A
from orrery.operators import quantize as Q
from orrery.operators.flat import batch_topk
from orrery.sources import files


class VectorIndex(Protocol):
    def build(self, rows: DataFrame, metric: str, path: str) -> None:
        """rows: row, vec. Writes below path."""

    def search(self, spark: SparkSession, path: str, queries: DataFrame, k: int, metric: str, hidden: DataFrame | None) -> DataFrame:
        """query_id, row, score, rank; hidden: row."""


def _seen(rows: DataFrame, hidden: DataFrame | None) -> DataFrame:
    return rows if hidden is None else rows.join(hidden.select("row").distinct(), "row", "left_anti")


def _keep(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _write_settings(spark: SparkSession, path: str, **settings) -> None:
    files.write_text(spark, f"{path}/settings.json", json.dumps(settings))


def _settings(spark: SparkSession, path: str) -> dict:
    return json.loads(files.read_text(spark, f"{path}/settings.json"))


class FlatIndex:
    """No structure: a copy of the rows."""

    def build(self, rows, metric, path):
        rows.select("row", "vec").write.parquet(f"{path}/rows")

    def search(self, spark, path, queries, k, metric, hidden):
        return batch_topk(_seen(spark.read.parquet(f"{path}/rows"), hidden), queries, k, metric)


#: Neighbours for which settings are measured at build.
FOR_K = 10


class ListIndex:
    """Inverted lists, a folder each: a search reads those it probes. How many is measured at build."""

    def build(self, rows, metric, path):
        centroids = A.fit_lists(rows)
        A.write_lists(A.assign(rows, centroids), f"{path}/lists")
        own = self._rows(rows.sparkSession, path, None)
        _write_settings(rows.sparkSession, path, centroids=centroids.tolist(), probes=A.probes_by_recall(own, centroids, FOR_K, metric) if len(centroids) else 1)

    def _rows(self, spark, path, hidden):
        return _seen(spark.read.schema("row long, vec array<float>, list int").parquet(f"{path}/lists"), hidden).select("row", "vec", "list")

    def search(self, spark, path, queries, k, metric, hidden):
        own = _settings(spark, path)
        return A.ivf_search(self._rows(spark, path, hidden), np.array(own["centroids"]), queries, k, own["probes"], metric)


class CodedListIndex(ListIndex):
    """Inverted lists of product codes, trained and written at build; exact scores for candidates, whose number is measured too."""

    def build(self, rows, metric, path):
        super().build(rows, metric, path)
        spark, own = rows.sparkSession, _settings(rows.sparkSession, path)
        assigned, centroids = self._rows(spark, path, None), np.array(own["centroids"])
        if assigned.limit(256).count() < 256:  # too few rows for a codebook
            return
        parts = next(p for p in (8, 4, 2, 1) if centroids.shape[1] % p == 0)
        book = A.residual_book(assigned, centroids, parts)
        A.residual_codes(assigned, centroids, book).write.partitionBy("list").parquet(f"{path}/codes")
        n = A.candidates_by_place(assigned, self._codes(spark, path, None), A.Scorer(metric, book.decode), FOR_K, metric, centroids)
        files.delete(spark, f"{path}/settings.json")
        _write_settings(spark, path, **own, book=base64.b64encode(book.dump()).decode(), candidates=n)

    def _codes(self, spark, path, hidden):
        return _seen(spark.read.schema("row long, codes binary, list int").parquet(f"{path}/codes"), hidden).select("row", "codes", "list")

    def search(self, spark, path, queries, k, metric, hidden):
        own = _settings(spark, path)
        if "book" not in own:
            return super().search(spark, path, queries, k, metric, hidden)
        book = Q.Codebook.load(base64.b64decode(own["book"]))
        return A.coded_lists_search(self._rows(spark, path, None), self._codes(spark, path, hidden), np.array(own["centroids"]), book, queries, k, max(own["candidates"], V.over_fetch(k)), own["probes"], metric)


class TierIndex:
    """Codes of one codec, written at build; a search scans them alone and reads vectors of its candidates only."""

    def __init__(self, codec: str):
        self.codec = codec

    def build(self, rows, metric, path):
        spark, rows = rows.sparkSession, _keep(rows.select("row", "vec"), f"{path}/rows")
        book = None
        if self.codec == "pq":
            sample = Q.sample(rows)
            book = Q.train_pq(sample, next(p for p in (8, 4, 2, 1) if sample.shape[1] % p == 0))
        codes = _keep(A.encoded(rows, self.codec, book), f"{path}/codes")
        n = A.candidates_by_place(rows, codes, A.scorer(self.codec, metric, book), FOR_K, metric)
        _write_settings(spark, path, candidates=n, book=None if book is None else base64.b64encode(book.dump()).decode())

    def search(self, spark, path, queries, k, metric, hidden):
        own = _settings(spark, path)
        book = Q.Codebook.load(base64.b64decode(own["book"])) if own["book"] else None
        codes = _seen(spark.read.parquet(f"{path}/codes"), hidden).select("row", "codes")
        return A.two_tier(spark.read.parquet(f"{path}/rows"), codes, queries, k, self.codec, metric, max(own["candidates"], V.over_fetch(k)), book)


class GraphIndex:
    """A small world for each part."""

    ROWS = 20_000

    def build(self, rows, metric, path):
        A.build_graphs(rows, metric, max(1, rows.count() // self.ROWS)).write.parquet(f"{path}/graphs")

    def search(self, spark, path, queries, k, metric, hidden):
        return A.graph_search(spark.read.parquet(f"{path}/graphs"), queries, k, max(64, 2 * k), metric, hidden)


INDEXES: dict[str, VectorIndex] = {"flat": FlatIndex(), "ivf": ListIndex(), "ivfpq": CodedListIndex(), "hnsw": GraphIndex(), **{c: TierIndex(c) for c in ("int8", "f16", "binary", "pq")}}


def register(kind: str, index: VectorIndex) -> None:
    INDEXES[kind] = index


def prefers_exact(visible: int, total: int) -> bool:
    """With under a hundredth of the rows visible an exact scan of those is cheaper than walking an index."""
    return total > 0 and visible / total < 0.01


def rows_hidden(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows (row, name) whose name is not allowed."""
    return rows.join(allowed.select("name").distinct(), "name", "left_anti").select(F.col("row"))
