"""Reading points from CSV, JSON lines, TSV judgements and vector files, and an offline text embedder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A header row; quotes, doubled quotes and line ends inside quotes; a ragged row is an error."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST")


def csv_points(rows: DataFrame, id_column: str | None, text_column: str, order: Column | str) -> DataFrame:
    """id, text: trimmed; rows without text are dropped; rows without id are row-N by their place in the file."""
    if text_column not in rows.columns:
        return rows.select(F.lit("").alias("id"), F.lit("").alias("text")).limit(0)
    placed = rows.withColumn("_n", F.row_number().over(Window.orderBy(order)))
    own = F.nullif(F.trim(F.col(id_column).cast("string")), F.lit("")) if id_column in rows.columns else F.lit(None).cast("string")
    text = F.trim(F.col(text_column))
    return placed.select(F.coalesce(own, F.concat(F.lit("row-"), F.col("_n").cast("string"))).alias("id"), text.alias("text")).where(F.length("text") > 0)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with _id, title and text."""
    return corpus_text(spark.read.schema("_id string, title string, text string").json(path))


def corpus_text(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_id").alias("doc_id"), F.trim(F.concat_ws(" ", F.trim("title"), F.col("text"))).alias("text"))


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated query-id, corpus-id, score with a header; grades above zero."""
    rows = spark.read.schema("query_id string, doc_id string, grade int").csv(path, sep="\t", header=True, enforceSchema=True)
    return rows.where("grade > 0")


def read_vectors(spark: SparkSession, path: str, kind: str = "fvecs") -> DataFrame:
    """row, vec of little-endian (width, values) records; a file that ends inside a record is an error."""
    dtype = "<f4" if kind == "fvecs" else "<i4"

    def parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                if not data:
                    continue
                dim = int(np.frombuffer(data[:4], "<i4")[0])
                if dim <= 0 or len(data) % (4 * dim + 4):
                    raise ValueError(f"{name} ends inside a record")
                rows = np.frombuffer(data, "<i4").reshape(-1, dim + 1)
                if (rows[:, 0] != dim).any():
                    raise ValueError(f"{name} has records of several widths")
                values = rows[:, 1:].copy().view(dtype).astype(np.float32 if kind == "fvecs" else np.int32)
                for at in range(0, len(values), 8192):
                    part = values[at : at + 8192]
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), dim)
                    item = pa.float32() if kind == "fvecs" else pa.int32()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), name)), pa.array(np.arange(at, at + len(part))), lists.cast(pa.list_(item))], names=["file", "row", "vec"])

    item = "float" if kind == "fvecs" else "int"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parsed, f"file string, row long, vec array<{item}>")


def embed(df: DataFrame, text: str = "text", dim: int = 64, task: str = "") -> DataFrame:
    """df with vec: words hashed to signed components, of unit length. No meaning is claimed; it needs no model.

    task: a prefix for queries or documents, as encoders take.
    """
    words = F.filter(F.split(F.lower(F.concat(F.lit(task), F.col(text))), r"\W+"), lambda w: F.length(w) > 0)
    number = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long")
    return df.withColumn("vec", _summed(dim)(F.transform(words, number)))


#: Texts whose words are summed at once.
TEXTS = 512


def _summed(dim: int):
    """Numbers of words to a vector of unit length: each adds or takes one in its component. All sums are whole numbers, so their order is free."""

    @F.arrow_udf("array<float>")
    def summed(numbers: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(numbers), TEXTS):
            own = numbers.slice(at, TEXTS)
            h = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            text = np.repeat(np.arange(len(own)), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            sums = np.bincount(text * dim + h % dim, np.where((h >> 20) & 1, 1.0, -1.0), len(own) * dim).reshape(len(own), dim)
            length = np.sqrt((sums * sums).sum(axis=1))[:, None]
            parts.append((sums / np.where(length > 0, length, 1.0)).astype(np.float32))
        values = np.concatenate(parts).ravel() if parts else np.zeros(0, np.float32)
        return pa.ListArray.from_arrays(np.arange(len(numbers) + 1, dtype=np.int32) * dim, pa.array(values, pa.float32()), mask=numbers.is_null())

    return summed


def bulk_export(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Rows to files of a kind: parquet, json (lines) or csv (with a header; columns of simple types)."""
    _bulk(kind)(df.write, path)


def bulk_import(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Rows of files that bulk_export wrote, or others like them; a row that does not fit the schema is an error."""
    if kind == "parquet":
        return spark.read.schema(schema).parquet(path)
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.json(path) if kind == "json" else reader.csv(path, header=True, multiLine=True, quote='"', escape='"')


def _bulk(kind: str):
    ways = {"parquet": lambda w, p: w.parquet(p), "json": lambda w, p: w.json(p), "csv": lambda w, p: w.csv(p, header=True, quote='"', escape='"')}
    if kind not in ways:
        raise ValueError(f"kind is one of {sorted(ways)}, not {kind!r}")
    return ways[kind]
