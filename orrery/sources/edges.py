"""Edge tables on files: inserts with checks, latest writes, lists with filters, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.filters import parse_filter, parse_order
from orrery.operators.graph import latest_edges


def faults(edges: DataFrame) -> DataFrame:
    """src, edge_type, dst, fault for each row that may not be written."""
    empty = lambda c: F.col(c).isNull() | (F.length(c) == 0)
    fault = (
        F.when(empty("src") | empty("dst"), "an end is missing")
        .when(empty("edge_type"), "the type is missing")
        .when(F.col("edge_type").contains("\0"), "the type holds a zero byte")
        .when(F.col("weight").isNull() | F.isnan("weight"), "the weight is no number")
    )
    return edges.withColumn("fault", fault).where("fault IS NOT NULL").select("src", "edge_type", "dst", "fault")


def upsert(existing: DataFrame, writes: DataFrame) -> DataFrame:
    """existing and writes: src, edge_type, dst, weight, seq; the last write of a key wins."""
    return latest_edges(existing.unionByName(writes))


def delete(existing: DataFrame, keys: DataFrame) -> DataFrame:
    return existing.join(keys.select("src", "edge_type", "dst").distinct(), ["src", "edge_type", "dst"], "left_anti")


def listed(edges: DataFrame, filter_text: str = "", order_by: str = "src, edge_type, dst", limit: int | None = None, allowed: Column | None = None) -> DataFrame:
    out = edges.where(parse_filter(filter_text))
    out = out if allowed is None else out.where(allowed)
    out = out.orderBy(*parse_order(order_by))
    return out if limit is None else out.limit(limit)


def insert(existing: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges after the sound writes, and what became of each write: src, edge_type, dst, written, fault."""
    bad = faults(writes).dropDuplicates(["src", "edge_type", "dst"])
    keys = [F.col(f"w.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("src", "edge_type", "dst")]
    joined = writes.alias("w").join(bad.alias("b"), keys, "left").select("w.*", "b.fault")
    sound = joined.where("fault IS NULL")
    return upsert(existing, sound.select(*existing.columns)), joined.select("src", "edge_type", "dst", F.col("fault").isNull().alias("written"), "fault")


# Declared kinds of edges: edge_type, src_kind, dst_kind, structural.


def declare(types: DataFrame, new: DataFrame) -> DataFrame:
    """types with the new ones; what is declared stays as it is."""
    return types.unionByName(new.join(types.select("edge_type"), "edge_type", "left_anti").select(*types.columns))


def undeclare(types: DataFrame, names: DataFrame, edges: DataFrame) -> DataFrame:
    """types without those named, but for those that edges still use."""
    unused = names.select("edge_type").distinct().join(edges.select("edge_type").distinct(), "edge_type", "left_anti")
    return types.join(unused, "edge_type", "left_anti")


def undeclared(types: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of a type that is not declared, or whose ends are not of its kinds (the part of a name before its slash; null: any)."""
    kind = lambda c: F.substring_index(F.col(c), "/", 1)
    fits = lambda want, c: F.col(want).isNull() | (F.col(want) == kind(c))
    joined = edges.join(types, "edge_type", "left").withColumn("_fits", F.col("structural").isNotNull() & fits("src_kind", "src") & fits("dst_kind", "dst"))
    return joined.where("NOT _fits").select(*edges.columns)
