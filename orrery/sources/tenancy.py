"""Organisations, projects, spaces and sessions: soft deletion, restoration and listing, as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEPT_DAYS = 30
PROTECTIONS = ("none", "private", "vault", "sealed")


def create(existing: DataFrame, name: str, display_name: str, now: Column, protection: str = "none") -> DataFrame:
    if protection not in ("none", "private"):
        raise NotImplementedError(f"{protection!r} spaces need encryption, which is not offered")
    spark = existing.sparkSession
    if not existing.where(F.col("name") == name).isEmpty():
        raise FileExistsError(name)
    row = spark.range(1).select(F.lit(name).alias("name"), F.lit(display_name).alias("display_name"), now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(None).cast("timestamp").alias("expires_at"))
    return existing.unionByName(row)


def soft_delete(rows: DataFrame, which: Column, now: Column, days: int = KEPT_DAYS) -> DataFrame:
    """Stamps deletion and expiry once; deleting again changes nothing."""
    first = which & F.col("deleted_at").isNull()
    return rows.withColumn("expires_at", F.when(first, now + F.make_interval(days=F.lit(days))).otherwise(F.col("expires_at"))).withColumn("deleted_at", F.when(first, now).otherwise(F.col("deleted_at")))


def undelete(rows: DataFrame, which: Column) -> DataFrame:
    none = F.lit(None).cast("timestamp")
    return rows.withColumn("deleted_at", F.when(which, none).otherwise(F.col("deleted_at"))).withColumn("expires_at", F.when(which, none).otherwise(F.col("expires_at")))


def children(rows: DataFrame, parent: str, kind: str, show_deleted: bool = False) -> DataFrame:
    from orrery.functions.names import is_child

    own = rows.where(is_child(F.col("name"), parent, kind))
    return own if show_deleted else own.where(F.col("deleted_at").isNull())


def purge(rows: DataFrame, now: Column) -> DataFrame:
    """Without what has expired."""
    return rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def coverage(spaces: DataFrame) -> DataFrame:
    """Whether a search over spaces (name, protection) is complete, and which stay locked."""
    locked = F.col("protection").isin("vault", "sealed")
    return spaces.agg((F.count_if(locked) == 0).alias("complete"), F.sort_array(F.collect_list(F.when(locked, F.col("name")))).alias("locked_spaces"))
