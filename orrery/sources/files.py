"""Small files and folders on whatever file system Spark reads, through its own file system layer."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="orrery-engine-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); where that is unset and all runs in one process, in one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or _own_folder()).rstrip('/')}/orrery/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what is read several times is made once, and lineage ends."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _of(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _of(spark, path)
    return bool(fs.exists(at))


def names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _of(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> bool:
    fs, at = _of(spark, path)
    return bool(fs.delete(at, True))


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """Whole or not at all: written aside, then renamed."""
    fs, at = _of(spark, path)
    if not overwrite and fs.exists(at):
        raise FileExistsError(path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if overwrite and fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(aside, at):
        fs.delete(aside, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, at = _of(spark, path)
    out = fs.create(at, False)
    out.write(bytearray(data))
    out.close()
