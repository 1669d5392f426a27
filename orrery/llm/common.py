"""What the operators of this subpackage share: tables in the shared folder, row ids, word rules."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Between words; in Java's and DuckDB's syntax.
SPACE = r"[\x20\x09-\x0D]+"


#: Bytes of a batch for a Python worker.
BATCH_BYTES = 4 << 20
#: Bits of the bitmap that tells rows apart from those that are surely not wanted.
SLOT_BITS = 24


@functools.cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="orrery-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset and all runs in one process (local or local[n]), a folder of that process, gone at its end.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_folder()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/orrery/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the batches that Python workers get, whatever the length of texts (in this session)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(key, None) or "")
    if not now or int(now[1]) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, and survives the loss of executors."""
    small_batches(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def lean(work: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work on a task's batches; at its end freed memory goes back to the system, as Python workers live on."""

    def lean_work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return lean_work


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def ragged(column: pa.ListArray) -> tuple[list[int], dict[str, np.ndarray]]:
    """Of a list of structs of numbers: where each list begins (and the last ends), and the fields of all; null lists are empty."""
    values = column.values
    fields = {values.type.field(k).name: child for k, child in enumerate(values.flatten())}
    return column.offsets.to_pylist(), {n: c.fill_null(0).to_numpy(zero_copy_only=False) for n, c in fields.items()}


def in_doubt_of(docs: DataFrame, uids: DataFrame, key: str = "_uid") -> DataFrame:
    """docs with _in_doubt: whether its column key may be among uids (uid), by a bitmap of their hashes.

    The bitmap has 2^SLOT_BITS bits (2 MB), whatever the number of uids; with very many of them all rows are in doubt.
    """
    slot = lambda c: F.pmod(F.xxhash64(c, F.lit(7)), F.lit(1 << SLOT_BITS))
    words = stored(uids.select(slot("uid").alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")), "words")
    marked = docs.withColumn("_slot", slot(key))
    marked = marked.join(F.broadcast(words.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))), F.shiftright("_slot", 6) == F.col("_word"), "left")
    return marked.withColumn("_in_doubt", F.expr("coalesce(shiftright(_bits, cast(_slot & 63 as int)) & 1L, 0L) = 1")).drop("_slot", "_word", "_bits")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(column: str = "doc_id"):
    """crc32 of an id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def renamed(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """docs with all columns but the needed ones under names of our own (other_0, ...), and its own names, to be given back with toDF."""
    first = {n: docs.columns.index(n) for n in needed}
    return docs.toDF(*[n if first.get(n) == k else f"other_{k}" for k, n in enumerate(docs.columns)]), docs.columns
