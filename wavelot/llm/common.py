"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Let rows travel to Python at most so many and so many bytes at a time: the defaults, 10,000 whole texts or 64 MB, are a lot of memory in each worker
    and its executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).lower().rstrip("b") in ("67108864", "64m"):  # the default
        spark.conf.set(name, size)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function on a task's batches, that hands free memory back to the system at its end. Spark keeps a task's Python worker for later tasks, in turn with
    others that wait, and each would hold on to the most it ever took, next to the executor's heap."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session may go without: it gets a temporary one."""
    small_batches(spark)
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[[^-]*\])?$", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="wavelot-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Run df once and cut its lineage in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def thin(df: DataFrame, rows: int, per_task: int = 200_000) -> DataFrame:
    """df in as many tasks as its number of short rows asks for, so that small steps don't leave a file per partition."""
    return df.coalesce(max(1, -(-rows // per_task)))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, so that other columns of the caller, whatever their names, can't clash."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_key(text: Column) -> Column:
    """128-bit identity of a text as a binary column; null counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def join_hot(rows: DataFrame, small: DataFrame, key: str, share: float = 0.002) -> DataFrame:
    """rows joined with small, which has one row for each key. Keys that hold more than `share` of the rows, so 1 / share of them at most, are joined
    by broadcast, and no task gets all rows of one."""
    total = rows.count()
    heavy = [r[key] for r in rows.groupBy(key).count().where(F.col("count") > max(1000, int(share * total))).select(key).collect()]
    if not heavy:
        return rows.join(small, key)
    is_heavy = F.col(key).isin(heavy)
    return rows.where(~is_heavy).join(small.where(~is_heavy), key).unionByName(rows.where(is_heavy).join(F.broadcast(small.where(is_heavy)), key))
