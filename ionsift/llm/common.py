"""Helpers shared by the operators of this subpackage.

A *word* is a maximal run of characters other than the ASCII white space
``\\x20 \\x09-\\x0D``, everywhere in this subpackage.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: The white space of SPACE as characters, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: The row of the input that an operator carries along, whatever its columns are called.
ROW = "__row"


def words(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(text, SPACE), ""), F.array().cast("array<string>"))


def packed(df: DataFrame, *needed: Column) -> DataFrame:
    """The needed expressions beside the whole row as one struct, so that extra columns can't clash with an operator's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW), *needed)


def unpacked(df: DataFrame, columns: list[str], *computed: str) -> DataFrame:
    """The carried columns, then the computed ones; a computed column replaces a carried one of its name (in any case of letters)."""
    taken = {c.lower() for c in computed}
    return df.select(*[F.col(f"{ROW}.`{c}`").alias(c) for c in columns if c.lower() not in taken], *computed)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see.

    Where none is set, one of the machine in local mode (tests); RuntimeError
    on a cluster, whose executors would not see it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not at:
        master = spark.sparkContext.master or ""
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} see")
        at = "file://" + tempfile.mkdtemp(prefix="ionsift-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at if ":" in at.split("/")[0] else f"file://{os.path.abspath(at)}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet.  What is written there stays until remove_folder()."""
    return f"{shared_folder(spark).rstrip('/')}/ionsift-{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that new_folder() named, once what was read from it is no longer needed; others are refused."""
    if not folder.startswith(f"{shared_folder(spark).rstrip('/')}/ionsift-"):
        raise ValueError(f"{folder} is not one of this package's folders")
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_scratch = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it, in this thread, what written() makes lasts until its end: for a caller that writes down there what is read from it."""
    outer, _scratch.folders = getattr(_scratch, "folders", None), []
    try:
        yield
    finally:
        own, _scratch.folders = _scratch.folders, outer
        for folder in own:
            remove_folder(spark, folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, read by columns.  It stays, unless it is made within scratch()."""
    at = new_folder(df.sparkSession, name)
    if getattr(_scratch, "folders", None) is not None:
        _scratch.folders.append(at)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def cut(df: DataFrame) -> DataFrame:
    """The rows through a reliable checkpoint: computed once, and kept in the shared folder when executors go."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unsigned(text: Column) -> Column:
    """A whole non-negative number from the first 13 hex digits of an MD5, below 2**52, in SQL engines alike."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def release() -> None:
    """At a task's end, in a Python worker: memory that is free goes back to the system, for the worker stays and others start beside it."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass
