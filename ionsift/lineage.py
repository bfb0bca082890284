"""Where a plan is cut, and what is broadcast."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that is broadcast at most.
SMALL = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors see, as a URI.

    Where none is set, one of the machine in local mode; RuntimeError on a
    cluster.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and context._jsc.sc().getCheckpointDir().isDefined():
        at = context._jsc.sc().getCheckpointDir().get()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master or ""):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {context.master} see")
        at = "file://" + tempfile.mkdtemp(prefix="ionsift-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(at)
    return at if ":" in at.split("/")[0] else f"file://{os.path.abspath(at)}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is made there yet."""
    return f"{shared_folder(spark).rstrip('/')}/ionsift-{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The rows through a reliable checkpoint in the shared folder: computed once, read by whatever follows, kept when executors go."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """The table to be broadcast if it has so many rows at most, which is counted; else as it is, for Spark to shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
