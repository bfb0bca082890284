"""Global numbers and running sums over a sorted table, from per-partition totals.

The table is range-partitioned and written through a checkpoint, so that a
partition's number means the same rows from then on.  Each partition's totals
go to the driver (a row per partition), are summed there, and come back as
the partitions' bases; within a partition a window runs in order.  Rows that
tie wholly are spread by a random salt: which of them comes first makes no
difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows with an equal sort key are spread over so many values of a salt.
SALT = 4096


def laid_out(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """The rows range-partitioned in order and fixed, with __part, their partition's number, and __salt."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("__salt", (F.rand(7) * SALT).cast("int"))
    return cut(salted.repartitionByRange(n, *order, F.col("__salt"))).withColumn("__part", F.spark_partition_id())


def bases(parts: DataFrame, *values: Column) -> tuple[DataFrame, list[int]]:
    """(__part, __base0, __base1, ...): the sums of the values in all partitions before; and the totals.  A row per partition, so small enough to broadcast."""
    sums = parts.groupBy("__part").agg(*[F.sum(v).cast("long").alias(f"s{i}") for i, v in enumerate(values)]).collect()
    at, rows = [0] * len(values), []
    for r in sorted(sums, key=lambda r: r["__part"]):
        rows.append((r["__part"], *at))
        at = [a + (r[f"s{i}"] or 0) for i, a in enumerate(at)]
    schema = "__part int, " + ", ".join(f"__base{i} long" for i in range(len(values)))
    return parts.sparkSession.createDataFrame(rows, schema), at


def running(df: DataFrame, order: list[Column], *values: Column, partitions: int | None = None) -> tuple[DataFrame, list[int]]:
    """The rows with __before0, __before1, ...: the sum of each value over all rows that come earlier; and the totals."""
    parts = laid_out(df, order, partitions)
    base, totals = bases(parts, *values)
    w = Window.partitionBy("__part").orderBy(*order, "__salt").rowsBetween(Window.unboundedPreceding, 0)
    own = [(F.sum(v).over(w) - v + F.col(f"__base{i}")).cast("long").alias(f"__before{i}") for i, v in enumerate(values)]
    return parts.join(F.broadcast(base), "__part").select(*[f"`{c}`" for c in df.columns], *own), totals


def numbered(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """The rows with their position in order, from 0."""
    out, _ = running(df, order, F.lit(1).cast("long"), partitions=partitions)
    return out.withColumnRenamed("__before0", name)
