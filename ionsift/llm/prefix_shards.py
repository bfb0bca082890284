"""Contiguous shards of near-equal byte size, cut out of a global prefix sum.

The rows are range-partitioned in order, each partition's bytes and rows are
totalled, and a row's place in the whole is its partition's base plus the
running sum within.  The whole is cut at equal targets: a row belongs to the
shard its midpoint falls into, so shards are contiguous and differ from the
target by one row at most.  A row's slot is its position less its shard's
first.

Defined results: texts count whole, however long; a null one has size 1; null keys come last; repeated rows
are separate, and spread over partitions by a salt; an empty table gives no
rows.  Rows that tie in key, CRC-32 and size are alike to the law: which of
them takes which of their slots may differ between runs if other columns tell
them apart.  Computed columns replace input columns of their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, packed, unpacked
from .prefix import running

SHARDS = 16


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) + 1).cast("long")


def assign(df: DataFrame, size: Column, order: list[Column], shards: int = SHARDS, partitions: int | None = None) -> DataFrame:
    """All columns with __size, __shard and __slot.  ``order`` refers to columns of df."""
    placed, (total, _) = running(df.withColumn("__size", size.cast("long")), [*order, F.col("__size")], F.col("__size"), F.lit(1).cast("long"), partitions=partitions)
    # twice the midpoint times the shards over twice the total, in whole numbers; decimals hold what 64 bits may not
    middle = (2 * F.col("__before0") + F.col("__size")).cast("decimal(20,0)") * shards
    shard = F.least(F.floor(middle / F.lit(max(1, 2 * total)).cast("decimal(20,0)")).cast("int"), F.lit(shards - 1))
    placed = placed.withColumn("__shard", shard)
    firsts = {r["__shard"]: r["first"] for r in placed.groupBy("__shard").agg(F.min("__before1").alias("first")).collect()}  # a row per shard
    first = F.element_at(F.create_map(*[F.lit(x).cast(kind) for k, v in firsts.items() for x, kind in ((k, "int"), (v, "long"))]), F.col("__shard")) if firsts else F.lit(0)
    return placed.withColumn("__slot", F.col("__before1") - first).drop("__before0", "__before1")


def byte_shards(docs: DataFrame, text: str = "text", key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """All input rows with size, shard and slot, in the order of the key and then of the text's CRC-32."""
    df = packed(docs, F.col(f"`{key}`").alias("__key"), F.crc32(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("__crc"), text_bytes(F.col(f"`{text}`")).alias("__bytes"))
    df = assign(df, F.col("__bytes"), [F.col("__key").asc_nulls_last(), F.col("__crc")], shards)
    return unpacked(df.select(ROW, F.col("__size").alias("size"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot")), docs.columns, "size", "shard", "slot")


def write_shards(docs: DataFrame, folder: str, **options) -> None:
    """The rows below folder/shard=<n>/, each shard's files in the order of its slots."""
    laid = byte_shards(docs, **options)
    laid.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
