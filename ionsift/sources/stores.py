"""Reference indexes: several of them from one scan, and vectors kept by band of mass for window joins without an exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.mass import mass_tolerance

#: Width of the bands in which windows are merged and stores are bucketed.
BAND = 0.25


def target_intervals(targets: DataFrame, ppm: float = 35.0, center: str = "center") -> DataFrame:
    """(index, band, low, high, first, last) of targets (index, center): the masses within a tolerance of their own of any target, as intervals that don't overlap within a band.

    Windows are cut at the bands' ends and merged within them, so that no task
    orders all targets; first and last are the targets at an interval's ends.
    """
    c, share = F.col(center).cast("double"), ppm * 1e-6
    known = targets.where(c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf"))).select("index", c.alias("t")).distinct()
    low, high = F.col("t") / (1 + share) * (1 - 1e-12), F.col("t") / (1 - share) * (1 + 1e-12)  # a hair wider: the ends are tested exactly
    pieces = known.withColumn("lo", low).withColumn("hi", high).withColumn("band", F.explode(F.sequence(F.floor(F.col("lo") / BAND), F.floor(F.col("hi") / BAND))))
    order = Window.partitionBy("index", "band").orderBy("t")
    opens = F.coalesce((F.col("lo") > F.lag("hi").over(order)).cast("int"), F.lit(1))
    numbered = pieces.withColumn("opens", opens).withColumn("n", F.sum("opens").over(order))
    return numbered.groupBy("index", "band", "n").agg(F.min("lo").alias("low"), F.max("hi").alias("high"), F.min("t").alias("first"), F.max("t").alias("last")).drop("n")


def tagged(rows: DataFrame, targets: DataFrame, mass: str = "mass", ppm: float = 35.0) -> DataFrame:
    """The rows once for every index that they belong to, with its name in ``index``.

    targets is (index, center).  A row belongs to an index if any of its
    targets lies within the tolerance of the row's own mass.  The rows are
    scanned once for all indexes, and meet one interval of each at most.
    """
    m = F.col(mass).cast("double")
    spans = target_intervals(targets, ppm).select("index", F.col("band").alias("__band"), "low", "high", "first", "last")
    near = lambda t: F.abs(m - F.col(t)) <= m * (ppm * 1e-6)
    inside = m.between(F.col("low"), F.col("high")) & ((m >= F.col("first")) | near("first")) & ((m <= F.col("last")) | near("last"))
    fine = rows.where(m.isNotNull() & ~F.isnan(m)).withColumn("__band", F.floor(m / BAND))
    return fine.join(spans, "__band").where(inside).select(*[f"`{c}`" for c in rows.columns], "index")


def write_indexes(rows: DataFrame, targets: DataFrame, path: str, mass: str = "mass", ppm: float = 35.0) -> None:
    """tagged() rows, a folder for each index: one scan, one write."""
    tagged(rows, targets, mass, ppm).write.mode("overwrite").partitionBy("index").parquet(path)


def read_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """One of the indexes; only its folder is read."""
    return spark.read.parquet(path).where(F.col("index") == index).drop("index")


def _band(value: Column, width: float) -> Column:
    return F.floor(value / width).cast("long")


def write_store(rows: DataFrame, name: str, path: str | None = None, mass: str = "mass", buckets: int = 64, width: float = BAND) -> None:
    """A table of vectors, or of anything that has a mass, bucketed by band and sorted within: made once, whatever is asked of it later.  Rows without a positive finite mass go."""
    m = F.col(mass)
    kept = rows.where(m.isNotNull() & ~F.isnan(m) & (m > 0) & (m < float("inf"))).withColumn("band", _band(m, width))
    # dealt by band first, so that a bucket is one file and not one of each task
    writer = kept.repartition(buckets, "band").write.mode("overwrite").bucketBy(buckets, "band").sortBy("band", mass).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def store_window(centers: DataFrame, name: str, center: str = "center", mass: str = "mass", ppm: float = 35.0, floor: float = 0.006, width: float = BAND) -> DataFrame:
    """range_join.mass_window() over a store: only the centers are exchanged, by the bands that their windows touch; the store's side is read as it lies."""
    spark = centers.sparkSession
    store = spark.table(name)
    c = F.col(center)
    asked = centers.where(c.isNotNull() & ~F.isnan(center)).withColumn("__low", c - mass_tolerance(c, ppm, floor)).withColumn("__high", c + mass_tolerance(c, ppm, floor))
    asked = asked.withColumn("band", F.explode(F.sequence(_band(F.col("__low"), width), _band(F.col("__high"), width))))
    return asked.hint("merge").join(store, "band").where(F.col(mass).between(F.col("__low"), F.col("__high"))).drop("band", "__low", "__high")
