"""Ranks, top k, and scores relative to their group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE = 25


def ranked(df: DataFrame, group: list[str], score: str = "score", key: str = "key", name: str = "rank") -> DataFrame:
    """Rows with their rank by falling score, then by key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(F.col(score).desc(), key)))


def stably_ranked(df: DataFrame, group: list[str], order: str, score: str = "score", name: str = "rank") -> DataFrame:
    """Rows with their rank by falling score; equals keep their input order, given as a column."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(F.col(score).desc(), order)))


def top(df: DataFrame, group: list[str], k: int = SIZE, score: str = "score", key: str = "key") -> DataFrame:
    """The first k rows of each group; Spark cuts each task's groups before the shuffle."""
    return ranked(df, group, score, key).where(F.col("rank") <= k)


def competition_rank(group: list[str], score: str) -> Column:
    """1 plus the number of larger scores."""
    return F.rank().over(Window.partitionBy(*group).orderBy(F.col(score).desc()))


def rank_share(group: list[str], score: str, key: str) -> Column:
    """Rank from the lowest over the group's size less one, from 0 to 1; ties by key."""
    w, whole = Window.partitionBy(*group).orderBy(F.col(score), F.col(key)), Window.partitionBy(*group)
    return (F.row_number().over(w) - 1) / F.greatest(F.count("*").over(whole) - 1, F.lit(1))


def z_score(group: list[str], score: str, least: float = 1e-9) -> Column:
    """Standard score within the group, 0 where its deviation is next to none."""
    w = Window.partitionBy(*group)
    sd = F.stddev_pop(score).over(w)
    return F.when(sd > least, (F.col(score) - F.avg(score).over(w)) / sd).otherwise(0.0)


def below_best(group: list[str], score: str) -> Column:
    return F.col(score) - F.max(score).over(Window.partitionBy(*group))


def confidence_margin(df: DataFrame, group: list[str], score: str = "score", key: str = "key") -> DataFrame:
    """Per group: leader, confidence (its score), margin over the second (0 without one), keys."""
    two = ranked(df, group, score, key)
    return two.groupBy(*group).agg(
        F.min_by(key, "rank").alias("leader"), F.min_by(score, "rank").alias("confidence"),
        F.coalesce(F.max(F.when(F.col("rank") == 1, F.col(score))) - F.max(F.when(F.col("rank") == 2, F.col(score))), F.lit(0.0)).alias("margin"), F.count("*").alias("keys"),
    )


def lists(df: DataFrame, group: list[str], value: str = "key", k: int = SIZE, rank: str = "rank") -> DataFrame:
    """(group, ranking): the first k values as an array in order."""
    few = df.where(F.col(rank) <= k).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(value).alias("v")))).alias("__l"))
    return few.select(*group, F.transform("__l", lambda p: p["v"]).alias("ranking"))


def exploded(df: DataFrame, group: list[str], ranking: str = "ranking", key: str = "key") -> DataFrame:
    """(group, key, rank) of arrays."""
    return df.select(*group, F.posexplode(ranking).alias("__p", key)).select(*group, key, (F.col("__p") + 1).alias("rank"))


def popular(df: DataFrame, value: str, k: int = SIZE) -> DataFrame:
    """The k most frequent values: value, n; ties by value."""
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), value).limit(k)


def hash_sample(df: DataFrame, key: str, row: str, k: int, seed: str = "sample") -> DataFrame:
    """k rows of each key by the order of a hash: the same ones whatever the partitions."""
    from ..functions.hashing import digest

    w = Window.partitionBy(key).orderBy(digest(F.concat_ws(":", F.col(key).cast("string"), F.col(row).cast("string")), seed + ":"), row)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def single_pick(df: DataFrame, key: str, row: str) -> DataFrame:
    """One row of each key: the one a hash of the key points at, in the order of a row column."""
    from ..functions.hashing import pick_of

    w = Window.partitionBy(key)
    numbered = df.withColumn("__n", F.row_number().over(w.orderBy(row)) - 1).withColumn("__of", F.count("*").over(w))
    return numbered.where(F.col("__n") == pick_of(F.col(key), F.col("__of"))).drop("__n", "__of")


def first_by_hash(df: DataFrame, key: str, limit: int, prefix: str = "42:") -> DataFrame:
    """The rows whose keys have the smallest digests."""
    from ..functions.hashing import digest

    return df.orderBy(digest(F.col(key), prefix), key).limit(limit)


def representative(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("__n = 1").drop("__n")


def best_keys(df: DataFrame, group: list[str], key: str = "key", score: str = "score", k: int = 80) -> DataFrame:
    """(group, key, score, rank): the k keys of the largest best score."""
    return top(df.groupBy(*group, key).agg(F.max(score).alias(score)), group, k, score, key)


def two_pass_top(df: DataFrame, group: list[str], cheap: str, popularity: str, full: Column, key: str, keep: int = 5000, popular_keep: int = 200, size: int = SIZE, pool: DataFrame | None = None) -> DataFrame:
    """The rows best by a cheap score, and the most popular ones, ranked by the full score: the first ``size`` of each group that have a key and, with a pool (group, key), are not in it."""
    w = Window.partitionBy(*group)
    near = df.withColumn("__c", F.row_number().over(w.orderBy(F.col(cheap).desc(), key))).withColumn("__p", F.row_number().over(w.orderBy(F.col(popularity).desc(), key)))
    near = near.where((F.col("__c") <= keep) | (F.col("__p") <= popular_keep)).drop("__c", "__p").withColumn("score", full).where(F.col(key).isNotNull())
    if pool is not None:
        near = near.join(pool.select(*group, key).distinct(), [*group, key], "left_anti")
    return top(near, group, size, "score", key)


def best_gap(df: DataFrame, group: list[str], score: str, outside: Column) -> DataFrame:
    """Per group: the best score outside the pool less the best within; null if either is empty."""
    return df.groupBy(*group).agg((F.max(F.when(outside, F.col(score))) - F.max(F.when(~outside, F.col(score)))).alias("gap"))
