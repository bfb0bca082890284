"""Fusion of rankings in the long form (group, key, rank), and reranking by evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked

#: Scores are compared after rounding: sums come in any order, and what ties on paper is to tie here.
DIGITS = 12


def rrf(rankings: list[DataFrame], group: list[str], weights: list[float] | None = None, offset: float = 60.0, key: str = "key") -> DataFrame:
    """(group, key, score, rank): sums of weight / (offset + rank), ties by key.  Lists of weight 0 vanish with the keys only they hold; without weights all count alike."""
    weights = weights or [1 / len(rankings)] * len(rankings)
    kept = [r.select(*group, key, (F.lit(float(w)) / (offset + F.col("rank"))).alias("__s")) for r, w in zip(rankings, weights, strict=True) if w]
    if not kept:
        return rankings[0].select(*group, key, F.lit(0.0).alias("score"), F.col("rank")).limit(0)
    all_ = kept[0]
    for k in kept[1:]:
        all_ = all_.unionByName(k)
    return ranked(all_.groupBy(*group, key).agg(F.round(F.sum("__s"), DIGITS).alias("score")), group, "score", key)


def ensemble_rrf(baseline: DataFrame, members: list[DataFrame], group: list[str], weight: float, key: str = "key") -> DataFrame:
    """The members' rankings fused with equal votes first, and that ranking with the baseline by its weight."""
    if not 0 <= weight <= 1:
        raise ValueError("weight in [0, 1]")
    together = rrf(members, group, key=key).select(*group, key, "rank")
    return rrf([baseline, together], group, [1 - weight, weight], key=key)


def ordered_rrf(rankings: list[DataFrame], group: list[str], weights: list[float], offset: float = 3.0, size: int = 40, key: str = "key", value: str = "value") -> DataFrame:
    """Fusion that keeps each key's first value, with ties by where a key came first; null keys count for nothing: (group, key, value, score, rank)."""
    parts = [r.where(F.col(key).isNotNull()).select(*group, key, value, (F.lit(float(w)) / (offset + F.col("rank"))).alias("__s"), F.struct(F.lit(i).alias("l"), F.col("rank").alias("r")).alias("__at")) for i, (r, w) in enumerate(zip(rankings, weights, strict=True))]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    sums = all_.groupBy(*group, key).agg(F.round(F.sum("__s"), DIGITS).alias("score"), F.min_by(value, "__at").alias(value), F.min("__at").alias("__at"))
    w = Window.partitionBy(*group).orderBy(F.col("score").desc(), "__at")
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size).drop("__at")


def one_vote(ranking: DataFrame, group: list[str], identity: str) -> DataFrame:
    """A ranking's first row of each identity, ranked anew without gaps; null identities go."""
    first = Window.partitionBy(*group, identity).orderBy("rank")
    kept = ranking.where(F.col(identity).isNotNull()).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("rank")))


def identity_fusion(first: DataFrame, second: DataFrame, group: list[str], identity: str, value: str, alpha: float = 0.6, offset: float = 3.0, size: int = 40) -> DataFrame:
    """One vote per identity and list, compact ranks, then ordered_rrf()."""
    return ordered_rrf([one_vote(first, group, identity), one_vote(second, group, identity)], group, [1.0, alpha], offset, size, identity, value)


def rerank(base: DataFrame, evidence: DataFrame, group: list[str], weight: float = 0.25, top: int = 100, key: str = "key") -> DataFrame:
    """base (group, key, rank) by evidence (group, key, evidence): (group, key, fused, rank).

    (1 - w) / (60 + rank) and, for the first ``top``, w / (60 + competition
    rank by evidence); missing evidence is 0.  A group keeps its order if all
    evidence ties.
    """
    if not 0 <= weight <= 1 or top < 1:
        raise ValueError("weight in [0, 1] and at least one place")
    rows = base.join(evidence.select(*group, key, F.col("evidence").alias("__e")), [*group, key], "left")
    rows = rows.withColumn("__e", F.when(F.col("rank") <= top, F.coalesce("__e", F.lit(0.0))))
    w = Window.partitionBy(*group)
    rows = rows.withColumn("__place", F.when(F.col("__e").isNotNull(), F.rank().over(w.orderBy(F.col("__e").desc_nulls_last()))))
    rows = rows.withColumn("__tied", F.min("__e").over(w).eqNullSafe(F.max("__e").over(w)) | F.lit(weight == 0))
    fused = (1 - weight) / (60 + F.col("rank")) + F.coalesce(weight / (60 + F.col("__place")), F.lit(0.0))
    rows = rows.withColumn("fused", F.round(F.when(F.col("__tied"), 1.0 / (60 + F.col("rank"))).otherwise(fused), DIGITS))
    return rows.withColumn("__old", F.col("rank")).withColumn("rank", F.row_number().over(w.orderBy(F.col("fused").desc(), "__old"))).select(*group, key, "fused", "rank")


def slot_rerank(df: DataFrame, group: list[str], same: list[str], new_score: str, key: str = "key") -> DataFrame:
    """Rows permuted among the places their own subgroup (``same``) holds, by a new score: the places stay, their order within changes."""
    w = Window.partitionBy(*group, *same)
    places = df.withColumn("__i", F.row_number().over(w.orderBy("rank"))).select(*group, *same, "__i", F.col("rank").alias("__place"))
    rows = df.withColumn("__i", F.row_number().over(w.orderBy(F.col(new_score).desc(), "rank")))
    return rows.join(places, [*group, *same, "__i"]).withColumn("rank", F.col("__place")).drop("__i", "__place")


def blended(first: Column, second: Column, weight: float = 0.12) -> Column:
    """(1 - w) of one rank share, w of another."""
    return (1 - weight) * first + weight * second


def movement(old: DataFrame, new: DataFrame, group: list[str], key: str = "key") -> DataFrame:
    """(group, key, old_rank, new_rank) of keys in either."""
    a, b = old.select(*group, key, F.col("rank").alias("old_rank")), new.select(*group, key, F.col("rank").alias("new_rank"))
    return a.join(b, [*group, key], "full")


def deduplicated(df: DataFrame, group: list[str], identity: str, size: int = 25) -> DataFrame:
    """The first row of each identity in the order of rank, ranked anew, up to a size."""
    return one_vote(df, group, identity).where(F.col("rank") <= size)


def scoreable_reordered(df: DataFrame, group: list[str], score: str, key: str = "key") -> DataFrame:
    """Rows with a score permuted among their own places, half by place and half by competition rank of the score; the others stay."""
    valid = df.where(F.col(score).isNotNull())
    order = Window.partitionBy(*group).orderBy("rank")
    base = valid.select(*group, key, F.row_number().over(order).alias("rank"))
    new = rerank(base, valid.select(*group, key, F.col(score).alias("evidence")), group, 0.5, 2**31 - 1, key)
    places = valid.select(*group, F.row_number().over(order).alias("__i"), F.col("rank").alias("__place"))
    moved = new.select(*group, key, F.col("rank").alias("__i")).join(places, [*group, "__i"]).select(*group, key, F.col("__place").alias("rank"))
    return moved.unionByName(df.where(F.col(score).isNull()).select(*group, key, "rank"))


def generated_order(df: DataFrame, group: list[str], alpha: float = 1.0, chemical: float = 0.25, formula: float = 0.25, frequency: float = 0.0, critic: float = 0.0, key: str = "key") -> DataFrame:
    """(group, key, rank) of generated candidates: by log_probability over length to a power, then reranked by chemical_score, formula_support, sample_count and critic, each with its weight (0: not at all)."""
    if not 0 <= alpha <= 1:
        raise ValueError("the length's exponent is within [0, 1]")
    score = F.round(F.col("log_probability") / F.pow(F.greatest(F.col("length"), F.lit(1)), F.lit(alpha)), DIGITS)
    ranks = df.withColumn("__s", score).select(*group, key, F.row_number().over(Window.partitionBy(*group).orderBy(F.col("__s").desc(), key)).alias("rank"))
    for column, weight in (("chemical_score", chemical), ("formula_support", formula), ("sample_count", frequency), ("critic", critic)):
        if weight:
            ranks = rerank(ranks, df.select(*group, key, F.col(column).cast("double").alias("evidence")), group, weight, 2**31 - 1, key).select(*group, key, "rank")
    return ranks
