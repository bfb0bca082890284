"""What a ranker learns from: a candidate relative to its group, from five sources, in one exchange by group."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import new_folder

#: Levels of a feature, with one for missing values (trees tell 32 apart), and rows from which their bounds are taken, about.
LEVELS, EDGES = 32, 200_000
#: Rows of a task that works features out, about: some 30 MB, which are sorted for each place without a spill.
TASK = 50_000

#: What candidate_features() asks for, a number each for a candidate; null counts as 0.
SOURCES = {
    "library": "score of the best library spectrum of the structure itself", "analog": "best Tanimoto with an analog, weighed by the cube of its score", "analog_plain": "the same, weighed by the score",
    "analog_best": "best Tanimoto with any analog", "analog_first": "Tanimoto with the best analog", "analog_mean": "mean Tanimoto, weighed by the cube of scores", "analog_top": "score of the best analog",
    "log_odds": "sum of the log-odds of the structure's bits", "bits": "how many bits it has", "fragments": "share of the peaks that its fragments explain", "mass": "mass", "center": "mass asked for",
    "library_mean": "mean score of its library spectra", "library_shifted": "best score with shifted peaks", "library_count": "its library spectra", "fragments_adduct": "explained share by the adduct's carriers",
    "fragments_mean": "mean explained share over spectra", "fragments_modes": "explained share in both ion modes",
}


def candidate_features(rows: DataFrame, group: str = "group", key: str = "key", kept: tuple[str, ...] = ()) -> DataFrame:
    """(group, key, the columns of ``names()``, and the rows' own that are to be kept).

    All windows are by group, so that rows are exchanged once; what is
    relative is a value less the group's largest, its place from the largest
    (0) to the smallest (1), ties by key, and its standard score.
    """
    whole = Window.partitionBy(group)
    own = rows.select(group, key, *kept, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in SOURCES])
    per = lambda f: f.over(whole)
    n = per(F.count("*"))
    place = lambda c: (F.row_number().over(whole.orderBy(F.col(c).desc(), key)) - 1) / F.greatest(n - 1, F.lit(1))
    below = lambda c: F.col(c) - per(F.max(c))

    def standard(c: str) -> Column:
        sd = per(F.stddev_pop(c))
        return F.when(sd > 1e-9, (F.col(c) - per(F.avg(c))) / sd).otherwise(0.0)

    # places are named first: what follows joins them with other values
    named = own.withColumn("odds_per_bit", F.col("log_odds") / F.sqrt(F.greatest("bits", F.lit(1.0))))
    named = named.withColumns({f"{c}_place": place(c) for c in ("library", "analog", "log_odds", "odds_per_bit", "fragments", "library_mean", "library_shifted", "fragments_adduct", "fragments_mean")})
    rest = 1 - F.col("log_odds_place")
    first = lambda c: F.when(per(F.max(c)) > 0, per(F.max(F.when(F.col(f"{c}_place") == 0, rest)))).otherwise(0.0)  # noqa: E731  the log-odds' opinion of the best by c
    ppm = (F.col("mass") - F.col("center")) / F.col("center") * 1e6
    spread = (per(F.stddev_pop("library")) > 1e-9) & (per(F.stddev_pop("log_odds_place")) > 1e-9)
    together = per(F.avg(F.col("library") * F.col("log_odds_place"))) - per(F.avg("library")) * per(F.avg("log_odds_place"))
    correlation = -together / (per(F.stddev_pop("library")) * per(F.stddev_pop("log_odds_place")))  # corr() fails where one of them is constant
    count = F.log1p("library_count")
    out = {
        "library": F.col("library"), "library_place": F.col("library_place"), "library_top": per(F.max("library")), "library_below": below("library"), "library_known": (F.col("library") > 0).cast("double"),
        "analog": F.col("analog"), "analog_place": F.col("analog_place"), "analog_most": per(F.max("analog")), "analog_below": below("analog"),
        "analog_plain": F.col("analog_plain"), "analog_best": F.col("analog_best"), "analog_first": F.col("analog_first"), "analog_mean": F.col("analog_mean"), "analog_top": F.col("analog_top"), "candidates": F.log(n.cast("double")),
        "odds_standard": standard("log_odds"), "odds_place": F.col("log_odds_place"), "odds_below": below("log_odds"), "odds_per_bit_standard": standard("odds_per_bit"), "odds_per_bit_place": F.col("odds_per_bit_place"),
        "odds_leads": (F.col("log_odds") == per(F.max("log_odds"))).cast("double"),
        "fragments": F.col("fragments"), "fragments_place": F.col("fragments_place"), "fragments_below": below("fragments"), "fragments_standard": standard("fragments"),
        "library_and_odds": F.col("library") * rest, "analog_and_odds": F.col("analog") * rest, "library_agreed": first("library"), "analog_agreed": first("analog"), "library_agreed_top": first("library") * per(F.max("library")),
        "library_odds_correlation": F.when(spread, correlation).otherwise(0.0),
        "ppm": ppm, "ppm_size": F.abs(ppm), "ppm_shifted": F.abs(ppm + 1.5),
        "library_mean": F.col("library_mean"), "library_mean_place": F.col("library_mean_place"), "library_mean_below": below("library_mean"), "library_shifted": F.col("library_shifted"), "library_shifted_place": F.col("library_shifted_place"),
        "library_shifted_below": below("library_shifted"), "library_count": count, "library_count_below": count - F.log1p(per(F.max("library_count"))),
        "fragments_adduct": F.col("fragments_adduct"), "fragments_adduct_place": F.col("fragments_adduct_place"), "fragments_adduct_below": below("fragments_adduct"), "fragments_mean": F.col("fragments_mean"),
        "fragments_mean_place": F.col("fragments_mean_place"), "fragments_mean_below": below("fragments_mean"), "fragments_modes": F.col("fragments_modes"),
    }
    return named.select(group, key, *[c.cast("double").alias(f"f_{name}") for name, c in out.items()], *kept)


def names(features: DataFrame) -> list[str]:
    """The feature columns in order."""
    return [c for c in features.columns if c.startswith("f_")]


def _levels(rows: DataFrame, group: str) -> DataFrame:
    """Rows whose features are numbers of levels, at most as many as trees tell apart; the levels' bounds are quantiles of about EDGES rows of whole groups, as trees would take them of a sample, and every row is kept."""
    from pyspark.ml.feature import Bucketizer

    share = min(1.0, EDGES / max(rows.count(), 1))
    some = rows.where(F.pmod(F.xxhash64(F.col(group).cast("string"), F.lit("edges")), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    columns = names(rows)
    found = some.approxQuantile(columns, [i / (LEVELS - 1) for i in range(1, LEVELS - 1)], 1e-3)
    bounds = [[-float("inf"), *(sorted(set(b)) or [0.0]), float("inf")] for b in found]
    cut = Bucketizer(inputCols=columns, outputCols=[f"__{c}" for c in columns], splitsArray=bounds, handleInvalid="keep").transform(rows)
    return cut.select(*[c for c in rows.columns if c not in columns], *[F.col(f"__{c}").cast("byte").alias(c) for c in columns])


def _tasks(rows: DataFrame) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK))


def spread(rows: DataFrame, group: str) -> DataFrame:
    """The rows exchanged by group to as many tasks as their number asks for, from which candidate_features() and out_of_fold() go on without another exchange."""
    return rows.repartition(_tasks(rows), group)


def _by_group(rows: DataFrame, group: str) -> DataFrame:
    """The rows of spread() written once to the shared folder, in buckets of their group, so that whatever needs groups together reads them without an exchange."""
    spark, name = rows.sparkSession, f"ionsift_{uuid.uuid4().hex}"
    n = _tasks(rows)
    rows.write.bucketBy(n, group).option("path", new_folder(spark, "ranker")).saveAsTable(name)
    return spark.table(name)


def out_of_fold(features: DataFrame, labels: DataFrame | None = None, group: str = "group", key: str = "key", folds: int = 2, trees: int = 20, depth: int = 3) -> DataFrame:
    """(group, key, score, rank): each group ranked by trees that were grown on other groups alone.

    labels is (group, key, label): 1 for right candidates; without it they are
    a column of the features, which come from spread() rows.  Groups go to
    folds whole, by a hash; a fold
    whose other groups have one class alone scores 0.5.

    Features are worked out once: a table of their levels, a byte each, is
    what trees are grown on and what they score, and what keeps groups together.
    """
    from .learning import weighted_trees
    from .ranking import ranked

    rows = spread(features.join(labels, [group, key]), group) if labels is not None else features.where(F.col(group).isNotNull() & F.col(key).isNotNull())
    scored = table = _by_group(_levels(rows, group), group)
    fold = F.pmod(F.xxhash64(F.col(group).cast("string")), F.lit(folds))
    score = F.lit(0.5)
    for k in range(folds):
        train = table.where(fold != k)
        if train.select("label").distinct().limit(2).count() == 2:
            scored = weighted_trees(train, scored, names(table), "label", trees, depth).withColumnRenamed("probability", f"__p{k}")
            score = F.when(fold == k, F.col(f"__p{k}")).otherwise(score)
    return ranked(scored.select(group, key, F.round(score, 9).alias("score")), [group], "score", key)
