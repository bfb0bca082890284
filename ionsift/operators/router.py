"""The learned router: features of a molecule's rankings, folds, logistic or tree models, chosen actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.hashing import fold_of

FEATURES = [
    "confidence", "margin", "relative_margin", "log_candidates", "spectra", "mean_peaks", "center", "entropy", "expected_bits", "neural_top", "neural_margin",
    "historical_in_neural", "neural_in_historical", "neural_in_union", "same_first", "overlap5", "overlap25",
]


def bit_entropy(probabilities: Column, eps: float = 1e-6) -> Column:
    """Mean Bernoulli entropy of an array of probabilities."""
    clipped = F.transform(probabilities, lambda p: F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps)))
    total = F.aggregate(clipped, F.lit(0.0), lambda s, p: s - (p * F.log(p) + (1 - p) * F.log1p(-p)))
    return total / F.size(probabilities)


def features(df: DataFrame) -> DataFrame:
    """FEATURES from one row a molecule: confidence, margin, candidates, spectra, mean_peaks, center, probabilities, historical, neural, union (arrays), neural_scores."""
    h0, n0 = F.get("historical", F.lit(0)), F.get("neural", F.lit(0))
    s = F.col("neural_scores")
    values = {
        "relative_margin": F.col("margin") / F.greatest("confidence", F.lit(1e-6)), "log_candidates": F.log1p("candidates"), "center": F.coalesce("center", F.lit(0.0)), "entropy": bit_entropy(F.col("probabilities")),
        "expected_bits": F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p), "neural_top": F.coalesce(F.get(s, F.lit(0)), F.lit(-100.0)), "neural_margin": F.coalesce(F.get(s, F.lit(0)) - F.get(s, F.lit(1)), F.lit(0.0)),
        "historical_in_neural": lists.reciprocal_rank(h0, F.col("neural")), "neural_in_historical": lists.reciprocal_rank(n0, F.col("historical")), "neural_in_union": lists.reciprocal_rank(n0, F.col("union")),
        "same_first": F.coalesce((h0 == n0).cast("double"), F.lit(0.0)), "overlap5": lists.overlap(F.col("historical"), F.col("neural"), 5), "overlap25": lists.overlap(F.col("historical"), F.col("neural"), 25),
    }
    return df.withColumns({k: v.cast("double") for k, v in values.items()})


def out_of_fold(df: DataFrame, key: str, columns: list[str], label: str, folds: int = 5, model: str = "logistic", regularization: float = 0.3) -> DataFrame:
    """The table with ``fold`` and ``reliability``: the probability by a model of the other folds' rows.

    One distributed fit a fold, a fixed number of them.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = df.withColumn("fold", fold_of(F.col(key), folds)).withColumn("__label", F.col(label).cast("double"))
    out = None
    for k in range(folds):
        steps = [VectorAssembler(inputCols=columns, outputCol="__x", handleInvalid="keep"), StandardScaler(inputCol="__x", outputCol="__z", withMean=True)]
        if model == "logistic":
            last = LogisticRegression(featuresCol="__z", labelCol="__label", probabilityCol="__p", rawPredictionCol="__r", predictionCol="__y", regParam=regularization, maxIter=50)
        else:
            last = GBTClassifier(featuresCol="__z", labelCol="__label", predictionCol="__y", maxIter=20, maxDepth=3, seed=42).setProbabilityCol("__p").setRawPredictionCol("__r")
        fitted = Pipeline(stages=[*steps, last]).fit(rows.where(F.col("fold") != k))
        part = fitted.transform(rows.where(F.col("fold") == k)).withColumn("reliability", vector_to_array("__p")[1]).select(*df.columns, "fold", "reliability")
        out = part if out is None else out.unionByName(part)
    return out


def actions(df: DataFrame, policies: DataFrame) -> DataFrame:
    """Each molecule under each policy (name, threshold, guard): action 'historical' or 'neural'.

    The historical ranking stays where the confidence reaches the guard or
    the router's reliability the threshold.  Policies are a grid of a few
    dozen rows, so the product grows only with the molecules.
    """
    both = df.crossJoin(F.broadcast(policies))
    stays = (F.col("confidence") >= F.col("guard")) | (F.col("reliability") >= F.col("threshold"))
    return both.withColumn("action", F.when(stays, "historical").otherwise("neural"))


def policy_grid(spark, thresholds: list[float], guards: list[float]) -> DataFrame:
    return spark.createDataFrame([(f"t{t:g}_g{g:g}", float(t), float(g)) for t in thresholds for g in guards], "name string, threshold double, guard double")


def standardized(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, std): population deviation, at least 1."""
    each = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.greatest(F.stddev_pop(c), F.lit(1.0)).alias(f"s{i}") for i, c in enumerate(columns)])
    return each.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std")) for i, c in enumerate(columns)])).alias("r")).select("r.*")


def fit_preprocessing(df: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """One row: mean and deviation (population, at least 1) of each number, and each category's values in order, missing among them."""
    from ..functions.text import category

    means, stds = [F.avg(c) for c in numbers], [F.greatest(F.stddev_pop(c), F.lit(1.0)) for c in numbers]
    return df.agg(F.array(*means).alias("mean"), F.array(*stds).alias("std"), *[F.array_sort(F.collect_set(category(F.col(c)))).alias(f"values_{c}") for c in categories])


def assembled(df: DataFrame, fitted: DataFrame, numbers: list[str], categories: list[str], name: str = "features") -> DataFrame:
    """The table with its vector: standardised numbers, then a one for each category's value, the last place for values that were not fitted."""
    from ..functions.text import one_hot_column

    pieces = [F.array(*[(F.col(c) - F.col("mean")[i]) / F.col("std")[i] for i, c in enumerate(numbers)])]
    both = df.crossJoin(F.broadcast(fitted))  # one row: a vocabulary of categories
    return both.withColumn(name, F.concat(*pieces, *[one_hot_column(F.col(c), F.col(f"values_{c}")) for c in categories])).drop(*fitted.columns)


def ridge_solve(moments: DataFrame, size: int, penalty: float) -> list[float]:
    """The coefficients that ridge_moments() give, solved on the driver: a system as large as the columns are many."""
    import numpy as np

    a, b = np.zeros((size, size)), np.zeros(size)
    for r in moments.collect():
        if r["j"] < 0:
            b[r["i"]] = r["value"]
        else:
            a[r["i"], r["j"]] = a[r["j"], r["i"]] = r["value"]
    return np.linalg.solve(a + penalty * np.eye(size), b).tolist()


def ridge_moments(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(i, j, value): the sums of products of all pairs of columns, and with the label (j = -1)."""
    from .learning import products

    n = len(columns)
    sums = products(df, [*columns, label]).where(F.col("i") < n)
    return sums.select("i", F.when(F.col("j") == n, -1).otherwise(F.col("j")).alias("j"), "value")
