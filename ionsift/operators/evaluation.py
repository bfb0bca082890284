"""Retrieval metrics, strata, funnels, bootstrap, gates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .range_join import met


def per_key(ranking: DataFrame, truth: DataFrame, pool: DataFrame | None = None, group: str = "group", key: str = "key", size: int = 25) -> DataFrame:
    """group, rank (0: not in the first ``size``), reciprocal_rank, top1, top5, top25, covered.  truth has (group, key); covered: whether the pool holds it."""
    t = truth.select(group, F.col(key).alias("__t"))
    placed = ranking.where(F.col("rank") <= size).select(group, F.col(key).alias("__t"), "rank")
    hit = placed.join(t, [group, "__t"]).groupBy(group).agg(F.min("rank").alias("rank"))
    rows = t.join(hit, group, "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    if pool is not None:
        p = pool.select(group, F.col(key).alias("__t")).distinct().withColumn("__c", F.lit(1))
        rows = rows.join(p, [group, "__t"], "left").withColumn("covered", F.coalesce("__c", F.lit(0))).drop("__c")
    else:
        rows = rows.withColumn("covered", F.lit(1))
    r = F.col("rank")
    return rows.select(
        group, "rank", F.when(r > 0, 1.0 / r).otherwise(0.0).alias("reciprocal_rank"), (r == 1).cast("int").alias("top1"), r.between(1, 5).cast("int").alias("top5"), (r > 0).cast("int").alias("top25"), "covered"
    )


def report(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """molecules, candidate_recall, mrr25, top1, top5, top25, conditional_mrr25 (over covered ones, null without)."""
    aggs = [
        F.count("*").alias("molecules"), F.avg("covered").alias("candidate_recall"), F.avg("reciprocal_rank").alias("mrr25"), F.avg("top1").alias("top1"), F.avg("top5").alias("top5"),
        F.avg("top25").alias("top25"), F.avg(F.when(F.col("covered") == 1, F.col("reciprocal_rank"))).alias("conditional_mrr25"),
    ]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def strata(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """The report for each value of each dimension on its own, by grouping sets: dimension, value, then the report."""
    names = [f"__d{i}" for i in range(len(dimensions))]
    view = rows.select(*[F.col(d).cast("string").alias(n) for d, n in zip(dimensions, names, strict=True)], "covered", "reciprocal_rank", "top1")
    sets = [[F.col(n)] for n in names]
    out = view.groupingSets(sets, *names).agg(
        F.grouping_id().alias("__set"), F.count("*").alias("molecules"), F.avg("reciprocal_rank").alias("mrr25"), F.avg("top1").alias("top1"), F.avg("covered").alias("candidate_recall")
    )
    # a set's number has a zero where its dimension is
    which = {((1 << len(names)) - 1) ^ (1 << (len(names) - 1 - i)): (d, n) for i, (d, n) in enumerate(zip(dimensions, names, strict=True))}
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (d, n) in which.items():
        dimension, value = F.when(F.col("__set") == k, d).otherwise(dimension), F.when(F.col("__set") == k, F.col(n)).otherwise(value)
    return out.select(dimension.alias("dimension"), value.alias("value"), "molecules", "mrr25", "top1", "candidate_recall")


def paired(a: DataFrame, b: DataFrame, group: str, metric: str = "reciprocal_rank") -> DataFrame:
    """group, a, b, d = b - a, of groups in both."""
    x, y = a.select(group, F.col(metric).alias("a")), b.select(group, F.col(metric).alias("b"))
    return x.join(y, group).withColumn("d", F.col("b") - F.col("a"))


def folds(pairs: DataFrame, fold: Column) -> DataFrame:
    """Per fold: molecules, means of a and b, mean difference."""
    return pairs.groupBy(fold.alias("fold")).agg(F.count("*").alias("molecules"), F.avg("a").alias("a"), F.avg("b").alias("b"), F.avg("d").alias("gain"))


def bootstrap(pairs: DataFrame, group: str, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """gain, low, high: the mean difference and its 95 % interval by a paired Poisson bootstrap.

    Every row gets for every resample a Poisson(1) weight from a hash of both,
    so reruns agree in any partitioning.  A task adds up vectors with a place
    for every resample, and passes on these alone.
    """
    steps, p = [], math.exp(-1)
    for k in range(16):
        steps.append(p + (steps[-1] if steps else 0.0))
        p /= k + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = np.zeros(resamples), np.zeros(resamples)
        with np.errstate(over="ignore"):
            place = np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for b in batches:
                h, d = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
                for at in range(0, len(h), 512):
                    z = h[at : at + 512, None] + place  # a counter-based generator: one state for each row and resample
                    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                        z = (z ^ z >> np.uint64(shift)) * np.uint64(factor)
                    u = ((z ^ z >> np.uint64(31)) >> np.uint64(11)).astype(float) / float(1 << 53)
                    w = np.searchsorted(steps, u, side="right").astype(float)
                    weight += w.sum(0)
                    total += d[at : at + 512] @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(resamples), pa.int32()), pa.array(weight), pa.array(total)], names=["b", "w", "t"])

    rows = pairs.where(F.col("d").isNotNull()).select(F.xxhash64(F.col(group), F.lit(seed)).alias("h"), F.col("d").cast("double").alias("d"))
    drawn = rows.mapInArrow(sums, "b int, w double, t double").groupBy("b").agg((F.sum("t") / F.sum("w")).alias("m"))
    interval = drawn.agg(F.percentile(F.round("m", 12), F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    return pairs.agg(F.avg("d").alias("gain")).crossJoin(F.broadcast(interval))  # one row each


def ladder(df: DataFrame, steps: list[tuple[str, Column]], last: str, name: str = "reason") -> DataFrame:
    """``reason``: the first condition that holds, else the last name."""
    out = None
    for label, condition in steps:
        c = F.coalesce(condition, F.lit(False))
        out = F.when(c, label) if out is None else out.when(c, label)
    return df.withColumn(name, out.otherwise(last))


def bucket(truth_rank: Column, scored: Column, in_window: Column, in_catalog: Column) -> Column:
    """Where a truth was lost: ranked, scored_not_ranked, window_not_scored, catalog_not_window, absent."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(truth_rank > 0, "ranked").when(yes(scored), "scored_not_ranked").when(yes(in_window), "window_not_scored").when(yes(in_catalog), "catalog_not_window").otherwise("absent")


def movement(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Per stratum, from (old_rank, new_rank) of the truths (0: not ranked): molecules, better, worse, top-1 gains and losses, mean change of the reciprocal rank."""
    o, n = F.col("old_rank"), F.col("new_rank")
    rr = lambda x: F.when(x > 0, 1.0 / x).otherwise(0.0)
    return pairs.groupBy(*by).agg(
        F.count("*").alias("molecules"), F.count_if(rr(n) > rr(o)).alias("better"), F.count_if(rr(n) < rr(o)).alias("worse"), F.count_if((n == 1) & (o != 1)).alias("top1_gained"),
        F.count_if((o == 1) & (n != 1)).alias("top1_lost"), F.avg(rr(n) - rr(o)).alias("change"),
    )


def retention(rows: DataFrame, by: list[str], stages: dict[str, Column]) -> DataFrame:
    """Per stratum: molecules, and for each stage how many hold their truth in it and how many lost it there: n_<stage>, lost_<stage>."""
    out, before = [F.count("*").alias("molecules")], F.lit(True)
    for name, there in stages.items():
        has = F.coalesce(there, F.lit(False))
        out += [F.count_if(has).alias(f"n_{name}"), F.count_if(before & ~has).alias(f"lost_{name}")]
        before = has
    return rows.groupBy(*by).agg(*out)


def stability(pairs: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """Per stratum of pairs of sets: pairs, mean Jaccard, and how many are the same, overlap in part, or have nothing in common."""
    a, b = F.col(first), F.col(second)
    return pairs.withColumn("__j", jaccard(a, b)).groupBy(*by).agg(
        F.count("*").alias("pairs"), F.avg("__j").alias("mean_jaccard"), F.count_if(F.col("__j") == 1).alias("same"), F.count_if((F.col("__j") > 0) & (F.col("__j") < 1)).alias("partial"), F.count_if(F.col("__j") == 0).alias("disjoint")
    )


def quantiles(df: DataFrame, value: str, by: list[str], at: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0), accuracy: int = 2000) -> DataFrame:
    """Exact interpolated quantiles: q0, q25, ...  Nulls and NaN don't count.

    A sketch of each group gives, for each quantile, two values between which
    it lies, with few values between them however the group is spread.  What
    lies below is counted, what lies between is counted by value, so that no
    task holds more of a group than about two parts in a thousand.
    """
    v = F.col(value).cast("double")
    rows = df.select(*by, (v + 0.0).alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    error = 1.0 / accuracy  # the sketch's rank is off by as much at most; twice that for places between two values
    ends = [min(1.0, max(0.0, q + s)) for q in at for s in (-2 * error, 2 * error)]
    sketch = rows.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"), F.percentile_approx("__v", ends, accuracy).alias("__ends"))
    few = F.col("__n") <= accuracy  # a group of so few values is taken whole: places between two of them are wider than the sketch's error
    bound = lambda k, least: F.when(few, F.col("__least" if least else "__most")).otherwise(F.col("__least") if ends[k] <= 0 else F.col("__most") if ends[k] >= 1 else F.col("__ends")[k])
    sketch = sketch.withColumn("__spans", F.array(*[F.struct(F.lit(i).alias("i"), bound(2 * i, True).alias("lo"), bound(2 * i + 1, False).alias("hi")) for i in range(len(at))]))
    spans = met(rows, sketch.select(*by, "__spans"), by).select(*by, "__v", F.explode("__spans").alias("__s")).where(F.col("__v") <= F.col("__s.hi"))
    # a null value stands for all that lies below
    counts = spans.groupBy(*by, F.col("__s.i").alias("__i"), F.when(F.col("__v") >= F.col("__s.lo"), F.col("__v")).alias("__x")).agg(F.count("*").alias("__c"))
    counts = counts.withColumn("__to", F.sum("__c").over(Window.partitionBy(*by, "__i").orderBy(F.col("__x").asc_nulls_first())))
    spot = (F.col("__n") - 1) * F.element_at(F.array(*[F.lit(float(q)) for q in at]), F.col("__i") + 1)
    placed = met(counts.where("__x is not null"), sketch.select(*by, "__n"), by)
    holds = lambda p: (p < F.col("__to")) & (p >= F.col("__to") - F.col("__c"))
    low, high = F.max(F.when(holds(F.floor(spot)), F.col("__x"))), F.max(F.when(holds(F.ceil(spot)), F.col("__x")))
    each = placed.groupBy(*by, "__i", spot.alias("__spot")).agg(low.alias("__a"), high.alias("__b"))
    sure = F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.raise_error(F.lit("a quantile lies beyond its bounds")).cast("double"))
    each = each.select(*by, "__i", F.coalesce(sure, F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__spot") - F.floor("__spot"))).alias("__q"))
    return each.groupBy(*by).agg(*[F.max(F.when(F.col("__i") == i, F.col("__q"))).alias(f"q{round(100 * q)}") for i, q in enumerate(at)])


def association(df: DataFrame, strength: str, event: str, edges: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75)) -> DataFrame:
    """Per half-open interval of strength: rows, events, rate."""
    which = F.lit(-1)
    for i, e in enumerate(edges):
        which = F.when(F.col(strength) >= e, i).otherwise(which)
    return df.groupBy(which.alias("interval")).agg(F.count("*").alias("rows"), F.sum(F.col(event).cast("long")).alias("events"), F.avg(F.col(event).cast("double")).alias("rate"))


def contrast(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """wins, losses, ties of b over a."""
    return df.groupBy(*by).agg(F.count_if(F.col(b) > F.col(a)).alias("wins"), F.count_if(F.col(b) < F.col(a)).alias("losses"), F.count_if(F.col(b) == F.col(a)).alias("ties"), F.bool_or(F.col(b) > F.col(a)).alias("any_win"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0)


def break_even(known_change: Column, unknown_change: Column) -> Column:
    """The share of unknowns at which two changes cancel; null outside [0, 1]."""
    x = -known_change / (unknown_change - known_change)
    return F.when((unknown_change != known_change) & x.between(0, 1), x)


def value_lists(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sorted distinct values joined by |."""
    return df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(value)), "|").alias(value))


def seeds(df: DataFrame, by: list[str], metric: str) -> DataFrame:
    """runs, mean, std (population) over seeds."""
    return df.groupBy(*by).agg(F.count("*").alias("runs"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))


def gate(row: dict[str, Column], minimum: dict[str, float]) -> Column:
    """The reasons that reject a new system; empty: eligible.

    The columns are <cohort>_<measure>_<system>: known and unknown molecules;
    molecules, mrr and top1; new and old.
    """
    of = lambda measure: [row[f"{cohort}_{measure}_{system}"] for cohort in ("known", "unknown") for system in ("new", "old")]
    new, old = row["unknown_mrr_new"], row["unknown_mrr_old"]
    gain = new - old
    relative = F.when(old > 0, gain / old).otherwise(F.when(gain > 0, 1.0).otherwise(0.0))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    any_ = lambda xs: F.exists(F.array(*xs), lambda x: x)
    fell = lambda measure: row[f"known_{measure}_new"] + 1e-12 < row[f"known_{measure}_old"] - minimum[f"known_{measure}"]
    reasons = [
        ("cohort_size_mismatch", any_([row[f"{c}_molecules_new"] != row[f"{c}_molecules_old"] for c in ("known", "unknown")])),
        ("nonfinite_metrics", any_([odd(x) for x in (new, old, *(row[f"known_{m}_{s}"] for m in ("mrr", "top1") for s in ("new", "old")))])),
        ("invalid_metric_range", any_([~F.coalesce(x.between(0, 1), F.lit(False)) for x in (*of("mrr"), *of("top1"))])),
        ("invalid_molecule_count", any_([x < 1 for x in of("molecules")])), ("insufficient_development_molecules", F.least(*of("molecules")[2:]) < minimum["molecules"]),
        ("absolute_gain_below_gate", gain + 1e-12 < minimum["absolute"]), ("relative_gain_below_gate", relative + 1e-12 < minimum["relative"]),
        ("known_mrr_protection_failed", fell("mrr")), ("known_top1_protection_failed", fell("top1")), ("no_known_evaluation", F.least(*of("molecules")[:2]) < 1),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in reasons]))


def deployment(mode: Column, accepted: Column, checkpoints: Column, holdout: Column, baseline: Column, known_accepted: Column) -> Column:
    """Struct (mode, note) of what may be deployed: a guarded system only with its own report accepted ('refused' otherwise), a neural one only if it beats the baseline on the holdout and known spectra don't reject it (a missing report does not); else retrieval alone."""
    guarded, retrieval = mode == "confidence_guarded", mode == "historical_hybrid"
    known = ~F.coalesce(known_accepted, F.lit(True))
    beaten = F.coalesce((checkpoints > 0) & (holdout <= baseline), F.lit(False))
    note = F.when(guarded & ~F.coalesce(accepted, F.lit(False)), "no_passing_report").when(guarded | retrieval, None).when(known, "known_spectrum_failure").when(beaten, "not_above_baseline")
    return F.struct(F.when(note == "no_passing_report", "refused").when(note.isNotNull(), "historical_hybrid").otherwise(mode).alias("mode"), note.alias("note"))


def chosen(models: DataFrame, score: str = "mrr25", parameters: str = "parameters", within: float = 0.005) -> DataFrame:
    """Of models within a distance of the best, the one with the fewest parameters; ties by score, then name."""
    best = Window.partitionBy()
    return models.withColumn("__best", F.max(score).over(best)).where(F.col(score) >= F.col("__best") - within).orderBy(parameters, F.col(score).desc(), "name").limit(1).drop("__best")


def ordinal(x: Column) -> Column:
    """The place of a double among all doubles, from its bits: neighbours differ by one, and zeros of either sign are one."""
    size = F.abs(x)
    exponent = F.floor(F.log2(F.when(size > 0, size)))
    # the logarithm may round up to the next whole number, or down from it
    exponent = F.when(F.pow(F.lit(2.0), exponent) > size, exponent - 1).when(F.pow(F.lit(2.0), exponent + 1) <= size, exponent + 1).otherwise(exponent)
    exponent = F.greatest(exponent, F.lit(-1022))
    fraction = size / F.pow(F.lit(2.0), exponent)  # exact: a power of two; from 1 up to 2, below 1 for the smallest numbers
    place = (exponent + 1022) * (1 << 52) + (fraction * float(1 << 52)).cast("long")
    return F.when(size == 0, F.lit(0).cast("long")).otherwise(F.when(x < 0, -place).otherwise(place).cast("long"))


def score_differences(a: DataFrame, b: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """by, a, b, ulps, same: two score maps joined in full, with the number of doubles from one to the other."""
    x, y = a.select(*by, F.col(score).alias("a")), b.select(*by, F.col(score).alias("b"))
    both = x.join(y, by, "full")
    return both.select(*by, "a", "b", F.abs(ordinal(F.col("a")) - ordinal(F.col("b"))).alias("ulps"), F.col("a").eqNullSafe(F.col("b")).alias("same"))
