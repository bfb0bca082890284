"""Peak lists: two parallel arrays of m/z and intensity, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body names it: an expression inside a lambda would be evaluated for every element."""
    return F.transform(F.array(value), body)[0]


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)


def zipped(mz: Column, intensity: Column) -> Column:
    """Array of (mz, i, at); the shorter list counts as missing beyond its end."""
    pairs = F.arrays_zip(mz.alias("mz"), intensity.alias("i"))
    return F.transform(pairs, lambda p, at: F.struct(p["mz"].cast("double").alias("mz"), p["i"].cast("double").alias("i"), at.alias("at")))


def strongest(peaks: Column, most: int) -> Column:
    """The most intense peaks, the earlier of equals first, back in their order."""
    ranked = F.slice(F.array_sort(F.transform(peaks, lambda p: F.struct((-p["i"]).alias("k"), p["at"].alias("at"), p.alias("p")))), 1, most)
    return F.transform(F.array_sort(F.transform(ranked, lambda r: F.struct(r["at"].alias("at"), r["p"].alias("p")))), lambda r: r["p"])


def library_peaks(mz: Column, intensity: Column, most: int = 100) -> Column:
    """Finite peaks of intensity 0.01 at least within [40, 1250), the 100 most intense."""
    fine = lambda p: finite(p["mz"]) & finite(p["i"]) & (p["i"] >= 0.01) & (p["mz"] >= 40) & (p["mz"] < 1250)
    return strongest(F.filter(zipped(mz, intensity), fine), most)


def usable(mz: Column, intensity: Column) -> Column:
    """Whether library_peaks() keeps any; false for null."""
    fine = lambda p: finite(p["mz"]) & finite(p["i"]) & (p["i"] >= 0.01) & (p["mz"] >= 40) & (p["mz"] < 1250)
    return F.coalesce(F.exists(zipped(mz, intensity), fine), F.lit(False))


def _by_mz(peaks: Column) -> Column:
    return F.transform(F.array_sort(F.transform(peaks, lambda p: F.struct(p["mz"].alias("mz"), p["at"].alias("at"), p["i"].alias("i")))), lambda p: F.struct(p["mz"].alias("mz"), p["i"].alias("i")))


def _unit(peaks: Column) -> Column:
    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, p: s + p["i"] * p["i"]))
        return let(norm, lambda n: F.transform(v, lambda p: F.struct(p["mz"].alias("mz"), F.when(n > 0, p["i"] / n).otherwise(p["i"]).alias("i"))))

    return let(peaks, scaled)


def exact_peaks(mz: Column, intensity: Column, precursor: Column, most: int | None = 100) -> Column:
    """For exact matching: library_peaks() up to two above the precursor, weighted sqrt(i) * sqrt(mz / 100), unit norm, by m/z; all of them without ``most``."""
    top = F.least(F.lit(1250.0), precursor + 2)
    fine = lambda p: finite(p["mz"]) & finite(p["i"]) & (p["i"] >= 0.01) & (p["mz"] >= 40) & (p["mz"] <= top)
    kept = F.filter(zipped(mz, intensity), fine)
    kept = kept if most is None else strongest(kept, most)
    weighed = F.transform(kept, lambda p: F.struct(p["mz"].alias("mz"), (F.sqrt(p["i"]) * F.sqrt(p["mz"] / 100)).alias("i"), p["at"].alias("at")))
    return _unit(_by_mz(weighed))


def relative_peaks(mz: Column, intensity: Column) -> Column:
    """For evidence: finite positive peaks over their maximum, stably by m/z; arrays of unequal lengths fail the query."""
    fine = lambda p: finite(p["mz"]) & finite(p["i"]) & (p["mz"] > 0) & (p["i"] > 0)
    kept = F.filter(zipped(mz, intensity), fine)
    over = lambda v: let(F.array_max(F.transform(v, lambda p: p["i"])), lambda top: F.transform(v, lambda p: F.struct(p["mz"].alias("mz"), (p["i"] / top).alias("i"), p["at"].alias("at"))))
    scaled = let(kept, over)
    equal = F.coalesce(F.size(mz), F.lit(0)) == F.coalesce(F.size(intensity), F.lit(0))
    return F.when(equal, _by_mz(scaled)).otherwise(F.raise_error(F.lit("peak arrays of unequal lengths")))


def feature_peaks(mz: Column, intensity: Column) -> Column:
    """For features: finite peaks within [0, 1250) of positive intensity, the square root of their share of the maximum, in their order."""
    fine = lambda p: finite(p["mz"]) & finite(p["i"]) & (p["mz"] >= 0) & (p["mz"] < 1250) & (p["i"] > 0)
    kept = F.filter(zipped(mz, intensity), fine)
    over = lambda v: let(F.greatest(F.array_max(F.transform(v, lambda p: p["i"])), F.lit(1e-12)), lambda top: F.transform(v, lambda p: F.struct(p["mz"].alias("mz"), F.sqrt(p["i"] / top).alias("i"), p["at"].alias("at"))))
    return let(kept, over)


def entropy(weights: Column) -> Column:
    """-sum p ln p of positive weights that sum to one."""
    return -F.aggregate(weights, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.log(p)).otherwise(0.0))


def _normal(weights: Column) -> Column:
    return let(weights, lambda w: let(F.aggregate(w, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(w, lambda x: F.when(total > 0, x / total).otherwise(0.0))))


def entropy_peaks(mz: Column, intensity: Column, floor: float = 0.002, most: int = 256, power: float = 1.0) -> Column:
    """Peaks for entropy similarity, by m/z: those above a share of the largest, the most intense (the lower of equals), to a power, summing to one; if their entropy S is below 3, to the power 0.25 + 0.25 S and summing to one again."""
    fine = F.filter(zipped(mz, intensity), lambda p: finite(p["mz"]) & finite(p["i"]) & (p["i"] > 0))
    top = lambda v: let(F.array_max(F.transform(v, lambda p: p["i"])), lambda t: F.filter(v, lambda p: p["i"] >= floor * t))
    ranked = F.transform(let(fine, top), lambda p: F.struct((-p["i"]).alias("k"), p["mz"].alias("mz"), p["at"].alias("at"), p["i"].alias("i")))
    kept = _by_mz(F.slice(F.array_sort(ranked), 1, most))

    def weighed(v: Column) -> Column:
        flat = lambda p: let(entropy(p), lambda s: F.when(s < 3, _normal(F.transform(p, lambda x: F.pow(x, 0.25 + 0.25 * s)))).otherwise(p))
        weights = let(_normal(F.transform(v, lambda p: F.pow(p["i"], F.lit(power)))), flat)
        return F.zip_with(v, weights, lambda p, w: F.struct(p["mz"].alias("mz"), w.alias("i")))

    return let(kept, weighed)


def effective_peaks(intensity: Column) -> Column:
    """exp(entropy) of the positive intensities as shares: how many peaks carry a spectrum."""
    return F.exp(entropy(_normal(F.filter(intensity, lambda x: finite(x) & (x > 0)))))


def bin_of(mz: Column, width: float = 0.1) -> Column:
    """The nearest bin, ties to even."""
    return F.rint(mz * (1 / width)).cast("int")


def sparse_vector(peaks: Column) -> Column:
    """Map from bin (0.1) to weight: the largest sqrt(i) * sqrt(mz / 100) in the bin, over the whole's norm.

    In one expression over the array, for vectors that stay in a row;
    similarity.sparse_rows() gives the long form for joins.
    """
    pairs = F.array_sort(F.transform(peaks, lambda p: F.struct(bin_of(p["mz"]).alias("b"), (-F.sqrt(p["i"]) * F.sqrt(p["mz"] / 100)).alias("w"))))
    # sorted by bin, then by falling weight: the first of each bin is its largest
    firsts = lambda s: F.filter(s, lambda p, at: (at == 0) | (p["b"] != F.get(s, F.greatest(at - 1, F.lit(0)))["b"]))
    unit = lambda v: let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, p: s + p["w"] * p["w"])), lambda n: F.map_from_entries(F.transform(v, lambda p: F.struct(p["b"].alias("key"), (-p["w"] / n).alias("value")))))
    return let(let(pairs, firsts), unit)


def positions(mz: Column, loss: Column, frequencies: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)) -> Column:
    """m/z and loss over 1250, then sines and cosines of either at four frequencies: 18 numbers."""
    waves = [f(x * q) for x in (mz, loss) for f in (F.sin, F.cos) for q in frequencies]
    return F.array(mz / 1250, loss / 1250, *waves)


def padded_features(mz: Column, intensity: Column, precursor: Column, most: int = 64) -> Column:
    """Struct (peaks, mask): the strongest of feature_peaks(), the earlier of equals first, each with its weight and positions(), then rows of zeros up to ``most``; the mask is true for peaks, and for the first row of a spectrum without any."""
    ranked = F.array_sort(F.transform(feature_peaks(mz, intensity), lambda p: F.struct((-p["i"]).alias("k"), p["at"].alias("at"), p["mz"].alias("mz"), p["i"].alias("i"))))
    rows = F.transform(F.slice(ranked, 1, most), lambda p: F.concat(F.array(p["i"]), positions(p["mz"], precursor - p["mz"])))
    zeros = F.array_repeat(F.lit(0.0), 19)

    def padded(v: Column) -> Column:
        mask = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: (i < F.size(v)) | ((i == 0) & (F.size(v) == 0)))
        return F.struct(F.concat(v, F.array_repeat(zeros, most - F.size(v))).alias("peaks"), mask.alias("mask"))

    return let(F.coalesce(rows, F.expr("cast(array() as array<array<double>>)")), padded)


def peak_tokens(peaks: Column, protected: Column, most: int = 128) -> Column:
    """The tokens of a spectrum: protected peaks first, a quarter of the places at most, then the most intense, by m/z.

    ``protected`` is an array of booleans beside the peaks.
    """
    marked = F.zip_with(peaks, protected, lambda p, k: F.struct((-p["i"]).alias("k"), p["at"].alias("at"), p.alias("p"), F.coalesce(k, F.lit(False)).alias("safe")))

    def chosen(all_: Column) -> Column:
        safe = F.slice(F.array_sort(F.filter(all_, lambda m: m["safe"])), 1, most // 4)
        return let(safe, lambda s: F.concat(s, F.slice(F.array_sort(F.array_except(all_, s)), F.lit(1), most - F.size(s))))

    by_mz = F.array_sort(F.transform(let(marked, chosen), lambda m: F.struct(m["p"]["mz"].alias("mz"), m["at"].alias("at"), m["p"]["i"].alias("i"))))
    return F.transform(by_mz, lambda m: F.struct(m["mz"].alias("mz"), m["i"].alias("i")))


def attenuated(strength: Column, floor: float = 0.3) -> Column:
    """Peak-loss strengths above a floor, scaled back to [0, 1]; 0 below it."""
    return F.transform(strength, lambda x: F.greatest(x - floor, F.lit(0.0)) / (1 - floor))


def loss_view(peaks: Column, precursor: Column) -> Column:
    """The peaks as neutral losses precursor - mz, ascending."""
    return F.array_sort(F.transform(peaks, lambda p: F.struct((precursor - p["mz"]).alias("mz"), p["i"].alias("i"))))
