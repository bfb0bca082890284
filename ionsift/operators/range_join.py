"""Joins by a window of mass: bins for the equi-join, then the exact bounds.

A plain inequality join would compare all pairs.  Here the narrower side's
window is exploded into the bins it touches and meets the other side's bin by
hash, so that Spark shuffles or broadcasts as for any equi-join and a popular
bin is split by AQE as any skewed key is.  Windows are closed at both ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mass import mass_tolerance
from ..lineage import settled

#: Width of the bands by which a catalog is numbered: a few thousand for masses, each a small part of the catalog.
BAND = 0.25


def band_join(left: DataFrame, right: DataFrame, low: Column, high: Column, value: Column, width: float) -> DataFrame:
    """Rows of left with the rows of right whose ``value`` lies in [low, high]; low and high are of left, value of right.

    ``width`` is that of a bin: about the window's, so that a window touches
    few bins and a bin holds few rows.
    """
    bins = F.when((low <= high), F.sequence(F.floor(low / width), F.floor(high / width)))
    l = left.withColumn("__low", low).withColumn("__high", high).withColumn("__bin", F.explode(bins))
    r = right.withColumn("__value", value).where(F.col("__value").isNotNull() & ~F.isnan("__value")).withColumn("__rbin", F.floor(F.col("__value") / width))
    on = (l["__bin"] == r["__rbin"]) & r["__value"].between(l["__low"], l["__high"])
    return l.join(r, on).drop("__low", "__high", "__bin", "__value", "__rbin")


def met(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """The join by columns of either side, nulls equal, with the left side's columns kept."""
    names = {c: f"__of_{c}" for c in columns}
    on = F.lit(True)
    for c, n in names.items():
        on = on & F.col(c).eqNullSafe(F.col(n))
    out = left.join(right.withColumnsRenamed(names), on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names.values())


def mass_window(centers: DataFrame, catalog: DataFrame, center: str = "center", mass: str = "mass", ppm: float = 35.0, floor: float = 0.006, width: float = 0.05) -> DataFrame:
    """Catalog rows within the tolerance of each center: max(center * ppm, floor).  Null centers have none."""
    c = F.col(center)
    d = mass_tolerance(c, ppm, floor)
    return band_join(centers.where(c.isNotNull()), catalog, c - d, c + d, F.col(mass), width)


def mass_window_of(pairs: DataFrame, catalog: DataFrame, key: str = "key", center: str = "center", mass: str = "mass", ppm: float = 35.0, floor: float = 0.006) -> DataFrame:
    """Those of given pairs of a center and a key whose catalog row mass_window() would find: a join by the key."""
    near = F.abs(F.col(mass) - F.col(center)) <= mass_tolerance(F.col(center), ppm, floor)
    return pairs.join(catalog.select(key, mass), key).where(near)


def window_top(centers: DataFrame, catalog: DataFrame, k: int, score: Column, within: list[Column | str] | None = None, key: str = "key", center: str = "center", mass: str = "mass", **tolerance: float) -> DataFrame:
    """(center, the catalog's columns, score, rank): the k rows of each distinct center's window by falling score, then key.

    ``score`` is of center, mass and the catalog's columns; ``within`` is the
    order that it gives rows of one mass, whatever the center (by key alone
    where it depends on the two masses).  Rows of one mass are in the same
    windows, so only the first k of each mass can be among any window's k, and
    a center that many queries share is met once.
    """
    first = Window.partitionBy(mass).orderBy(*(within or [key]))
    few = catalog.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k).drop("__n")
    hits = mass_window(centers.select(center).distinct(), few, center, mass, **tolerance)
    order = Window.partitionBy(center).orderBy(F.col("score").desc(), key)
    return hits.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def near_any(catalog: DataFrame, centers: DataFrame, mass: str = "mass", center: str = "center", ppm: float = 35.0, floor: float = 0.0, width: float = 0.05) -> DataFrame:
    """Catalog rows with any center within a tolerance of the row's own mass (the nearest is within it exactly if any is).

    Decided once for each distinct mass, of which rows then are semi-joined.
    """
    m = F.col("__m")
    d = mass_tolerance(m, ppm, floor)
    few = centers.select(F.col(center).alias("__center")).where(F.col("__center").isNotNull()).distinct()
    own = catalog.select(F.col(mass).alias("__m")).where(m.isNotNull()).distinct()
    hit = band_join(own, few, m - d, m + d, F.col("__center"), width).select("__m").distinct()
    return catalog.join(hit, catalog[mass] == hit["__m"], "left_semi")


def with_fallback(centers: DataFrame, catalog: DataFrame, key: str, center: str = "center", mass: str = "mass", ppm: float = 10.0, wider: float = 30.0, width: float = 0.05) -> DataFrame:
    """The window of ppm; for centers without a row, the wider one.  Pure ppm, no floor."""
    near = mass_window(centers, catalog, center, mass, ppm, 0.0, width).withColumn("fallback", F.lit(False))
    missing = centers.join(near.select(key).distinct(), key, "left_anti")
    return near.unionByName(mass_window(missing, catalog, center, mass, wider, 0.0, width).withColumn("fallback", F.lit(True)))


def analog_window(centers: DataFrame, catalog: DataFrame, center: str = "center", mass: str = "mass", span: float = 200.0) -> DataFrame:
    """Catalog rows within a wide span of each center."""
    c = F.col(center)
    return band_join(centers.where(c.isNotNull()), catalog, c - span, c + span, F.col(mass), span)


def union_window(centers: DataFrame, catalog: DataFrame, query: str, key: str, center: str = "center", mass: str = "mass", distinct_keys: bool = True, ppm: float = 35.0, floor: float = 0.006, width: float = 0.05) -> DataFrame:
    """The windows of all of a query's distinct centers together, each key once: from the lowest center, then the lowest mass.

    A structure is that of the lowest center that holds it, and windows rise
    with their centers: so each center has what lies in its window above the
    upper end of the center before it, and no row is met twice.  Of equal
    centers the first counts.  What meets the catalog are two numbers for each
    center, and what is found isn't exchanged.  The catalog's keys are distinct
    (as candidate_pool() leaves them); else, with ``distinct_keys`` off, a
    key's rows are reduced.
    """
    c, before = F.col(center), F.col("__before")
    d = lambda x: mass_tolerance(x, ppm, floor)
    asked = centers.where(c.isNotNull()).select(query, center).withColumn("__before", F.lag(center).over(Window.partitionBy(query).orderBy(center))).where(before.isNull() | (before < c))
    bin_of = lambda x: F.floor(x / width)
    windows = asked.withColumn("__bin", F.explode(F.sequence(bin_of(F.greatest(c - d(c), before + d(before))), bin_of(c + d(c)))))
    others = [x for x in catalog.columns if x not in (center, key, query)]
    rows = catalog.select(key, *others).where(F.col(mass).isNotNull() & ~F.isnan(mass)).withColumn("__rbin", bin_of(F.col(mass)))
    m = rows[mass]
    on = (windows["__bin"] == rows["__rbin"]) & (m >= c - d(c)) & (m <= c + d(c)) & (before.isNull() | (m > before + d(before)))
    found = windows.join(rows, on).select(query, key, center, *others)
    if distinct_keys:
        return found
    pick = F.min(F.struct(F.col(center), F.col(mass), *[F.col(c) for c in others if c != mass])).alias("__first")
    reduced = found.groupBy(query, key).agg(pick)
    return reduced.select(query, key, *[F.col(f"__first.{c}").alias(c) for c in (center, *others)])


def ordered(catalog: DataFrame, mass: str, key: str) -> DataFrame:
    """The catalog with ``pos``, its place in the order of (mass, key), from 0.

    Numbered by bands of mass: a small table of their sizes gives each band's
    first number, so that no task orders the whole.
    """
    band = F.floor(F.col(mass) / BAND).cast("long")
    sizes = catalog.groupBy(band.alias("__band")).agg(F.count("*").alias("n"))
    first = sizes.select("__band", (F.sum("n").over(Window.orderBy("__band")) - F.col("n")).alias("__first"))
    w = Window.partitionBy("__band").orderBy(mass, key)
    return catalog.withColumn("__band", band).join(first, "__band").withColumn("pos", F.col("__first") + F.row_number().over(w) - 1).drop("__band", "__first")


def nearest_positions(centers: DataFrame, catalog: DataFrame, query: str, mass: str = "mass", key: str = "key", center: str = "center", either: int = 150) -> DataFrame:
    """The rows either side of the place where each center would be inserted, by order of mass.

    The place is the number of rows below the center.  Centers and masses are
    put into one order within their band, where a running count of rows gives
    the part of the band that lies below, so that no center meets a band's
    rows; whole bands below count by their sizes.
    """
    rows = ordered(catalog, mass, key)
    band = lambda c: F.floor(F.col(c) / BAND).cast("long").alias("__band")
    marks = rows.select(band(mass), F.col(mass).cast("double").alias("__m"), F.lit(1).alias("__row"), F.lit(None).alias("__query"))
    asked = centers.where(F.col(center).isNotNull()).select(band(center), F.col(center).cast("double").alias("__m"), F.lit(0).alias("__row"), F.struct(query, center).alias("__query"))
    both = marks.withColumn("__query", F.lit(None).cast(asked.schema["__query"].dataType)).unionByName(asked)
    within = Window.partitionBy("__band").orderBy("__m", "__row").rowsBetween(Window.unboundedPreceding, 0)  # a center stands before the rows of its mass
    counted = both.withColumn("__within", F.sum("__row").over(within)).where("__query is not null")
    sizes = both.groupBy("__band").agg(F.sum("__row").alias("n"))
    starts = sizes.select("__band", (F.sum("n").over(Window.orderBy("__band")) - F.col("n")).alias("__before"))
    at = counted.join(starts, "__band").select("__query.*", (F.col("__before") + F.col("__within")).alias("__at"))
    low, high = F.greatest(F.col("__at") - either, F.lit(0)), F.col("__at") + either - 1
    return band_join(at, rows, low, high, F.col("pos"), float(2 * either)).drop("__at")


def window_or_nearest(centers: DataFrame, catalog: DataFrame, query: str, mass: str = "mass", key: str = "key", center: str = "center", either: int = 150) -> DataFrame:
    """The mass window; for centers whose window is empty, the nearest positions."""
    hit = mass_window(centers, catalog, center, mass)
    missing = centers.join(hit.select(query).distinct(), query, "left_anti")
    return hit.withColumn("fallback", F.lit(False)).unionByName(nearest_positions(missing, catalog, query, mass, key, center, either).drop("pos").withColumn("fallback", F.lit(True)))


def nearest_k(centers: DataFrame, catalog: DataFrame, query: str, k: int, mass: str = "mass", key: str = "key", center: str = "center") -> DataFrame:
    """The k rows of nearest mass, by (distance, key), with ``rank``.

    They lie among the k positions either side of the center's place and the
    rows that tie with the k-th: positions bound the distance, then a window
    join takes all rows up to it.  Its bins are as wide as the window, to the
    next power of four, so that a bin holds few rows more than are asked for.
    Rows of one mass tie, so that the first k of each mass are enough, and
    centers that queries share are met once.
    """
    w = Window.partitionBy(mass).orderBy(key)
    few = catalog.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")
    own = centers.where(F.col(center).isNotNull()).select(center, F.col(center).alias("__of")).distinct()
    around = nearest_positions(own, few, "__of", mass, key, center, k)
    d = F.abs(F.col(mass) - F.col(center))
    far = around.select("__of", center, d.alias("__d"), F.row_number().over(Window.partitionBy("__of").orderBy(d)).alias("__n"))
    reach = settled(far.where(F.col("__n") <= k).groupBy("__of", center).agg(F.max("__d").alias("__reach")))  # a row per center, read for the levels and for the join
    c, r = F.col(center), F.col("__reach") * (1 + 1e-12) + 1e-12
    level = F.greatest(F.least(F.ceil(F.log(F.greatest(2 * r, F.lit(1e-6))) / F.log(F.lit(4.0))), F.lit(8)), F.lit(-7)).cast("int")
    found = banded_join(reach, few, c - r, c + r, F.col(mass), level, range(-7, 9))
    w = Window.partitionBy("__of").orderBy(F.abs(F.col(mass) - F.col(center)), key)
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    lists = best.groupBy("__of").agg(F.collect_list(F.struct(*catalog.columns, "rank")).alias("__best"))
    asked = centers.select(query, center)
    return asked.join(lists, asked[center] == lists["__of"]).select(query, center, F.inline("__best"))


def banded_join(left: DataFrame, right: DataFrame, low: Column, high: Column, value: Column, level: Column, levels: range) -> DataFrame:
    """band_join() for windows of very different widths: a row of left has bins of 4**level, and a row of right one bin at each level that occurs.

    The levels that occur, a few numbers, are read first.
    """
    l = left.withColumn("__low", low).withColumn("__high", high).withColumn("__level", level)  # noqa: E741
    used = [r["__level"] for r in l.select("__level").distinct().collect()]
    width = lambda n: F.pow(F.lit(4.0), n)
    l = l.withColumn("__bin", F.explode(F.when(F.col("__low") <= F.col("__high"), F.sequence(F.floor(F.col("__low") / width(F.col("__level"))), F.floor(F.col("__high") / width(F.col("__level")))))))  # noqa: E741
    r = right.withColumn("__value", value).where(F.col("__value").isNotNull() & ~F.isnan("__value"))
    r = r.withColumn("__rlevel", F.explode(F.array(*[F.lit(int(n)) for n in sorted(used)]).cast("array<int>"))).withColumn("__rbin", F.floor(F.col("__value") / width(F.col("__rlevel"))))
    on = (l["__level"] == r["__rlevel"]) & (l["__bin"] == r["__rbin"]) & r["__value"].between(l["__low"], l["__high"])
    return l.join(r, on).drop("__low", "__high", "__bin", "__level", "__value", "__rlevel", "__rbin")


def nearest_other(catalog: DataFrame, mass: str = "mass", key: str = "key") -> DataFrame:
    """For each row the nearer in mass of its two neighbours in the order of (mass, key), the smaller key of two equally near: key, other, distance.

    Rows offer themselves to the places before and after their own, where one
    join and one aggregate by place meet them.
    """
    rows = ordered(catalog.select(key, mass), mass, key)
    offers = rows.select(F.explode(F.array(F.col("pos") - 1, F.col("pos") + 1)).alias("pos"), F.col(key).alias("__other"), F.col(mass).alias("__m"))
    near = rows.join(offers, "pos").withColumn("__d", F.abs(F.col("__m") - F.col(mass)))
    best = near.groupBy("pos").agg(F.first(key).alias(key), F.min(F.struct(F.col("__d").alias("d"), F.col("__other").alias("k"))).alias("__best"))
    return best.select(key, F.col("__best.k").alias("other"), F.col("__best.d").alias("distance"))


def hard_negatives(catalog: DataFrame, k: int = 128, either: int = 140, mass: str = "mass", key: str = "key") -> DataFrame:
    """(key, other, rank): of the rows up to ``either`` places away in the order of mass the k of nearest mass, the lower place of two equally near.  A self-join by blocks of places."""
    rows = ordered(catalog.select(key, mass), mass, key)
    others = rows.select(F.col(key).alias("other"), F.col(mass).alias("__m"), F.col("pos").alias("__at"))
    near = band_join(rows, others, F.col("pos") - either, F.col("pos") + either, F.col("__at"), float(2 * either)).where(F.col("pos") != F.col("__at"))
    w = Window.partitionBy(key).orderBy(F.abs(F.col("__m") - F.col(mass)), "__at")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, "other", "rank")


def admissible(mass: Column, other: Column, ppm: float = 35.0, floor: float = 0.006) -> Column:
    """Whether another mass lies within a row's own tolerance."""
    return F.abs(other - mass) <= mass_tolerance(mass, ppm, floor)
