"""Learners, matching and audits against plain versions."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionsift.functions import lists, peaks
from ionsift.operators import catalog, evaluation, learning, range_join, retrieval, router, similarity
from ionsift.sources import sinks


def matched(a, b, tolerance, shift=0.0):
    """Two spectra [(mz, weight)] by m/z: sum of what matched peaks add, each peak once, the lower first."""
    a, b, total = list(a), [(m + shift, w) for m, w in b], 0.0
    h = lambda x: x * math.log2(x) if x > 0 else 0.0
    while a and b:
        if abs(a[0][0] - b[0][0]) <= tolerance:
            x, y = a.pop(0)[1], b.pop(0)[1]
            total += h(x + y) - h(x) - h(y)
        elif a[0][0] < b[0][0]:
            a.pop(0)
        else:
            b.pop(0)
    return total / 2


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w > 0)


def test_entropy_similarity(spark):
    """Many pairs at once against one after the other, and against the definition by entropies where all peaks are far apart."""
    random.seed(11)

    def spectrum():
        n = random.choice([0, 1, 5, 30])
        w = [random.random() for _ in range(n)]
        return sorted((round(random.uniform(50, 80), 2), x / sum(w)) for x in w)

    rows = [(i, spectrum(), spectrum(), random.choice([0.0, 1.0, -2.5])) for i in range(300)]
    cut = lambda s: ([m for m, _ in s], [w for _, w in s])
    df = spark.createDataFrame([(i, *cut(a), *cut(b), s) for i, a, b, s in rows] + [(-1, None, None, [1.0], [1.0], 0.0)], "i int, a array<double>, x array<double>, b array<double>, y array<double>, s double").repartition(3)
    got = {r["i"]: r["v"] for r in df.select("i", similarity.entropy_similarity(F.col("a"), F.col("x"), F.col("b"), F.col("y"), 0.3, F.col("s")).alias("v")).collect()}
    assert got.pop(-1) == 0.0
    for i, a, b, s in rows:
        assert got[i] == pytest.approx(max(matched(a, b, 0.3), matched(a, b, 0.3, s)))
    a, b = [(60.0, 0.25), (70.0, 0.75)], [(60.1, 0.5), (75.0, 0.5)]
    mixed = [(0.25 + 0.5) / 2, 0.75 / 2, 0.5 / 2]
    want = 1 - (2 * entropy(mixed) - entropy([0.25, 0.75]) - entropy([0.5, 0.5])) / math.log(4)
    one = spark.createDataFrame([(*cut(a), *cut(b))], "a array<double>, x array<double>, b array<double>, y array<double>")
    assert one.select(similarity.entropy_similarity(F.col("a"), F.col("x"), F.col("b"), F.col("y"), 0.3)).first()[0] == pytest.approx(want)


def test_entropy_peaks_keep_masses(spark):
    """The most intense peaks with their masses in order, weights summing to one; a flat spectrum's entropy of three and more leaves them."""
    df = spark.createDataFrame([([5.0, 1.0, 3.0, 2.0], [1.0, 0.5, 0.001, 0.25]), ([float(i) for i in range(40)], [1.0] * 40), ([], [])], "m array<double>, i array<double>")
    some, flat, none = (r["p"] for r in df.select(peaks.entropy_peaks(F.col("m"), F.col("i"), most=30).alias("p")).collect())
    assert [p["mz"] for p in some] == [1.0, 2.0, 5.0] and sum(p["i"] for p in some) == pytest.approx(1)
    p = [x / 1.75 for x in (0.5, 0.25, 1.0)]
    power = [x ** (0.25 + 0.25 * entropy(p)) for x in p]
    assert [x["i"] for x in some] == pytest.approx([x / sum(power) for x in power])
    assert [x["mz"] for x in flat] == [float(i) for i in range(30)] and [x["i"] for x in flat] == pytest.approx([1 / 30] * 30)
    assert none == []


def test_critic_against_newton(spark):
    random.seed(4)
    d = [[random.gauss(0.4, 1), random.gauss(-0.2, 1), random.gauss(0, 1)] for _ in range(400)]
    x, w = np.array(d), np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + 0.01 * np.eye(3), -x.T @ p / len(x) + 0.01 * w)
    df = spark.createDataFrame([(r,) for r in d], "difference array<double>")
    assert learning.critic_weights(df) == pytest.approx(w.tolist(), abs=1e-4)
    bounded = learning.critic_weights(df, bounds=(0.0, 0.1))
    assert bounded == pytest.approx([0.1, 0.0, bounded[2]], abs=1e-6) and 0 <= bounded[2] <= 0.1
    bonus = learning.bonus_weights(df, budget=0.05)
    assert sum(bonus) <= 0.05 + 1e-12 and min(bonus) >= 0
    with pytest.raises(ValueError):
        learning.critic_weights(df.limit(0))


def summary(spark, rows, **k):
    df = spark.createDataFrame([(r,) for r in rows], "v array<double>").repartition(3)
    axes = learning.principal_axes(df, "v")
    return [r["variance"] for r in axes.orderBy("axis").collect()], learning.latent_summary(axes, **k).first()


def test_axes_of_known_spectra(spark):
    """Corners of a box, points on a line, one point, and too few."""
    for n in (2, 3, 5):  # plus and minus a unit along each axis: all alike
        corners = [[s * float(i == k) for i in range(n)] for k in range(n) for s in (1, -1)]
        variances, r = summary(spark, corners)
        assert variances == pytest.approx([1 / n] * n) and r["axes"] == pytest.approx(n) and r["spread"] == pytest.approx(n**-0.5) and not r["collapsed"]
    variances, r = summary(spark, [[3.0 * x, 4.0 * x, 7.0] for x in (-1, 0, 1)])
    assert variances == pytest.approx([50 / 3, 0, 0], abs=1e-9) and r["axes"] == pytest.approx(1) and r["collapsed"]
    assert not summary(spark, [[3.0 * x, 4.0 * x] for x in (-1, 0, 1)], least_axes=1.0)[1]["collapsed"]
    variances, r = summary(spark, [[1e-5, 0.0], [-1e-5, 0.0], [0.0, 1e-5], [0.0, -1e-5]])
    assert r["axes"] == pytest.approx(2) and r["collapsed"] and not summary(spark, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.0, 0.0]], flat=0.1)[1]["collapsed"]
    for few in ([[5.0, 5.0]] * 4, [[1.0, 2.0]], [], [[float("nan"), 1.0], [0.0, 1.0]]):
        r = summary(spark, few)[1]
        assert (r["axes"], r["spread"], r["collapsed"]) == (0.0, 0.0, True)


def test_axes_keep_lengths(spark):
    """Turning and shifting a cloud changes nothing; scaling it scales its spread."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4)) * [4, 2, 1, 0.5]
    turn, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    first, r = summary(spark, x.tolist())
    second, s = summary(spark, (x @ turn + 9).tolist())
    third, q = summary(spark, (3 * x).tolist())
    assert second == pytest.approx(first) and third == pytest.approx([9 * v for v in first]) and (s["axes"], q["axes"]) == pytest.approx((r["axes"], r["axes"])) and q["spread"] == pytest.approx(3 * r["spread"])


def test_weighted_trees_and_router(spark):
    """A rare class is found by trees over classes that count alike, and by the router's trees out of fold."""
    random.seed(8)
    rows = [(i, x := random.random(), random.random(), int(x > 0.9)) for i in range(800)]
    df = spark.createDataFrame(rows, "id int, x double, z double, y int")
    out = learning.weighted_trees(df.where("id < 400"), df.where("id >= 400"), ["x", "z"], "y", trees=5).collect()
    assert sum((r["probability"] > 0.5) == bool(r["y"]) for r in out) >= 390
    sizes = {r["y"]: r["w"] for r in learning.class_weights(df, "y", "w").select("y", "w").distinct().collect()}
    assert sizes[1] * sum(r[3] for r in rows) == pytest.approx(400) and sizes[0] * sum(1 - r[3] for r in rows) == pytest.approx(400)
    for model in ("logistic", "trees"):
        fold = router.out_of_fold(df, "id", ["x", "z"], "y", folds=2, model=model).collect()
        hit = sorted(r["reliability"] for r in fold if r["y"])[len([r for r in fold if r["y"]]) // 4]
        assert len(fold) == 800 and sum(r["reliability"] < hit for r in fold if not r["y"]) >= 0.9 * 720


def test_ridge(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=100)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    got = router.ridge_solve(router.ridge_moments(df, ["a", "b", "c"], "y"), 3, 2.0)
    assert got == pytest.approx(np.linalg.solve(x.T @ x + 2 * np.eye(3), x.T @ y).tolist())


def test_ridge_of_many_columns_and_targets(spark):
    """Sixty columns and five targets against least squares on stacked rows; one pass, and one matrix a task in the shuffle."""
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(700, 60)) + 3, rng.normal(size=(60, 5)) / 60
    y = x @ w + 0.2 + rng.normal(size=(700, 5)) / 50
    names, targets = [f"x{i}" for i in range(60)], [f"y{i}" for i in range(5)]
    df = spark.createDataFrame(np.hstack([x, y]).tolist(), ", ".join(f"{c} double" for c in names + targets)).repartition(5).cache()
    fit = learning.ridge(df, names, targets, penalty=0.3)
    # the penalty as rows of their own, an intercept as a column that has none
    a = np.vstack([np.hstack([x, np.ones((700, 1))]) / 700**0.5, np.hstack([0.3**0.5 * np.eye(60), np.zeros((60, 1))])])
    want = np.linalg.lstsq(a, np.vstack([y / 700**0.5, np.zeros((60, 5))]), rcond=None)[0]
    assert np.allclose(fit.weights.T, want[:-1], atol=1e-9) and np.allclose(fit.intercepts, want[-1], atol=1e-8)
    got = [r[0] for r in df.select(fit.predicted(2, None, None)).collect()]
    assert sorted(got) == pytest.approx(sorted((x @ want[:-1] + want[-1])[:, 2].tolist()))
    clipped = [r[0] for r in df.select(fit.predicted(0, -0.1, 0.1)).collect()]
    assert min(clipped) >= -0.1 and max(clipped) <= 0.1
    for bad in (df.limit(0), df.withColumn("x3", F.lit(None).cast("double")), df.withColumn("y1", F.lit(float("inf")))):
        with pytest.raises(ValueError):
            learning.ridge(bad, names, targets)


def test_quantiles(spark):
    """Skewed, tied, single, odd and missing values against sorting."""
    random.seed(6)
    groups = {"skew": [math.exp(random.gauss(0, 4)) for _ in range(301)], "ties": [float(random.choice([1, 1, 1, 2, 50])) for _ in range(200)], "one": [3.5], None: [-1.0, 4.0], "negative": [-random.random() for _ in range(64)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("ties", float("nan"))]
    at = (0.0, 0.1, 0.5, 0.99, 1.0)
    got = {r["g"]: r for r in evaluation.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], at, accuracy=40).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert [got[g][f"q{round(100 * q)}"] for q in at] == pytest.approx(np.quantile(vs, at).tolist())


def test_ulps(spark):
    """The places of doubles against their bits."""
    import struct

    random.seed(2)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, math.nextafter(1, 0), math.nextafter(1, 2), 1.7976931348623157e308, 8.0, math.nextafter(8, 0), *[random.choice([-1, 1]) * math.exp(random.uniform(-700, 700)) for _ in range(300)]]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(evaluation.ordinal(F.col("v"))).collect()]
    place = lambda v: (-1 if v < 0 else 1) * struct.unpack("<q", struct.pack("<d", abs(v)))[0]
    assert got == [place(v) for v in values]


def test_one_to_one(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(1, "p"), (1, "q"), (3, "r")], "k int, b string")
    assert catalog.merged_one_to_one(a, b.where("b <> 'q'"), ["k"]).collect() == [(1, "x", "p")]
    with pytest.raises(Exception, match="repeated k"):
        catalog.merged_one_to_one(a, b, ["k"]).collect()


def test_audit_beside_a_result(spark, tmp_path):
    """Both outputs are of one computation, even of rows that come out differently every time."""
    df = spark.range(100).withColumn("branch", (F.rand() * 3).cast("int"))
    rows, audit = sinks.audited(df, ["branch"], molecules=F.count("*"), first=F.min("id"))
    rows.write.parquet(str(tmp_path / "t"))
    kept = spark.read.parquet(str(tmp_path / "t")).groupBy("branch").agg(F.count("*").alias("molecules"), F.min("id").alias("first"))
    assert sorted(audit.collect()) == sorted(kept.collect())


def test_marker_in_the_tables_file_system(spark, tmp_path):
    at = f"file://{tmp_path}/once"
    df = spark.range(3)
    assert sinks.write_once(df, at, {"v": "é"}) and not sinks.write_once(df, at, {"v": "é"})
    assert sinks.read_text(spark, f"{at}/_config.json") == '{"v": "\\u00e9"}' and sinks.read_text(spark, f"{at}/none") is None
    assert spark.read.parquet(at).count() == 3 and not list(tmp_path.glob("once/*.tmp"))


def test_wide_and_narrow_windows(spark):
    """Windows of very different widths in one join."""
    random.seed(9)
    cat = [(i, random.choice([random.uniform(0, 1), random.uniform(0, 1000)])) for i in range(400)]
    windows = [(f"w{i}", c := random.uniform(-1, 1000), c + random.choice([0.0, 1e-9, 0.01, 3, 200, -1])) for i in range(60)]
    left = spark.createDataFrame(windows, "w string, lo double, hi double").withColumn("level", F.ceil(F.log(F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-4))) / F.log(F.lit(4.0))).cast("int"))
    out = range_join.banded_join(left, spark.createDataFrame(cat, "k int, m double"), F.col("lo"), F.col("hi"), F.col("m"), F.col("level"), range(-7, 9))
    assert sorted((r["w"], r["k"]) for r in out.collect()) == sorted((w, k) for w, a, b in windows for k, m in cat if a <= m <= b)


def test_similar_sets_against_all_pairs(spark):
    """Prefixes lose no pair at any similarity."""
    random.seed(5)
    sets = {i: {random.choice("abcdefghijkl" if random.random() < 0.7 else "mnopqrstuvwxyz0123456789") for _ in range(random.randint(1, 9))} for i in range(60)}
    rows = spark.createDataFrame([(i, b) for i, s in sets.items() for b in s], "i int, bit string")
    left, right = rows.where("i < 30").withColumnRenamed("i", "a"), rows.where("i >= 30").withColumnRenamed("i", "b")
    for least in (0.05, 1 / 3, 0.5, 0.8, 1.0):
        got = {(r["a"], r["b"]): r["tanimoto"] for r in similarity.tanimoto_pairs(left, right, "a", "b", least).collect()}
        want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(30) for j in range(30, 60) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least}
        assert got == want


def test_quantiles_of_skewed_values(spark):
    """Lognormal values: what lies between the bounds of a quantile is a hundredth of the rows at most, so no window holds more."""
    rng = np.random.default_rng(9)
    v = np.exp(rng.normal(0, 4, 60_000))
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(6).cache()
    got = evaluation.quantiles(df, "v", [], (0.25, 0.5, 0.999), accuracy=2000)
    assert [got.first()[c] for c in ("q25", "q50", "q99" if "q99" in got.columns else "q100")] == pytest.approx(np.quantile(v, [0.25, 0.5, 0.999]).tolist())
    bounds = df.agg(F.percentile_approx("v", [0.499, 0.501], 2000)).first()[0]
    assert df.where(F.col("v").between(*bounds)).count() <= 600


def test_bootstrap_against_counts(spark):
    """The interval of a mean of coin tosses is near the binomial's, and a group's own weights are Poisson."""
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(400)], "group long, d double")
    r = evaluation.bootstrap(df, "group", 2000).first()
    assert r["gain"] == 0.5 and r["low"] == pytest.approx(0.5 - 1.96 * 0.025, abs=0.006) and r["high"] == pytest.approx(0.5 + 1.96 * 0.025, abs=0.006)
    other = evaluation.bootstrap(df, "group", 2000, seed=7).first()
    assert (other["low"], other["high"]) != (r["low"], r["high"])


def test_union_window_against_all_pairs(spark):
    """Overlapping and separate windows, shared and missing centers, at the bounds; keys that are distinct and keys that repeat."""
    from ionsift.operators import range_join

    random.seed(12)
    asked = [(f"q{i % 40}", round(random.choice([100.0, 100.004, 100.01, 100.5, 300.0]) + random.choice([0, 0.001, 0.006, 0.0061]), 4)) for i in range(200)] + [("none", None), ("q1", None)]
    rows = [(f"k{i}", round(random.choice([100.0, 100.5, 300.0]) + random.uniform(-0.02, 0.03), 3), i) for i in range(400)]
    centers, catalog = spark.createDataFrame(asked, "grp string, center double"), spark.createDataFrame(rows, "key string, mass double, extra int")
    again = catalog.withColumn("key", F.concat(F.lit("k"), F.col("extra") % 50))

    def plain(rows):
        out = {}
        for q, c in sorted({p for p in asked if p[1] is not None}, key=lambda p: p[1]):
            for k, m, x in sorted(rows, key=lambda r: (r[1], r[2])):
                if c - max(c * 35e-6, 0.006) <= m <= c + max(c * 35e-6, 0.006):
                    out.setdefault((q, k), (c, m, x))
        return {(*k, *v) for k, v in out.items()}

    found = range_join.union_window(centers, catalog, "grp", "key")
    assert sorted(tuple(r) for r in found.select("grp", "key", "center", "mass", "extra").collect()) == sorted(plain(rows))
    found = range_join.union_window(centers, again, "grp", "key", distinct_keys=False)
    assert {tuple(r) for r in found.select("grp", "key", "center", "mass", "extra").collect()} == plain([(f"k{x % 50}", m, x) for _, m, x in rows])


def test_matched_pairs_against_lambdas(spark):
    """The two forms of the pair score, over peaks that tie, meet bounds, repeat, or are not there."""
    random.seed(2)
    peaks_ = lambda n: sorted((round(random.choice([60.0, 80.0, 120.0]) + random.choice([0, 0.01, 0.02, 0.024, 0.03, 5.0]), 3), random.random()) for _ in range(n))
    rows = [(peaks_(random.randint(0, 9)), 200.0 + i % 3, "[M+H]+" if i % 2 else "[M-H]-", peaks_(random.randint(0, 9)), 201.0, "[M+H]+") for i in range(120)]
    rows += [(None, 1.0, "[M+H]+", peaks_(3), 2.0, None), (peaks_(2), None, None, peaks_(3), 2.0, "[M+H]+")]
    kind = "array<struct<mz:double,i:double>>"
    df = spark.createDataFrame(rows, f"a {kind}, ap double, aa string, b {kind}, bp double, ba string")
    cols = [F.col(c) for c in ("a", "ap", "aa", "b", "bp", "ba")]
    for plain, fast in df.select(similarity.pair_score(*cols), similarity.pair_scores(*cols)).collect()[:120]:
        assert fast == pytest.approx(plain, abs=1e-12)
    assert [r[0] for r in df.select(similarity.pair_scores(*cols)).collect()[120:]] == [0.0, pytest.approx(df.select(similarity.matched_dot(F.col("a"), F.col("b"))).collect()[-1][0] * 0.7 * 0.7)]


def test_cascade_reads_few_peaks(spark):
    """However many references a window holds, peaks are matched for so many structures, and so many spectra of each."""
    n = 900
    refs = spark.range(n).select(F.col("id").alias("ref"), (F.col("id") % 300).cast("string").alias("key"), F.lit(100.0).alias("mass"))
    spectra = spark.createDataFrame([("g", 1), ("g", 2), ("h", 3)], "group string, spectrum int")
    scores = spectra.crossJoin(refs).select("group", "spectrum", "ref", "key", (F.pmod(F.xxhash64("spectrum", "ref"), F.lit(1000)) / 1000).alias("score"))
    own = retrieval.Cascade(shortlist=7, spectra=2, size=5)
    short = own.coarse(scores)
    chosen = own.chosen(scores, short).collect()
    assert collections.Counter(r["group"] for r in chosen) == {"g": 14, "h": 14}
    assert {(r["group"], r["key"]) for r in chosen} == {(r["group"], r["key"]) for r in short.collect()}
    best = collections.defaultdict(dict)
    for r in scores.collect():
        best[r["group"], r["key"]][r["ref"]] = max(r["score"], best[r["group"], r["key"]].get(r["ref"], 0))
    for r in chosen:
        order = sorted(best[r["group"], r["key"]].items(), key=lambda p: (-p[1], p[0]))
        assert order[r["place"] - 1][0] == r["ref"]
    peak = F.array(F.struct((50.0 + F.col("ref") % 4).alias("mz"), F.lit(1.0).alias("i")))
    library = refs.select("ref", F.lit(200.0).alias("precursor"), F.lit("[M+H]+").alias("adduct"), peak.alias("peaks"))
    asked = spectra.select("group", "spectrum", F.lit(200.0).alias("precursor"), F.lit("[M+H]+").alias("adduct"), F.array(F.struct(F.lit(51.0).alias("mz"), F.lit(1.0).alias("i"))).alias("peaks"))
    out = own.rank(scores, asked, library).collect()
    coarse, exact = {(r["group"], r["key"]): r["score"] for r in short.collect()}, collections.defaultdict(float)
    for r in chosen:  # a spectrum either matches wholly or not at all
        exact[r["group"], r["key"]] = max(exact[r["group"], r["key"]], float(r["ref"] % 4 == 1))
    want = {g: sorted(((0.5 * c + 0.5 * exact[g, k], k) for (q, k), c in coarse.items() if q == g), key=lambda p: (-p[0], p[1]))[:5] for g in "gh"}
    for g in "gh":
        got = sorted((r for r in out if r["group"] == g), key=lambda r: r["rank"])
        assert [(r["score"], r["key"]) for r in got] == [(pytest.approx(s), k) for s, k in want[g]]
    with pytest.raises(ValueError):
        retrieval.Cascade(mode="quick")


def bonus_loss(x, s, w, scale=20.0, penalty=0.01):
    z = scale * (s + x @ w)
    return (np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[:, 0]).mean() + penalty * (w @ w) / 2


def test_listwise_bonus(spark):
    """The loss at the solution against projected steps on all rows at once, with the budget binding and not, and against a grid."""
    rng = np.random.default_rng(4)
    for pull, budget in ((0.35, 0.05), (0.02, 0.05), (0.3, 5.0)):
        x = rng.uniform(size=(60, 6, 3)) * 0.6
        x[:, 0, :2] += pull
        s = rng.normal(0, 0.05, size=(60, 6))
        rows = [(g, float(s[g, c]), x[g, c].tolist(), bool(c == 0)) for g in range(60) for c in rng.permutation(6)]
        df = spark.createDataFrame(rows, "group int, score double, features array<double>, right boolean").repartition(5)
        w = np.array(learning.listwise_bonus(df, budget=budget))
        assert (w >= 0).all() and w.sum() <= budget + 1e-12
        v = np.zeros(3)
        for _ in range(20_000):  # plain projected gradient
            z = 20 * (s + x @ v)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = 20 * (np.einsum("gc,gcd->gd", p, x) - x[:, 0]).mean(0) + 0.01 * v
            v = learning.onto_budget(v - 0.01 * g, budget)
        assert bonus_loss(x, s, w) <= bonus_loss(x, s, v) + 1e-9 and abs(bonus_loss(x, s, w) - bonus_loss(x, s, v)) < 1e-6
        for _ in range(300):
            other = learning.onto_budget(rng.exponential(budget / 2, 3), budget)
            assert bonus_loss(x, s, w) <= bonus_loss(x, s, other) + 1e-12
    good = [("a", 0.1, [0.5], True), ("a", 0.1, [0.2], False)]
    schema = "group string, score double, features array<double>, right boolean"
    assert learning.listwise_bonus(spark.createDataFrame(good, schema))[0] == pytest.approx(0.05)
    for bad in ([], good + [("b", 0.1, [0.5], False)], good + [("b", 0.1, [0.5, 0.1], True)], good + [("b", 0.1, [1.5], True)], good + [("b", None, [0.5], True)], good + [("b", 0.1, None, True)], good + good):
        with pytest.raises(ValueError):
            learning.listwise_bonus(spark.createDataFrame(bad, schema))


def test_onto_budget():
    """Nearest by a grid of points within the budget."""
    rng = np.random.default_rng(8)
    grid = np.array([(a, b) for a in np.linspace(0, 1, 101) for b in np.linspace(0, 1, 101) if a + b <= 1 + 1e-9])
    for _ in range(50):
        w = rng.normal(0, 1.2, 2)
        got = learning.onto_budget(w, 1.0)
        assert got.min() >= 0 and got.sum() <= 1 + 1e-12 and np.linalg.norm(w - got) <= np.linalg.norm(w - grid, axis=1).min() + 1e-9


def test_feature_ranker_beats_its_best_feature(spark):
    """Right candidates show in several sources a little; trees over all features, grown on other groups, rank them better than any one feature."""
    from ionsift.operators import ranker

    rng = np.random.default_rng(6)
    rows, labels = [], []
    for g in range(160):
        for k in range(8):
            right = k == g % 8
            row = {c: float(rng.uniform()) for c in ranker.SOURCES} | {"mass": 300 + rng.normal(0, 0.003), "center": 300.0, "bits": float(rng.integers(20, 60))}
            if right:
                for c in ("library", "analog", "log_odds", "fragments"):
                    row[c] += 0.35 * rng.uniform()
            rows.append((g, f"k{k}", *[row[c] for c in ranker.SOURCES]))
            labels.append((g, f"k{k}", float(right)))
    df = spark.createDataFrame(rows, "group int, key string, " + ", ".join(f"{c} double" for c in ranker.SOURCES))
    truth = spark.createDataFrame(labels, "group int, key string, label double")
    features = ranker.candidate_features(df).cache()
    plan = features._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") >= 1 and len(ranker.names(features)) == 49
    exchanged = ranker.candidate_features(df)._jdf.queryExecution().executedPlan().toString()
    assert exchanged.count("Exchange") == 1
    ranked_ = ranker.out_of_fold(features, truth).join(truth, ["group", "key"]).where("label = 1")
    mrr = ranked_.agg(F.avg(1 / F.col("rank"))).first()[0]
    best = 0.0
    own = {(r["group"], r["key"]): r for r in features.collect()}
    for c, sign in [(c, s) for c in ranker.names(features) for s in (1, -1)]:
        total = 0.0
        for g in range(160):
            v = [own[g, f"k{k}"][c] for k in range(8)]
            total += 1 / (1 + sum(sign * x > sign * v[g % 8] for x in v) + sum(x == v[g % 8] for x in v[: g % 8]))
        best = max(best, total / 160)
    assert mrr > best


def test_recipes():
    """What a recipe refuses, and its text."""
    r = retrieval.Recipe(mass_hypothesis="charge_aware_union", expansion_weight=0.25, reference_guard=1)
    assert retrieval.Recipe.from_json(r.to_json()) == r
    for bad in ({"mass_hypothesis": "x"}, {"neural_weight": 1.5}, {"chemistry": "magic", "chemistry_weight": 0.5}, {"chemistry": "fragment"}, {"expansion_weight": 0.2}, {"reference_guard": 1}):
        with pytest.raises(ValueError):
            retrieval.Recipe(**bad)
    with pytest.raises(ValueError, match="unknown settings: tempo"):
        retrieval.Recipe.from_json('{"tempo": 1}')


def test_reranked_arrays(spark):
    """Competition ranks by score, missing scores as 0, ties unchanged."""
    df = spark.createDataFrame([(["a", "b", "c", "d"], {"c": 9.0, "d": 1.0}), (["a", "b"], {"a": 1.0, "b": 1.0}), ([], {})], "k array<string>, s map<string,double>")
    assert [r[0] for r in df.select(lists.reranked(F.col("k"), F.col("s"), 0.9)).collect()] == [["c", "d", "a", "b"], ["a", "b"], []]
    with pytest.raises(ValueError):
        lists.reranked(F.col("k"), F.col("s"), 2.0)


def test_merge_with_fallback_reference(spark):
    """Without references in the window the nearest ones answer; without a mass the lightest."""
    spectra = spark.createDataFrame([("g", 1), ("h", 2), ("n", 3)], "group string, spectrum int")
    vectors = spark.createDataFrame([(s, 0, 1.0) for s in (1, 2, 3)], "spectrum int, bin int, w double")
    refs = spark.createDataFrame([(10 + i, f"k{i}", 100.0 + i) for i in range(6)], "ref int, key string, mass double")
    rv = spark.createDataFrame([(10 + i, 0, 0.1 * (i + 1)) for i in range(6)], "ref int, bin int, w double")
    centers = spark.createDataFrame([("g", 102.0), ("h", 103.5), ("n", None)], "group string, center double")
    got = {}
    for r in retrieval.reference_rank(spectra, vectors, refs, rv, centers, fallback=True, either=2).orderBy("rank").collect():
        got.setdefault(r["group"], []).append(r["key"])
    assert got == {"g": ["k2"], "h": ["k5", "k4", "k3", "k2"], "n": ["k1", "k0"]}
    assert {r["group"] for r in retrieval.reference_rank(spectra, vectors, refs, rv, centers).collect()} == {"g"}
