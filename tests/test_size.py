"""Queries over tables with many equal masses, vectors and peaks: what their joins meet is bounded, and results stay those of the SQL."""

from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from ionsift.operators import pools, range_join, ranker, retrieval, similarity
from ionsift.plans import composed
from ionsift.plans import retrieval as plans
from ionsift.plans.queries import ORACLE_SQL, QUERIES
from ionsift.plans.registry import Tables
from test_queries import rows


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """120 parts of three masses, 200 orders of two centers and 200 suppliers of four."""
    at = str(tmp_path_factory.mktemp("copies"))
    n = spark.range(400)
    tables = {
        "part": n.where("id < 120").select((F.col("id") + 1).alias("p_partkey"), (950.0 + F.col("id") % 3 / 100).alias("p_retailprice"), (F.col("id") * 7 % 50).cast("int").alias("p_size"), F.lit("t").alias("p_type"), F.lit("b").alias("p_brand")),
        "lineitem": n.select((F.col("id") % 200).alias("l_orderkey"), (50.0 + F.col("id") % 2 / 50).alias("l_extendedprice")),
        "orders": n.where("id < 220").select(F.col("id").alias("o_orderkey")),
        "supplier": n.where("id < 200").select(F.col("id").alias("s_suppkey"), (50.0 + F.col("id") % 4 / 10).alias("s_acctbal")),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


def sql_rows(folder, name):
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders", "supplier"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    cur = con.execute(ORACLE_SQL[name])
    return rows([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name, most", [("library_search", 25), ("mass_window_topk", 3), ("submission_sink", 3), ("mass_proposals", 5)])
def test_windows_meet_few_rows_of_a_mass(spark, copies, monkeypatch, name, most):
    met, window = [], range_join.mass_window

    def seen(centers, catalog, *a, **b):
        met.append((centers, catalog))
        return window(centers, catalog, *a, **b)

    monkeypatch.setattr(range_join, "mass_window", seen)
    df = QUERIES[name](spark, copies)
    assert rows(df.columns, df.collect()) == sql_rows(copies, name)
    ((centers, catalog),) = met
    assert centers.count() == centers.select("center").distinct().count()
    assert catalog.groupBy("mass").count().agg(F.max("count")).first()[0] <= most


def test_submissions_exchange_lines_once(spark, copies):
    """Medians are found from one exchange of the lines, and rankings that molecules share aren't exchanged with them."""
    df = QUERIES["submission_sink"](spark, copies)
    assert rows(df.columns, df.collect()) == sql_rows(copies, "submission_sink")
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 3 and plan.count("ReusedExchange") == 1
    assert "hashpartitioning(molecule_id" not in plan


def test_median_of_lines(spark, tmp_path):
    """One line, an even and an odd number of them, equal ones, and nulls, which don't count."""
    lines = [(1, 10.0), (2, 1.5), (2, 9.25), (3, 7.0), (3, 3.0), (3, 99.0), (4, 5.0), (4, 5.0), (4, None), (5, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r["grp"]: r["center"] for r in plans.centers(Tables(spark, str(tmp_path))).collect()}
    assert found == {1: 910.0, 2: 905.375, 3: 907.0, 4: 905.0}


@pytest.mark.parametrize("name", ["supported_keys", "cascade_coarse", "cascade_rank", "consensus_search", "spectrum_axis_aggregates", "sparse_cosine_search"])
def test_products_meet_in_blocks(spark, data, monkeypatch, name):
    """Small blocks give the same rows, and no row is made for a pair of a group and a reference."""

    def pairs(*_):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(similarity, "candidate_products", pairs)
    monkeypatch.setattr(similarity, "BLOCK", 3)
    monkeypatch.setattr(similarity, "BLOCK_GROUPS", 1)
    df = QUERIES[name](spark, data)
    found, con = rows(df.columns, df.collect()), duckdb.connect()
    for t in ("part", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    cur = con.execute(ORACLE_SQL[name])
    assert found == rows([c[0] for c in cur.description], cur.fetchall())


def test_peaks_are_matched_in_blocks(spark, data, monkeypatch):
    """No row is made for a pair of spectra; a short list cut in several blocks is the one of rows, with peaks missing, equal, and two modes."""
    t = Tables(spark, data)
    i, (spectra, library) = composed.inputs(t), composed.exact_tables(t)
    lost = lambda df, id_: df.withColumns({"adduct": F.when(F.col(id_) % 5 != 1, F.col("adduct")), "precursor": F.when(F.col(id_) % 7 != 2, F.col("precursor")), "peaks": F.when(F.col(id_) % 11 != 3, F.when(F.col(id_) % 2 == 0, F.col("peaks")).otherwise(F.flatten(F.array("peaks", "peaks"))))})
    spectra, library, centers = lost(spectra, "spectrum"), lost(library, "ref"), retrieval.mass_centers(i.spectra)
    by_mz = F.array_sort(F.transform("peaks", lambda p: F.struct(p["mz"].alias("mz"), p["i"].alias("i"))))
    spectra, library = spectra.withColumn("peaks", by_mz), library.withColumn("peaks", by_mz)
    few = retrieval.Cascade(shortlist=2, spectra=1, size=2)
    want = few.rank(retrieval.reference_products(i.spectra, i.vectors, i.references, i.reference_vectors, centers), spectra, library).toPandas()

    def pairs(*_):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(similarity, "pair_scores", pairs)
    monkeypatch.setattr(similarity, "BLOCK", 2)
    monkeypatch.setattr(similarity, "CELLS", 5000)
    found = few.search(spectra, i.vectors, i.references, library.join(i.reference_vectors, "ref", "left"), centers).toPandas()
    in_order = lambda df: df.sort_values(["group", "rank"])[["group", "rank", "key", "ref", "score"]].round(9).values.tolist()
    assert in_order(found) == in_order(want) and len(found)
    QUERIES["cascade_rank"](spark, data).collect()


@pytest.mark.parametrize("name", ["baseline_rank", "hypothesis_rank", "expanded_rank", "chemical_rerank", "masked_reports"])
def test_pools_are_ranked_in_blocks(spark, data, monkeypatch, name):
    """Small blocks give the same rows, and no row is made for a pair of a molecule and a structure."""

    def pairs(*_, **__):
        raise AssertionError("pairs as rows")

    for of, what in ((retrieval, "candidate_window"), (retrieval, "neural_rank"), (similarity, "analog_scores"), (similarity, "best_of_spectra")):
        monkeypatch.setattr(of, what, pairs)
    monkeypatch.setattr(pools, "BLOCK_GROUPS", 1)
    monkeypatch.setattr(pools, "TOGETHER", 2)
    df = QUERIES[name](spark, data)
    found, con = rows(df.columns, df.collect()), duckdb.connect()
    for t in ("part", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    cur = con.execute(ORACLE_SQL[name])
    assert found == rows([c[0] for c in cur.description], cur.fetchall())


def test_expansions_are_fused_in_blocks(spark, data, monkeypatch):
    """The first of a fusion with an expansion by a function of the key are those of rows, and the blocks give no more than a head and as many others."""
    of = composed.inputs(Tables(spark, data), expanded=True)
    window = retrieval.candidate_window(retrieval.mass_centers(of.spectra, "charge_aware_union"), of.catalog)
    in_rows = retrieval.ranking.ranked(window.select("group", "key", F.length("key").alias("score")), ["group"]).select("group", "key", "rank")

    def pairs(*_, **__):
        raise AssertionError("pairs as rows")

    sizes, settled = [], retrieval.settled
    for settings in ({"expansion_weight": 0.25, "reference_guard": 2, "chemistry": "fragment", "chemistry_weight": 0.5}, {"expansion_weight": 1.0, "confidence_guard": 0.0}):
        recipe = retrieval.Recipe(mass_hypothesis="charge_aware_union", **settings)
        want = recipe.ranking(replace(of, expansion=in_rows))[0].where(F.col("rank") <= recipe.size)
        want = {tuple(r) for r in want.select("group", "key", "rank").collect()}
        with monkeypatch.context() as m:
            m.setattr(retrieval, "candidate_window", pairs)
            m.setattr(pools, "BLOCK_GROUPS", 2)
            m.setattr(retrieval, "settled", lambda df: sizes.append(df) or settled(df))
            assert {tuple(r) for r in recipe.merged(of).select("group", "key", "rank").collect()} == want and want
        assert sizes.pop().select(F.max(F.size("ranking")) <= 100, F.max(F.size("rest")) <= recipe.size).first() == (True, True)


def test_references_are_copied_twice(spark, data, monkeypatch):
    """Bins are as wide as the windows, so that a reference comes to its own and one before; a larger bin is one block still."""
    asked, products = [], similarity.window_products
    monkeypatch.setattr(similarity, "window_products", lambda *a, **b: asked.append(a) or products(*a, **b))
    plans.window_scores(Tables(spark, data))
    ((centers, _, _, _, low, high, width, *_),) = asked
    assert centers.select(F.max(high - low)).first()[0] <= width
    assert similarity.BLOCK >= 8192 and similarity.BLOCK_GROUPS >= 1024


def test_hits_that_leave_blocks(spark):
    """Of 60 keys in a window the first three, and those whose structure is missing or has another mass, which the pool may not hold."""
    df = lambda rows_, schema: spark.createDataFrame(rows_, schema)
    at = [0, 1, 2]
    vectors = lambda n, name: df([(i, at, [((i * k) % 23 + 1) / 40 for k in (5, 7, 11)]) for i in range(n)], f"{name} int, bins array<int>, ws array<double>")
    refs = df([(i, f"k{i}", 100.0) for i in range(60)], "ref int, key string, mass double")
    structures = df([(f"k{i}", 100.0 + (i < 4)) for i in range(1, 60)], "key string, mass double")
    spectra = df([(g, 2 * g + i) for g in range(2) for i in range(2)], "group int, spectrum int")
    asked = (spectra, vectors(4, "spectrum"), refs, vectors(60, "ref"), df([(0, 100.0), (1, 100.0)], "group int, center double"))
    whole = retrieval.library_scores(*asked).collect()
    found = {(r["group"], r["key"]): r["score"] for r in retrieval.library_scores(*asked, structures=structures, first=3).collect()}
    other = {f"k{i}" for i in range(4)}
    for g in range(2):
        own = sorted(((-r["score"], r["key"]) for r in whole if r["group"] == g and r["key"] not in other))
        want = {k: -s for s, k in own if s <= own[2][0]} | {r["key"]: r["score"] for r in whole if r["group"] == g and r["key"] in other}
        assert {k: s for (of, k), s in found.items() if of == g} == want and len(want) < 12


def test_windows_give_each_key_once(spark, monkeypatch):
    """A window over several bins, with a key's references in all of them: one row, with the largest of each spectrum."""
    monkeypatch.setattr(similarity, "BLOCK", 2)
    df = lambda rows_, schema: spark.createDataFrame(rows_, schema)
    queries = df([("g", 1, [0, 1], [0.6, 0.8]), ("g", 2, [1], [1.0])], "group string, spectrum int, bins array<int>, ws array<double>")
    refs = df([(i, f"k{i % 3}", 98.0 + i) for i in range(6)], "ref int, key string, mass double")
    vectors = df([(i, [i % 2], [1.0]) for i in range(6)], "ref int, bins array<int>, ws array<double>")
    c = F.col("center")
    found = similarity.window_products(df([("g", 100.0)], "group string, center double"), queries, refs, vectors, c - 1.5, c + 1.5, 1.0).collect()
    assert sorted((r["key"], r["scores"]) for r in found) == [("k0", [0.8, 1.0]), ("k1", [0.8, 1.0]), ("k2", [0.6, 0.0])]


def test_aggregates_of_arrays(spark):
    one = spark.createDataFrame([("a", [0.3]), ("b", [0.1, 0.9]), ("c", [0.5, 0.2, 0.8]), ("d", [0.4, 0.1, 0.9, 0.6])], "k string, scores array<double>")
    rows_ = one.select("k", F.explode("scores").alias("score"))
    for v in ("mean", "max", "median", "top2"):
        want = {r["k"]: round(r["score"], 9) for r in similarity.over_spectra(rows_, ["k"], v).collect()}
        assert {r["k"]: round(r["s"], 9) for r in one.select("k", similarity.over_scores(F.col("scores"), v).alias("s")).collect()} == want


def test_best_of_spectra_over_blocks(spark):
    rows_ = spark.createDataFrame([("g", "k", [0.1, 0.9]), ("g", "k", [0.5, 0.2]), ("g", "k", [0.3, 0.3]), ("g", "l", [0.0, 0.4])], "group string, key string, scores array<double>")
    found = {r["key"]: r["scores"] for r in similarity.best_of_spectra(rows_).collect()}
    assert found == {"k": [0.5, 0.9], "l": [0.0, 0.4]}


@pytest.fixture(scope="module")
def equal_peaks(spark, tmp_path_factory):
    """Three spectra, each of whose peaks is there four times."""
    at = str(tmp_path_factory.mktemp("peaks"))
    n = spark.range(72)
    events = n.select((F.col("id") % 18 + 50 + F.floor(F.col("id") / 18) * 1000).alias("event_id"), (F.col("id") % 3).alias("user_id"), (10.0 + F.floor(F.col("id") % 18 / 3)).alias("value"))
    events.coalesce(1).write.parquet(f"{at}/events.parquet")
    return at


@pytest.mark.parametrize("name", ["nearest_peak_match", "pair_score"])
def test_equal_peaks_count_once(spark, equal_peaks, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{equal_peaks}/events.parquet/*.parquet')")
    cur = con.execute(ORACLE_SQL[name])
    df = QUERIES[name](spark, equal_peaks)
    assert rows(df.columns, df.collect()) == rows([c[0] for c in cur.description], cur.fetchall())


def test_equal_network_peaks_go_by_event(spark, equal_peaks):
    """Of equal peaks the first events stay, which the SQL leaves open; peaks are those of the SQL."""
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{equal_peaks}/events.parquet/*.parquet')")
    peak = "select user_id, value, events.event_id % 1000 from events join ({}) x on spectrum = user_id and x.event_id = events.event_id order by all"
    found = QUERIES["network_peaks"](spark, equal_peaks).toPandas()
    assert con.execute(peak.format("select * from found")).fetchall() == con.execute(peak.format(ORACLE_SQL["network_peaks"])).fetchall()
    assert set(found["event_id"] // 1000) == {0, 1, 2}  # three of four equal ones


def test_network_peaks_of_odd_masses(spark, tmp_path):
    """Peaks without a mass come last among equals, and masses that are no numbers or as large as longs have their own windows, as in the SQL; no two are equal."""
    odd = [None, 10.0, float("nan"), -30.0, float("inf"), 1e22, -1e22, float("-inf"), 3e23, 20.0, -20.0, 5e24]
    events = [(100 * n + 50 + n // 40 % 2, n % 5, None if (v := odd[n // 5 % 12]) is None else v + (n // 60 if abs(v) < 100 else 0.0)) for n in range(60)]
    events += [(100 * n + 90, n, None) for n in range(60, 65)] + [(100 * n + 90, n - 5, 500.0) for n in range(65, 70)]  # equal but for the mass, where five are kept
    events += [(100 * n + 95, 60 + n % 5, 100.0 * (n // 5)) for n in range(75, 95)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    cur = con.execute(ORACLE_SQL["network_peaks"])
    df = QUERIES["network_peaks"](spark, str(tmp_path))
    assert rows(df.columns, df.collect()) == rows([c[0] for c in cur.description], cur.fetchall())


def test_nearest_meet_few_rows_of_a_mass(spark, monkeypatch):
    met, join = [], range_join.banded_join
    monkeypatch.setattr(range_join, "banded_join", lambda left, right, *a: met.append((left, right)) or join(left, right, *a))
    centers = spark.createDataFrame([(f"q{i}", 5.0 + i % 2) for i in range(20)] + [("none", None)], "grp string, center double")
    catalog = spark.createDataFrame([(i, float(i % 3) + 4) for i in range(90)], "key long, mass double")
    found = range_join.nearest_k(centers, catalog, "grp", 4).orderBy("grp", "rank").collect()
    want = {c: sorted((abs(i % 3 + 4 - c), i) for i in range(90))[:4] for c in (5.0, 6.0)}
    assert [(r["grp"], r["key"]) for r in found] == [(g, k) for g, c in sorted((f"q{i}", 5.0 + i % 2) for i in range(20)) for _, k in want[c]]
    ((left, right),) = met
    assert left.count() == 2 and right.count() == 12


def test_union_of_windows_gathers_no_centers(spark):
    """Windows that touch, overlap, hold one another's masses or are there twice: each key once, from its lowest center; centers are rows, and what is found isn't exchanged."""
    centers = [("a", 100.0), ("a", 100.004), ("a", 100.004), ("a", 100.012), ("a", 101.0), ("a", None), ("b", 100.02), ("c", None), (None, 100.0)]
    masses = [round(99.98 + i / 1000, 3) for i in range(60)] + [100.993999, 100.994, 101.0, 101.006, None, float("nan")]
    tol = lambda c: max(c * 35e-6, 0.006)
    found = range_join.union_window(spark.createDataFrame(centers, "grp string, center double"), spark.createDataFrame(list(enumerate(masses)), "key int, mass double"), "grp", "key")
    want = {}
    for g, c in sorted((x for x in centers if x[1]), key=lambda x: x[1]):
        for k, m in enumerate(masses):
            if m and c - tol(c) <= m <= c + tol(c):
                want.setdefault((g, k), c)
    got = found.collect()
    assert {(r["grp"], r["key"]): r["center"] for r in got} == want and len(got) == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "collect_" not in plan and "lambda" not in plan and "Aggregate" not in plan


def test_ranker_works_features_out_once(spark, data):
    """Lines are exchanged once, before features are worked out; what is ranked lies by group already, and every line is there once."""
    df = QUERIES["feature_ranker"](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan
    lines, of = Tables(spark, data).lineitem, {}
    for r in df.collect():
        of.setdefault(r["grp"], []).append(r)
    assert sum(map(len, of.values())) == lines.count() and len(of) == lines.select("l_orderkey").distinct().count()
    for own in of.values():
        assert [r["rank"] for r in sorted(own, key=lambda r: (-r["score"], r["key"]))] == list(range(1, len(own) + 1))
    assert len({r["score"] for own in of.values() for r in own}) > 2


def test_levels_keep_order(spark):
    """Levels rise with values, few of them stay apart, and missing ones have their own; no row goes."""
    rows_ = [(i, f"k{i}", float(i * 37 % 1000), float(i % 3), None if i % 4 else 1.5, float("nan")) for i in range(1000)]
    df = spark.createDataFrame(rows_, "group int, key string, f_a double, f_b double, f_c double, f_d double")
    found = {r["key"]: r for r in ranker._levels(df, "group").collect()}
    assert len(found) == 1000
    in_order = [found[k]["f_a"] for _, k, *_ in sorted(rows_, key=lambda r: r[2])]
    assert in_order == sorted(in_order) and 25 <= len(set(in_order)) <= 31
    assert len({(found[k]["f_b"], b) for _, k, _, b, *_ in rows_}) == 3 == len({found[k]["f_b"] for k in found})
    assert len({(found[k]["f_c"], c) for _, k, _, _, c, _ in rows_}) == 2 and len({r["f_d"] for r in found.values()}) == 1


def test_pairs_match_all_their_peaks(spark, tmp_path):
    """Spectra of 60 peaks each, none of which is left out; the plain version and the SQL agree."""
    n = spark.range(240)
    events = n.select((F.col("id") + 10 * F.floor(F.col("id") / 60)).alias("event_id"), F.floor(F.col("id") / 60).alias("user_id"), (F.col("id") % 60 * 4 + F.col("id") % 3 / 100).alias("value"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    df = QUERIES["pair_score"](spark, str(tmp_path))
    found = rows(df.columns, df.collect())
    assert found == rows(["spectrum", "score"], con.execute(ORACLE_SQL["pair_score"]).fetchall())
    spectra = {}
    for spectrum, mz, i in con.execute("select user_id, value + 40, (event_id % 100) / 100 from events").fetchall():
        if i >= 0.01 and mz <= 402:
            spectra.setdefault(spectrum, []).append((mz, (i * mz / 100) ** 0.5))
    assert min(map(len, spectra.values())) > 50
    unit = {s: [(m, w / sum(x * x for _, x in p) ** 0.5) for m, w in p] for s, p in spectra.items()}

    def match(a, b):
        near = [(m, w, min((abs(m - x), x, y) for x, y in b)) for m, w in a]
        return sum(w * y for m, w, (d, _, y) in near if d <= max(0.025, m * 15e-6))

    lost = {s: [(400 + s % 3 - m, w) for m, w in p] for s, p in unit.items()}
    want = {s: 0.7 * match(unit[s], unit[s + 1]) * (1 if s % 2 == 0 else 0.7) + 0.3 * match(lost[s], lost[s + 1]) for s in range(3)}
    assert {r["spectrum"]: r["score"] for r in df.collect()} == pytest.approx(want, abs=1e-7)
