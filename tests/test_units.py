"""Single operators on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ionsift import schema
from ionsift.functions import mass, peaks, text
from ionsift.operators import cohort, evaluation, evidence, proposals, range_join, scorers, similarity
from ionsift.sources import readers, sinks
from ionsift.streaming import handoff


def test_round_trip_of_ions(spark):
    df = spark.createDataFrame([(a,) for a in ("[M+H]+", "[M-H]-", "[M+2H]2+", "[M+3H]3+", "[2M+Na]+", "[2M-H]-", "[M]+")], "adduct string")
    ion = mass.parse_adduct(F.col("adduct"))
    mz = (300.0 * ion["molecules"] + ion["shift"]) / F.abs(ion["charge"])
    assert all(abs(r[0] - 300) < 1e-8 for r in df.select(mass.neutral_mass(F.col("adduct"), mz)).collect())


def test_mass_window_is_closed_and_has_a_floor(spark):
    c = spark.createDataFrame([("a", 100.0), ("b", 100.005), ("c", 100.02)], "key string, mass double")
    q = spark.createDataFrame([("q", 100.0), ("n", None)], "grp string, center double")
    assert {r["key"] for r in range_join.mass_window(q, c).collect()} == {"a", "b"}


def test_nearest_k_against_sorting(spark):
    random.seed(3)
    cat = [(i, round(random.uniform(0, 100), 1)) for i in range(300)]
    qs = [(f"q{i}", random.uniform(-20, 140)) for i in range(15)]
    found = range_join.nearest_k(spark.createDataFrame(qs, "grp string, center double"), spark.createDataFrame(cat, "key long, mass double"), "grp", 7)
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault(r["grp"], []).append(r["key"])
    assert got == {g: [k for _, k in sorted((abs(m - c), k) for k, m in cat)[:7]] for g, c in qs}


def test_metrics(spark):
    ranking = [("a", "a", 1), ("b", "x", 1), ("b", "b", 2), *[("c", f"x{i}", i + 1) for i in range(25)], ("c", "c", 26)]
    rows = evaluation.per_key(
        spark.createDataFrame(ranking, "group string, key string, rank int"), spark.createDataFrame([(x, x) for x in "abcd"], "group string, key string"), spark.createDataFrame([(x, x) for x in "abc"], "group string, key string")
    )
    r = evaluation.report(rows).first()
    assert (r["mrr25"], r["candidate_recall"], r["conditional_mrr25"]) == (0.375, 0.75, 0.5)


def test_one_carbon_monoxide_loss(spark):
    spectra = spark.createDataFrame([("s", "[M+H]+", "positive", "Orbitrap", 150.0)], "spectrum string, adduct string, ionization_mode string, instrument_type string, precursor_mz double")
    masses = [150 - 27.99491461957, 150 - 28.0061480089, 150 - 18.01056468403]
    p = spark.createDataFrame([("s", i, m, 1.0) for i, m in enumerate(sorted(masses))], "spectrum string, at int, mz double, intensity double")
    found = evidence.matches(spectra, p, evidence.rule_table(spark)).where("kind = 'precursor_loss'").collect()
    assert sorted(r["rule"] for r in found) == ["carbon_monoxide", "water"]


def test_unequal_peak_arrays_fail(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "m array<double>, i array<double>")
    with pytest.raises(Exception, match="unequal"):
        df.select(peaks.relative_peaks(F.col("m"), F.col("i"))).collect()


def test_peak_tokens_keep_protected(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [0.9, 0.8, 0.1, 0.7], [False, False, True, False])], "m array<double>, i array<double>, s array<boolean>")
    t = df.select(peaks.peak_tokens(peaks.zipped(F.col("m"), F.col("i")), F.col("s"), 4).alias("t")).first()["t"]
    assert [x["mz"] for x in t] == [1.0, 2.0, 3.0, 4.0]


def test_bits(spark):
    df = spark.createDataFrame([([0, 5, 63, 64, 200, 2047], [5, 63, 100])], "a array<int>, b array<int>")
    a, b = similarity.packed_bits(F.col("a")), similarity.packed_bits(F.col("b"))
    r = df.select(similarity.unpacked_bits(a).alias("u"), similarity.tanimoto_words(a, b).alias("w"), similarity.tanimoto_arrays(F.col("a"), F.col("b")).alias("t")).first()
    assert (r["u"], r["w"], r["t"]) == ([0, 5, 63, 64, 200, 2047], 2 / 7, 2 / 7)


def test_vocabulary_round_trip(spark):
    df = spark.createDataFrame([("CC(=O)[Na]",), ("BrC",)], "smiles string")
    v = text.vocabulary(df, "smiles")
    names = [r["token"] for r in v.orderBy("id").collect()]
    coded = text.encode(df, "smiles", v).withColumn("back", text.decode(F.col("ids"), F.array(*[F.lit(n) for n in names])))
    assert all(r["smiles"] == r["back"] for r in coded.collect())
    assert text.encode(spark.createDataFrame([("N",)], "smiles string"), "smiles", v).first()["ids"] is None


def test_beam_is_exhaustive():
    import itertools

    random.seed(5)
    logp = [[random.random() for _ in range(5)] for _ in range(4)]
    best = sorted(((sum(r[c] for r, c in zip(logp, cs, strict=True)), cs) for cs in itertools.product(range(5), repeat=4)), key=lambda x: (-x[0], x[1]))[:6]
    assert [tuple(c) for _, c in proposals.beam(logp, 6)] == [c for _, c in best]


def test_merge_keeps_the_first_mass(spark):
    rows = [("g", 1, "A", 300.0, 301.0, [100.0, 200.0], [0.5, 1.0]), ("g", 2, "A", 300.001, 301.0, [100.001, 150.0], [0.9, 0.2]), ("g", 3, None, None, 301.0, [50.0], [1.0])]
    df = spark.createDataFrame(rows, "grp string, row int, alias string, mass double, precursor_mz double, mzs array<double>, intensities array<double>")
    out = {r["merged"]: r for r in evidence.merge_peaks(df, "grp").collect()}
    assert (out[2]["mzs"], out[2]["intensities"], out[1]["mzs"]) == ([100.0, 150.0, 200.0], [0.9, 0.2, 1.0], [50.0])


def test_merge_runs_and_clusters(spark):
    """Runs hang on their first mass and don't drift; clusters on the first spectrum; peaks at the precursor go; a lone spectrum keeps all; medians of precursors."""
    schema_ = "grp string, row int, alias string, mass double, precursor_mz double, mzs array<double>, intensities array<double>"
    rows = [
        ("drift", 1, "A", 500.0, 501.0, [100.0, 100.0016, 300.0], [0.1, 0.2, 0.3]), ("drift", 2, "A", 500.0, 501.0, [100.0032, 300.0, 500.995], [0.9, 0.1, 1.0]),
        ("chain", 1, "A", 500.0, 501.0, [10.0], [1.0]), ("chain", 2, "A", 500.004, 501.5, [20.0], [1.0]), ("chain", 3, "A", 500.008, 503.0, [30.0], [1.0]), ("chain", 4, "B", 500.0, 501.0, [40.0], [1.0]),
        ("lone", 1, "A", 500.0, 501.0, [600.0, 5.0], [1.0, 0.5]), ("none", 1, None, 500.0, 501.0, None, None), ("none", 2, "A", None, 501.0, [], []),
    ]
    out = {}
    for r in evidence.merge_peaks(spark.createDataFrame(rows, schema_), "grp").collect():
        out.setdefault(r["grp"], []).append((r["merged"], r["precursor_mz"], list(zip(r["mzs"], r["intensities"], strict=True))))
    assert out["drift"] == [(2, 501.0, [(100.0, 0.2), (100.0032, 0.9), (300.0, 0.3)])]
    assert sorted(out["chain"]) == [(1, 501.0, [(40.0, 1.0)]), (1, 503.0, [(30.0, 1.0)]), (2, 501.25, [(10.0, 1.0), (20.0, 1.0)])]
    assert out["lone"] == [(1, 501.0, [(600.0, 1.0), (5.0, 0.5)])]
    assert out["none"] == [(1, 501.0, []), (1, 501.0, [])]


def test_pairs_keep_repeated_signatures(spark):
    """Every row meets every row of another energy, rows of one signature alike; unknown adducts meet nobody; a draw is one of them."""
    rows = [(i, "m", adduct, energy) for i, (adduct, energy) in enumerate([("A", [10.0]), ("A", [10.0]), ("A", [20.0]), ("A", [20.0, 10.0]), ("A", None), ("unknown", [10.0]), ("unknown", [20.0]), (None, [10.0]), (None, [30.0]), ("B", [10.0])])]
    df = spark.createDataFrame(rows, "row long, mol string, adduct string, energy array<double>")
    args = (df, ["mol", "adduct"], "row", "energy", ["adduct"])
    pairs = {tuple(r) for r in cohort.energy_pairs(*args).collect()}
    assert pairs == {(0, 2), (2, 0), (1, 2), (2, 1), (0, 3), (3, 0), (1, 3), (3, 1), (2, 3), (3, 2)}
    counts = {r["row"]: r["partners"] for r in cohort.energy_classes(*args).collect()}
    assert counts == {0: 2, 1: 2, 2: 3, 3: 3, 9: 0}
    drawn = {tuple(r) for r in cohort.drawn_partner(*args).collect()}
    assert {p for p in drawn if p[0] < 4} <= pairs and {p for p in drawn if p[0] >= 4} == {(i, i) for i in range(4, 10)}
    assert {tuple(r) for r in cohort.energy_pairs(df, ["mol", "adduct"], "row", "energy").where("row > 4").collect()} == {(5, 6), (6, 5), (7, 8), (8, 7)}
    second = {tuple(r) for r in cohort.second_rows(df, df, ["mol", "adduct"], "row").collect()}
    assert len(second) == 10 and (9, 9) in second and all(a != b and rows[a][2] == rows[b][2] for a, b in second if a != 9)


def test_nearest_other_looks_at_neighbours(spark):
    """Of three equal masses the outer ones have one equal neighbour, the middle one two; a distant key of the same mass is no neighbour."""
    rows = [("a", 1.0), ("b", 5.0), ("c", 5.0), ("d", 5.0), ("e", 6.0), ("z", 9.0)]
    random.shuffle(rows)
    out = {r["key"]: (r["other"], r["distance"]) for r in range_join.nearest_other(spark.createDataFrame(rows, "key string, mass double")).collect()}
    assert out == {"a": ("b", 4.0), "b": ("c", 0.0), "c": ("b", 0.0), "d": ("c", 0.0), "e": ("d", 1.0), "z": ("e", 3.0)}


def test_ordered_merge_counts_parts(spark):
    order = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "key string, position int")
    parts = [spark.createDataFrame([(k,) for k in ks], "key string") for ks in (["a", "b"], ["b"])]
    assert {r["key"]: r["count"] for r in cohort.merge_in_order(parts, order, "key", "position").collect()} == {"a": 1, "b": 2, "c": 0}


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(200)], "group long, d double")
    r = evaluation.bootstrap(df, "group", 400).first()
    assert r["low"] < r["gain"] == 2.0 < r["high"] and r["high"] - r["low"] < 0.8
    assert evaluation.bootstrap(df.repartition(7), "group", 400).first() == r


def test_contracts(spark):
    df = spark.createDataFrame([("m", 1.0)], "molecule_id string, SMILES double")
    assert schema.forbid(df) is df
    with pytest.raises(ValueError, match="label"):
        schema.forbid(df.withColumn("InChIKey14", F.lit("x")))
    with pytest.raises(ValueError, match="missing"):
        schema.require(df, "mass")
    assert schema.unique(df.union(df), "molecule_id").first()["rows"] == 2
    with pytest.raises(Exception, match="confidence"):
        df.select(schema.confidence(F.lit(1.1))).collect()


def test_missing_runtime_is_an_error():
    with pytest.raises(scorers.MissingRuntime):
        scorers.Registry().column("fingerprint", "none", F.col("x"))


def test_plug_in(spark):
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql import types as T

    reg = scorers.Registry()
    reg.register("structure_key", "upper", lambda x: pc.utf8_upper(x).cast(pa.string()), T.StringType())
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "s string")
    assert sorted(r["k"] for r in reg.on_distinct(df, "structure_key", "upper", "s", "k").collect()) == ["A", "A", "B"]


def test_readers(spark, tmp_path):
    import gzip

    p = tmp_path / "c.tsv.gz"
    p.write_bytes(gzip.compress(b"chembl_id\tcanonical_smiles\tstandard_inchi_key\nC1\tCC\tABCDEFGHIJKLMN-X\nC2\t\tQ\n"))
    assert [tuple(r) for r in readers.chembl(spark, f"file://{p}").collect()] == [("ABCDEFGHIJKLMN", "CC", "C1", "chembl")]
    (tmp_path / "p.csv").write_text("Identifier,FirstBlock,SMILES,MolecularFormula,MonoisotopicMass,AnnoTypeCount\n7,KEY,CC,C2H6,30.05,3\n8,,C,CH4,16.0,1\n")
    assert [r["pubchem_cid"] for r in readers.pubchem(spark, f"file://{tmp_path}/p.csv").collect()] == [7]
    with pytest.raises(FileNotFoundError):
        readers.located(spark, f"file://{tmp_path}/*.none")
    assert readers.located(spark, f"file://{tmp_path}/*.csv").endswith("p.csv")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "a int, mass double")
    at = str(tmp_path / "t")
    assert sinks.write_once(df, at, {"v": 1}) and not sinks.write_once(df, at, {"v": 1})
    with pytest.raises(ValueError):
        sinks.write_once(df, at, {"v": 2})
    sinks.write_table(df, str(tmp_path / "m"), "mass", 2)
    assert readers.windowed(spark, str(tmp_path / "m"), 1.0, 3.0).count() == 1
    with pytest.raises(ValueError):
        sinks.write_json(str(tmp_path / "x.json"), float("nan"))
    sinks.write_json(str(tmp_path / "x.json"), {"a": 1})
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": 1}
    assert sinks.markdown(df) == "| a | mass |\n|---|---|\n| 1 | 2.0000 |\n"


def test_handoffs_once(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    make = lambda ids: spark.createDataFrame([(i, ["a"], 0.5, False) for i in ids], handoff.HANDOFF)
    handoff.emit(make(["m1", "m2"]), folder)
    run = lambda: handoff.consume(handoff.handoffs(spark, folder), lambda df, _: seen.extend(r["molecule_id"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    run()
    handoff.emit(make(["m2", "m3"]), folder)
    run()
    assert sorted(seen) == ["m1", "m2", "m3"]


def test_reservoir_state(spark, tmp_path):
    folder = str(tmp_path / "ev")
    rows = [("k", i) for i in range(50)]
    spark.createDataFrame(rows, "key string, row long").repartition(5).write.json(folder)
    stream = spark.readStream.schema("key string, row long").option("maxFilesPerTrigger", 1).json(folder)
    q = handoff.reservoirs(stream, "key", "row", 4).writeStream.outputMode("update").format("memory").queryName("res").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = [r["row"] for r in spark.createDataFrame(rows, "key string, row long").orderBy(F.xxhash64("key", "row")).limit(4).collect()]
    assert want in [r["rows"] for r in spark.table("res").collect()]
