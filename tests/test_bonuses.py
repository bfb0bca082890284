"""Motifs, pooled evidence, bonuses, records and admitted scores against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ionsift.functions import graphs, mass, motifs
from ionsift.operators import evidence, retrieval, scorers

NAMES = ["symbol", "hydrogens", "charge", "isotope", "aromatic"]


def structure(smiles):
    atoms, bonds = graphs.parsed(smiles)
    return motifs.Structure([dict(zip(NAMES, a, strict=True)) for a in atoms], [dict(zip(("a", "b", "order"), b, strict=True)) for b in bonds])


def everywhere(own, m):
    """All injections of the motif's atoms, tried one after the other."""
    out = set()
    for chosen in itertools.permutations(range(len(own.atoms)), len(m.atoms)):
        if all(own.fits(c, i) for c, i in zip(m.atoms, chosen, strict=True)):
            orders = [(own.near[chosen[k]].get(chosen[u]), order) for k, bonds in enumerate(m.bonds) for u, order in bonds]
            if all(has is not None and (order == 0 or has == order or order is None and has in (1.0, 1.5)) for has, order in orders):
                out.add(frozenset(chosen))
    return out


def test_motifs_against_all_injections():
    small = ["CC(=O)O", "COC", "C1CC1O", "CS(=O)(=O)O", "NC(=O)C", "OP(=O)(O)O", "C1CO1", "c1ccoc1", "CC(C)(C)O", "N#CC=O"]
    patterns = [p for p in evidence.MOTIFS.values() if len(motifs.motif(p).atoms) <= 6] + ["C~C", "C=O", "C#N", "[C;R][O;R]", "[CH2,CH3]", "c:c", "[C;H3]-O", "C(C)(C)C"]
    assert sum(len(everywhere(structure(s), motifs.motif(p))) for s in small for p in patterns) > 50
    for s, p in itertools.product(small, patterns):
        assert structure(s).occurrences(motifs.motif(p)) == everywhere(structure(s), motifs.motif(p)), (s, p)


def test_rings_against_removing_bonds():
    """An atom is on a ring exactly if one of its bonds can go without parting its ends."""
    random.seed(5)
    for _ in range(800):
        n = random.randint(1, 8)
        pairs = list(itertools.combinations(range(n), 2))
        bonds = random.sample(pairs, random.randint(0, min(len(pairs), 10)))
        want = set()
        for a, b in bonds:
            seen, todo = set(), [a]
            while todo:
                u = todo.pop()
                if u not in seen:
                    seen.add(u)
                    todo += [y if x == u else x for x, y in bonds if u in (x, y) and (x, y) != (a, b)]
            want |= {a, b} if b in seen else set()
        assert motifs.in_rings(n, bonds) == want


def test_known_structures(spark):
    known = {
        "CC(=O)Oc1ccccc1C(=O)O": {"water": 1, "carbon_monoxide": 2, "carbon_dioxide": 2, "phenyl_ion": 1, "benzyl_tropylium_ion": 1, "benzoyl_ion": 1, "benzoate_ion": 1, "acetic_acid": 1},
        "OCC1OC(O)C(O)C(O)C1O": {"water": 5, "hexose_residue": 1, "deoxyhexose_residue": 1}, "OCC1OC(O)C(O)C1O": {"water": 4, "pentose_residue": 1},
        "COP(=O)(O)OCC[N+](C)(C)C": {"water": 1, "phosphocholine": 1, "phosphate_ion": 1, "dihydrogen_phosphate_ion": 1, "methanol": 1, "phosphoric_acid": 1, "metaphosphoric_acid": 1},
        "[2H]OC": {"water": 1, "methanol": 1}, "C": {},
    }
    rows = [(s,) for s in [*known, None, "C1CC"]]
    df = spark.createDataFrame(rows, "s string").withColumn("g", graphs.graph(F.col("s")))
    found = {r["s"]: r["c"] for r in df.select("s", evidence.support(F.col("g"), list(evidence.ALL_RULES)).alias("c")).collect()}
    assert found.pop(None) is None and found.pop("C1CC") is None
    assert {s: {r: n for r, n in zip(evidence.ALL_RULES, c, strict=True) if n} for s, c in found.items()} == known


@pytest.mark.parametrize("pattern", ["", "C(", "C1C", "C)", "[Q]", "[]", "C=", "1C", "[C;]", "C.C"])
def test_patterns_refused(pattern):
    with pytest.raises(ValueError):
        motifs.motif(pattern)


FOUND = [(1, "water", "precursor_loss", 0.4), (1, "water", "precursor_loss", 0.6), (2, "water", "precursor_loss", 0.8), (2, "phenyl_ion", "ion", 0.5), (4, "methanol", "peak_loss", 1.0)]
SPECTRA = [(1, 7), (2, 7), (3, 7), (4, 8), (5, 9)]


@pytest.fixture(scope="module")
def seen(spark):
    return spark.createDataFrame(FOUND, "spectrum long, rule string, kind string, strength double"), spark.createDataFrame(SPECTRA, "spectrum long, grp long")


def test_pooling(seen):
    out = {how: {(r["grp"], r["rule"]): round(r["strength"], 9) for r in evidence.pooled(*seen, "grp", how).collect()} for how in ("max", "mean", "intensity")}
    assert out["max"] == {(7, "water"): 0.8, (7, "phenyl_ion"): 0.5, (8, "methanol"): 1.0}
    assert out["mean"] == {(7, "water"): round(1.4 / 3, 9), (7, "phenyl_ion"): round(0.5 / 3, 9), (8, "methanol"): 1.0}
    assert out["intensity"] == {(7, "water"): round(1.0 / 3, 9), (7, "phenyl_ion"): round(0.25 / 3, 9), (8, "methanol"): 1.0}
    with pytest.raises(ValueError):
        evidence.pooled(*seen, "grp", "median")


def at(rule, kind):
    return evidence.ALL_RULES.index(rule) * 3 + evidence.KINDS.index(kind)


def test_bonus_ways(spark, seen):
    """Every way by hand: unknown structures, groups without evidence, and candidates without the motif keep their scores."""
    counts = {"a": {"water": 3, "phenyl_ion": 1}, "b": {}, "c": None}
    rows = [(g, k, 0.5, None if c is None else [c.get(r, 0) for r in evidence.ALL_RULES], [2.0 if i % 2 == 0 else -1.0 for i in range(60)], 11) for g in (7, 9) for k, c in counts.items()]
    df = spark.createDataFrame(rows, "grp long, key string, score double, counts array<int>, predicted array<double>, channels_of long")
    water, phenyl = at("water", "precursor_loss"), at("phenyl_ion", "ion")
    pools = {"max": (0.8, 0.5), "mean": (1.4 / 3, 0.5 / 3), "intensity": (1.0 / 3, 0.25 / 3)}
    for name in ("extended", "max", "intensity", "full_gap", "count", "forward"):
        way = evidence.BONUSES[name]
        weights = [way.budget / way.dimension] * way.dimension
        w, (x, y) = weights[0], pools[way.pooling]
        extra_a = {"counts": x * (3 - 1) / (3 + 1), "predicted": x * (water % 2 == 0) + y * (phenyl % 2 == 0)}.get(way.extra, 0.0)
        extra_b = {"predicted": x * (water % 2 == 0) + y * (phenyl % 2 == 0)}.get(way.extra, 0.0)
        out = evidence.candidate_bonus(df, *seen, "grp", way, weights)
        assert out.columns == df.columns
        got = {(r["grp"], r["key"]): r["score"] for r in out.collect()}
        want = {(7, "a"): 0.5 + w * (x + y + extra_a), (7, "b"): 0.5 + w * extra_b, (7, "c"): 0.5, (9, "a"): 0.5, (9, "b"): 0.5, (9, "c"): 0.5}
        assert got == pytest.approx(want, abs=1e-12), name
    with pytest.raises(ValueError):
        evidence.candidate_bonus(df, *seen, "grp", evidence.BONUSES["max"], [0.0] * 59)
    with pytest.raises(ValueError):
        evidence.candidate_bonus(df, *seen, "grp", evidence.BONUSES["max"], [0.05 / 59] * 60)


def test_conditional(spark, seen):
    rules = list(evidence.ALL_RULES)
    predicted = spark.createDataFrame([(1, "a", [0.5] * 60), (2, "a", [3.0] * 60), (2, "b", [-1.0] * 60), (3, "a", [1.0] * 60)], "spectrum long, key string, predicted array<double>")
    out = {(r["grp"], r["key"]): r["conditional"] for r in evidence.conditional(*seen, predicted, "grp", "key", rules).collect()}
    want = [0.0] * 60
    want[at("water", "precursor_loss")], want[at("phenyl_ion", "ion")] = (0.6 * 0.5 + 0.8) / 3, 0.5 / 3
    assert set(out) == {(7, "a"), (7, "b")}
    assert out[7, "a"] == pytest.approx(want) and out[7, "b"] == [0.0] * 60
    way = evidence.BONUSES["energy"]
    rows = spark.createDataFrame([(7, "a", 1.0, [0] * 20), (7, "z", 1.0, [0] * 20)], "grp long, key string, score double, counts array<int>")
    joined = rows.join(evidence.conditional(*seen, predicted, "grp", "key", rules), ["grp", "key"], "left")
    got = {r["key"]: r["score"] for r in evidence.candidate_bonus(joined, *seen, "grp", way, [2.0 / 120] * 120).collect()}
    assert got == pytest.approx({"a": 1.0 + 2.0 / 120 * sum(want), "z": 1.0})


def test_records(spark):
    rows = [(1, "library", "b", 0.9), (1, "library", "a", 0.9), (1, "library", "c", 0.4), (1, "wide", "d", 0.1), (2, "wide", "a", 0.3), (3, None, "a", 0.3)]
    df, known = spark.createDataFrame(rows, "g long, variant string, key string, score double"), spark.createDataFrame([(1,), (1,), (9,)], "g long")
    out = {r["g"]: (r["rankings"], r["confidence"], r["margin"], r["candidates"], r["known"]) for r in retrieval.records(df, known, "g", size=2).collect()}
    assert out == {1: ({"library": ["a", "b"], "wide": ["d"]}, 0.9, 0.0, 4, True), 2: ({"wide": ["a"]}, 0.0, 0.0, 1, False)}
    one = retrieval.records(df.where("g = 1"), known, "g", size=1).first()
    assert one["rankings"] == {"library": ["a"], "wide": ["d"]} and one["margin"] == 0.0


def test_admitted(spark):
    results = spark.createDataFrame([("a", "complete"), ("b", "running"), ("c", "complete"), ("d", "complete"), ("e", "complete"), ("f", None), ("g", "complete"), ("g", "running")], "context string, status string")
    scores = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.0), ("b", "x", 1.0), ("c", "q", 1.0), ("c", "x", float("inf")), ("d", "x", None), ("g", "x", 1.0), ("h", "x", 1.0)], "context string, key string, score double")
    candidates = spark.createDataFrame([(c, k) for c in "abcdefgh" for k in "xy"], "context string, key string")
    fine, outcomes = scorers.admitted(results, scores, candidates)
    assert {r["context"]: r["outcome"] for r in outcomes.collect()} == {"a": "admitted", "b": "incomplete", "c": "unknown_candidate", "d": "invalid_score", "e": "admitted", "f": "incomplete", "g": "incomplete"}
    assert sorted(tuple(r) for r in fine.collect()) == [("a", "x", 1.0), ("a", "y", 0.0)]


def test_identities(spark):
    df = spark.createDataFrame([(100.5, "[M+H]+", 2), (100.5, None, 2), (100.5, "[M+H]+", 2)], "mass double, adduct string, depth int")
    same = [r[0] for r in df.select(scorers.context_identity(depth=F.col("depth"), adduct=F.col("adduct"), mass=F.col("mass"))).collect()]
    other = [r[0] for r in df.select(scorers.context_identity(mass=F.col("mass"), depth=F.col("depth"), adduct=F.col("adduct"))).collect()]
    assert same == other and same[0] == same[2] != same[1]
    keys = spark.createDataFrame([("a", "b,c"), ("a,b", "c"), (None, "c")], "k string, s string").select(scorers.candidate_identity(F.col("k"), F.col("s"))).collect()
    assert len({r[0] for r in keys}) == 3


def test_ion_table(spark):
    """The table agrees with the parsed adduct, but for the doubly charged one whose name says one."""
    df = spark.createDataFrame([(a, 300.0) for a in [*mass.IONS, "[M+Xx]+", None]], "a string, mz double")
    for r in df.select("a", mass.ion_table_mass(F.col("a"), F.col("mz")).alias("t"), mass.neutral_mass(F.col("a"), F.col("mz")).alias("p")).collect():
        if r["a"] in mass.IONS and r["a"] not in ("[M-2H]-", "[M+Na-2H]-", "[2M+Na-2H]-"):
            assert r["t"] == pytest.approx(r["p"], abs=1e-5), r["a"]
        elif r["a"] not in mass.IONS:
            assert r["t"] is None
    assert len(mass.IONS) == 29


def test_sides_by_hand():
    """Rings, double bonds and several parts have no sides there; hydrogens stay where they were."""
    assert structure("CCO").sides() == {(("C", 1),), (("C", 1), ("O", 1)), (("C", 2),), (("O", 1),)}
    assert structure("CCO").sides(True) == {(("C", 1), ("H", 3)), (("C", 1), ("H", 3), ("O", 1)), (("C", 2), ("H", 5)), (("H", 1), ("O", 1))}
    assert structure("C1CC1").sides() == set() and structure("C=O").sides() == set() and structure("CC.O").sides() == set()
    assert structure("Cc1ccccc1").sides() == {(("C", 1),), (("C", 6),)}
    assert structure("C=CC#N").sides(True) == {(("C", 2), ("H", 3)), (("C", 1), ("N", 1))}


def test_connected_support(spark):
    """An aromatic acid's phenyl and benzoyl come off by a single bond; a fused ring has no phenyl side, though the motif occurs; several parts have none."""
    rows = ["c1ccccc1C(=O)O", "c1ccc2ccccc2c1", "CCc1ccccc1", "CCOC", "c1ccccc1.C", "CCC(=O)c1ccccc1"]
    df = spark.createDataFrame([(s,) for s in [*rows, None]], "s string").withColumn("g", graphs.graph(F.col("s")))
    rules = list(evidence.ALL_RULES)
    broad = {r[0] for r in evidence.BROAD}
    df = df.select("s", evidence.support(F.col("g"), rules).alias("plain"), evidence.connected_support(F.col("g"), rules).alias("c"), evidence.exact_support(F.col("g"), rules).alias("x"))
    out = {r["s"]: r.asDict() for r in df.collect()}
    assert out.pop(None) == {"s": None, "plain": None, "c": None, "x": None}
    named = lambda s, c: {r for r, n in zip(rules, out[s][c], strict=True) if n}
    for s in rows:
        assert set(rules) - broad <= named(s, "x") <= named(s, "c")
    kept = {s: named(s, "c") & named(s, "plain") & broad for s in rows}
    assert kept == {rows[0]: {"phenyl_ion", "benzoyl_ion"}, rows[1]: set(), rows[2]: {"phenyl_ion", "benzyl_tropylium_ion"}, rows[3]: {"methanol"}, rows[4]: set(), rows[5]: {"phenyl_ion", "benzoyl_ion"}}
    assert {s: named(s, "x") & named(s, "plain") & broad for s in rows[:3]} == {rows[0]: {"phenyl_ion", "benzoyl_ion"}, rows[1]: set(), rows[2]: {"phenyl_ion", "benzyl_tropylium_ion"}}


def test_refined_ions(spark, seen):
    """An ion of a refined rule counts for exact candidates alone; its losses and other rules' ions are left as they are."""
    found = spark.createDataFrame([(1, "benzoyl_ion", "ion", 1.0), (1, "phenyl_ion", "ion", 1.0), (1, "water", "peak_loss", 1.0)], "spectrum long, rule string, kind string, strength double")
    spectra, rules = spark.createDataFrame([(1, 7)], "spectrum long, grp long"), evidence.ALL_RULES
    rows = [(7, k, 0.0, [1] * 20, [yes or r not in ("benzoyl_ion", "phenyl_ion") for r in rules]) for k, yes in (("a", True), ("b", False))]
    df = spark.createDataFrame(rows, "grp long, key string, score double, counts array<int>, sides array<boolean>")
    got = {r["key"]: r["score"] for r in evidence.candidate_bonus(df, found, spectra, "grp", evidence.BONUSES["aromatic"], [2.0 / 60] * 60).collect()}
    assert got == pytest.approx({"a": 3 * 2.0 / 60, "b": 2 * 2.0 / 60})
    got = {r["key"]: r["score"] for r in evidence.candidate_bonus(df, found, spectra, "grp", evidence.BONUSES["connected"], [2.0 / 60] * 60).collect()}
    assert got == pytest.approx({"a": 3 * 2.0 / 60, "b": 2.0 / 60})  # all six ions


def test_token_masses(spark):
    tokens = {"C": 12.0, "c": 12.0, "Cl": mass.ATOMIC_MASS["Cl"], "[nH]": mass.ATOMIC_MASS["N"], "[13CH3]": graphs.ISOTOPE_MASS["13C"], "[2H]": graphs.ISOTOPE_MASS["2H"], "[11CH4]": 11.0, "=": 0.0, "(": 0.0, "1": 0.0, "%10": 0.0, "[*]": 0.0, "*": 0.0, "[Xx]": 0.0, "[Na+]": mass.ATOMIC_MASS["Na"], "[C@@H]": 12.0, "<eos>": 0.0}
    df = spark.createDataFrame([(t,) for t in [*tokens, None]], "t string")
    got = {r["t"]: r["m"] for r in df.select("t", graphs.token_mass(F.col("t")).alias("m")).collect()}
    assert got.pop(None) == 0.0
    assert got == pytest.approx(tokens)
