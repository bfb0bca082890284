"""Graphs, fragments, catalogs, indexes, stores and blobs against plain versions."""

import gzip
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from ionsift.functions import graphs
from ionsift.functions.mass import ATOMIC_MASS
from ionsift.operators import catalog, range_join
from ionsift.sources import blobs, readers, stores


def sides(n, bonds, gone):
    """Atom sets of the parts without some bonds, by walking."""
    near = {v: [] for v in range(n)}
    for k, (a, b) in enumerate(bonds):
        if k not in gone:
            near[a].append(b)
            near[b].append(a)
    seen, out = set(), set()
    for v in range(n):
        if v not in seen:
            part, todo = set(), [v]
            while todo:
                u = todo.pop()
                if u not in part:
                    part.add(u)
                    todo += near[u]
            seen |= part
            out.add(frozenset(part))
    return out


def test_cut_sets_against_walking():
    """Trees, rings, rings that share bonds, several parts: every bond, and every two, removed in turn."""
    random.seed(3)
    for _ in range(1500):
        n = random.randint(1, 9)
        pairs = list(itertools.combinations(range(n), 2))
        bonds = random.sample(pairs, random.randint(0, min(len(pairs), 11)))
        for breaks in (1, 2):
            want = sides(n, bonds, set())
            for k in range(1, breaks + 1):
                for gone in itertools.combinations(range(len(bonds)), k):
                    want |= sides(n, bonds, set(gone))
            assert {frozenset(i for i in range(n) if s >> i & 1) for s in graphs.cut_sets(n, bonds, breaks)} == want


def test_graphs_by_hand(spark):
    """Formulas of well-known structures, and what is refused."""
    known = {
        "CCO": "C2H6O", "c1ccccc1": "C6H6", "C1CC1=O": "C3H4O", "c1cc[nH]c1": "C4H5N", "Cn1cccc1": "C5H7N", "CC(=O)Oc1ccccc1C(=O)O": "C9H8O4", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C": "C8H10N4O2", "C%12CCCCC%12": "C6H12",
        "N#N": "N2", "OS(=O)(=O)O": "H2O4S", "C[C@@H](N)C(=O)O": "C3H7NO2", "F/C=C\\F": "C2H2F2", "c1ccc2ccccc2c1": "C10H8", "ClC(Cl)Cl": "CHCl3", "[2H]O[2H]": "H2O", "[NH4+].[Cl-]": "ClH4N", "[Na+].[O-]C(C)=O": "C2H3NaO2", "c1ccsc1": "C4H4S",
        "OP(=O)(O)O": "H3O4P", "C[N+](C)(C)C": "C4H12N", "C=C=C": "C3H4", "[H][H]": "H2", "C1=CC=CC=C1": "C6H6", "BrB(Br)Br": "BBr3",
    }
    refused = ["", None, "C(C", "C)C", "C1CC", "C==C", "CC=", "(C)", "C()C", "=C", "CCCCC(C)(C)(C)C", "FF(F)", "C1C1", "Cx", "C..C", "C.", ".C", "[C", "C11", "[Q+]"]
    df = spark.createDataFrame([(s, f) for s, f in known.items()] + [(s, None) for s in refused], "smiles string, want string").withColumn("g", graphs.graph(F.col("smiles")))
    rows = df.select("smiles", "want", graphs.composition(F.col("g")).alias("c")).collect()
    for r in rows:
        if r["want"] is None:
            assert r["c"] is None, r
            continue
        assert r["c"]["formula"] == r["want"], r
        plain = sum(ATOMIC_MASS[e] * int(n or 1) for e, n in re.findall("([A-Z][a-z]?)([0-9]*)", r["want"]))
        assert abs(r["c"]["mass"] - plain) < 0.002
    of = {r["smiles"]: r["c"] for r in rows}
    assert (of["[NH4+].[Cl-]"]["parts"], of["[NH4+].[Cl-]"]["charge"], of["C[N+](C)(C)C"]["charge"], of["CCO"]["parts"]) == (2, 0, 1, 1)
    assert of["[2H]O[2H]"]["isotopes"] and not of["CCO"]["isotopes"] and of["CCO"]["carbons"] == 2
    assert of["C[N+](C)(C)C"]["mass"] == pytest.approx(4 * 12 + 12 * ATOMIC_MASS["H"] + ATOMIC_MASS["N"] - 0.000548579909)


def test_fragment_masses(spark):
    """Ethanol by hand; rings and chains against removing bonds one after the other; the bounds on bonds and breaks."""
    smiles = ["CCO", "C1CC1O", "c1ccccc1CC", "C.O", "C", "*C", "C1CC1", "CC(C)(C)C", "C" * 36]
    df = spark.createDataFrame([(s,) for s in smiles] + [(None,)], "smiles string").withColumn("g", graphs.graph(F.col("smiles")))
    got = {r["smiles"]: r for r in df.select("smiles", "g", graphs.fragment_masses(F.col("g")).alias("two"), graphs.fragment_masses(F.col("g"), 1).alias("one"), graphs.fragment_masses(F.col("g"), 2, 40).alias("wide")).collect()}
    c, h, o = 12.0, ATOMIC_MASS["H"], ATOMIC_MASS["O"]
    assert got["CCO"]["two"] == pytest.approx(sorted([c + 3 * h, c + 2 * h, o + h, 2 * c + 5 * h, c + 3 * h + o, 2 * c + 6 * h + o]))
    assert got["CCO"]["one"] == pytest.approx(sorted([c + 3 * h, o + h, 2 * c + 5 * h, c + 3 * h + o, 2 * c + 6 * h + o]))
    assert got["C1CC1"]["one"] == pytest.approx([3 * c + 6 * h]) and len(got["C1CC1"]["two"]) == 3
    assert got[None]["two"] == [] and got["*C"]["two"] == [] and len(got["C" * 36]["two"]) == 1 and len(got["C" * 36]["wide"]) > 60
    for s in smiles:
        g = got[s]["g"]
        if s == "*C" or not g["bonds"] or len(g["bonds"]) > 34:
            continue
        w, bonds = [ATOMIC_MASS[a["symbol"]] + a["hydrogens"] * h for a in g["atoms"]], [(b["a"], b["b"]) for b in g["bonds"]]
        sets = {p for k in (0, 1, 2) for gone in itertools.combinations(range(len(bonds)), k) for p in sides(len(w), bonds, set(gone))}
        assert got[s]["two"] == pytest.approx(sorted({round(sum(w[i] for i in p), 9) for p in sets} | {round(sum(w), 9)}))
    with pytest.raises(ValueError):
        graphs.fragment_masses(F.col("g"), 3)


KEYS = ["ABCDEFGHIJKLMN", "BBCDEFGHIJKLMN", "CBCDEFGHIJKLMN", "DBCDEFGHIJKLMN", "EBCDEFGHIJKLMN", "FBCDEFGHIJKLMN", "GBCDEFGHIJKLMN"]


def test_imports_from_files(spark, tmp_path):
    """Each reader's file through the normaliser: every reason, and what is left of all three."""
    (tmp_path / "p.csv").write_text(
        "Identifier,FirstBlock,SMILES,MolecularFormula,MonoisotopicMass,AnnoTypeCount\n"
        + f"1,{KEYS[0]},CCO,C2H6O,46.0419,3\n2,{KEYS[1]},C(C,C2H6,30.0,1\n3,short,CCO,C2H6O,46.0419,1\n4,{KEYS[2]},CCO,C2H6O,46.06,1\n5,{KEYS[3]},CC,C2H6,,1\n6,{KEYS[4]},CC,C2H6,30.04,\n"
    )
    with gzip.open(tmp_path / "m.txt.gz", "wt") as f:
        f.write("chembl_id\tcanonical_smiles\tstandard_inchi_key\n")
        for i, (s, k) in enumerate([("CCN", KEYS[5]), ("C1C", KEYS[0]), ("CC.O", KEYS[0]), ("O=O", KEYS[0]), ("C[NH3+]", KEYS[0]), ("[13CH4]", KEYS[0]), ("*C", KEYS[0]), ("CC", "abc"), ("CCO", KEYS[0]), ("", KEYS[1])]):
            f.write(f"CH{i}\t{s}\t{k}-REST-N\n")
    with gzip.open(tmp_path / "b.tsv.gz", "wt") as f:
        f.write("compound_id\tstatus_id\tdefault_structure\tsmiles\tstandard_inchi_key\n")
        for i, (st, d, s, k) in enumerate([(1, "true", "CCCl", KEYS[6]), (2, "true", "CC", KEYS[0]), (3, "false", "CC", KEYS[0]), (3, "true", "CCBr", ""), (1, "true", "CC", "x"), (1, "true", "C[Na]", "")]):
            f.write(f"{i}\t{st}\t{d}\t{s}\t{k}\n")
    p = catalog.imported(readers.pubchem(spark, str(tmp_path / "p.csv"), every=True), "pubchemlite")
    m = catalog.imported(readers.chembl(spark, str(tmp_path / "m.txt.gz"), partitions=3, every=True), "chembl")
    b = catalog.imported(readers.chebi(spark, str(tmp_path / "b.tsv.gz"), every=True), "chebi")
    reasons = lambda df, i: [r["reason"] for r in df.orderBy(i).collect()]
    assert reasons(p, "pubchem_cid") == ["retained", "invalid", "identity_mismatch", "mass_disagreement", "invalid", "retained"]
    assert reasons(m, "chembl_id") == ["retained", "invalid", "mixture_or_nonorganic", "mixture_or_nonorganic", "charged_generic_or_isotopic", "charged_generic_or_isotopic", "charged_generic_or_isotopic", "identity_disagreement", "retained", "invalid"]
    assert reasons(b, "chebi_id") == ["retained", "not_reviewed_default", "not_reviewed_default", "retained", "identity_disagreement", "retained"]
    all_, counts = catalog.catalog_of([p, m, b])
    kept = {r["inchikey14"]: (r["origin"], r["formula"]) for r in all_.where("inchikey14 is not null and inchikey14 <> ''").collect()}
    assert kept[KEYS[0]] == ("pubchemlite", "C2H6O") and kept[KEYS[5]] == ("chembl", "C2H7N") and kept[KEYS[6]] == ("chebi", "C2H5Cl")
    assert sum(r["rows"] for r in counts.collect()) == 22
    wrong = catalog.imported(readers.chembl(spark, str(tmp_path / "m.txt.gz"), every=True), "chembl", computed_key=F.lit(KEYS[5]))
    assert reasons(wrong, "chembl_id")[0] == "retained" and reasons(wrong, "chembl_id")[8] == "identity_disagreement"
    assert readers.pubchem(spark, str(tmp_path / "p.csv")).count() == 5 and readers.chebi(spark, str(tmp_path / "b.tsv.gz")).count() == 4
    with pytest.raises(ValueError):
        catalog.imported(p, "elsewhere")


def test_indexes_from_one_scan(spark, tmp_path):
    """Two indexes as two semi-joins give them, at the bounds and where windows overlap; the rows are scanned once and written once."""
    random.seed(5)
    masses = [round(random.uniform(100, 103), 4) for _ in range(600)] + [100.0, 200.0, 200.0 * (1 + 35e-6), 200.0 * (1 - 35e-6), 200.01]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(masses)] + [(9000, None), (9001, float("nan"))], "key int, mass double")
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    targets = [("legacy", round(random.uniform(100, 103), 4)) for _ in range(40)] + [("union", round(random.uniform(99, 104), 4)) for _ in range(300)] + [("union", 200.0), ("legacy", 200.007), ("union", None), ("union", -5.0), ("legacy", 99.9999)]
    t = spark.createDataFrame(targets, "index string, center double")
    got = {(r["index"], r["key"]) for r in stores.tagged(rows, t).collect()}
    assert got == {(n, i) for i, m in enumerate(masses) for n, c in targets if c is not None and c > 0 and abs(m - c) <= m * 35e-6}
    assert stores.tagged(rows, t).count() == len(got)
    plan = stores.tagged(rows, t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    stores.write_indexes(rows, t, f"{tmp_path}/out")
    for n in ("legacy", "union"):
        one = stores.read_index(spark, f"{tmp_path}/out", n)
        assert sorted(r["key"] for r in one.collect()) == sorted(k for i, k in got if i == n)
        assert "PartitionFilters: [isnotnull(index" in one._jdf.queryExecution().executedPlan().toString()


def test_store_is_not_exchanged(spark, tmp_path):
    """A window join over the store as over a table, with an exchange of the centers alone; the store is made once and asked twice."""
    random.seed(7)
    rows = spark.createDataFrame([(i, round(random.uniform(90, 130), 4), [float(i)]) for i in range(4000)] + [(-1, None, []), (-2, float("inf"), [])], "ref int, mass double, w array<double>")
    stores.write_store(rows, "ionsift_test_store", f"file://{tmp_path}/store", buckets=8)
    for n in (30, 200):
        centers = spark.createDataFrame([(i, round(random.uniform(89, 131), 4)) for i in range(n)] + [(-1, None)], "grp int, center double")
        joined = stores.store_window(centers, "ionsift_test_store")
        want = range_join.mass_window(centers, rows.where("ref >= 0"))
        assert sorted((r["grp"], r["ref"]) for r in joined.collect()) == sorted((r["grp"], r["ref"]) for r in want.collect())
        plan = joined._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[-1]
        assert final.count("Exchange") == 1 and "Bucketed: true" in final
    spark.sql("drop table ionsift_test_store")


def opened_by(spark, folder, low, high):
    """The partitions that a window is read by."""
    reader = blobs.MassBlobs(options={"path": folder, "low": str(low), "high": str(high)}).reader(None)
    return [p for p in reader.partitions() if p.name]


def test_blobs(spark, tmp_path):
    """Windows at bounds, between rows, across files and outside; ties, empty, long and odd strings; blocks of one row and of many."""
    random.seed(11)
    words = ["", "a", "é", "日本", "x" * 5000, "two words", "\n"]
    rows = [(round(random.uniform(0, 50), 1), random.choice(words)) for _ in range(900)] + [(25.0, "tie")] * 40 + [(None, "lost"), (float("nan"), "lost"), (3.0, None), (float("inf"), "lost")]
    df = spark.createDataFrame(rows, "mass double, smiles string").repartition(5)
    fine = [(m, s) for m, s in rows if m is not None and m == m and m < 1e9 and s is not None]
    for block, parts in ((1, 3), (16, 4), (4096, 1)):
        at = f"file://{tmp_path}/b{block}"
        assert blobs.write(df, at, "smiles", partitions=parts, block=block) == len(fine)
        assert sorted(tuple(r) for r in blobs.read(spark, at).collect()) == sorted(fine)
        for low, high in ((10.0, 12.5), (25.0, 25.0), (24.95, 25.04), (-5, 0.3), (49.9, 99.0), (60, 70), (12, 11), (0, 50)):
            got = blobs.window(spark, at, low, high)
            assert sorted(tuple(r) for r in got.collect()) == sorted(p for p in fine if low <= p[0] <= high)
        assert sorted(tuple(r) for r in blobs.read(spark, at).where("mass > 25 and mass < 26 and value <> 'a'").collect()) == sorted(p for p in fine if 25 < p[0] < 26 and p[1] != "a")
    few, all_ = opened_by(spark, f"file://{tmp_path}/b16", 10.0, 11.0), opened_by(spark, f"file://{tmp_path}/b16", -1e9, 1e9)
    blocks = lambda ps: sum(p.last - p.first for p in ps)
    inside = sum(10 <= m <= 11 for m, _ in fine)
    assert len({p.name for p in few}) == 1 and blocks(few) <= inside // 16 + 3 and blocks(all_) >= len(fine) // 16 and not opened_by(spark, f"file://{tmp_path}/b16", 60, 70)
    plan = blobs.window(spark, f"file://{tmp_path}/b16", 10.0, 11.0)._jdf.queryExecution().executedPlan().toString()
    assert "mass_blobs" in plan
    none = f"file://{tmp_path}/none"
    assert blobs.write(df.limit(0), none, "smiles") == 0 and blobs.read(spark, none).count() == 0
