"""Structures made from parts: chains of carbon that end in one of ten groups, and the ways in which a catalog's rows go wrong; reference indexes, stores and blobs over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import graphs, mass
from ..functions.text import smiles_tokens, token_kind
from ..lineage import new_folder
from ..operators import catalog
from ..sources import blobs, stores
from .registry import Tables, query

# What a chain may end in, and the formula of a chain of one carbon with that end.
ENDS = [("O", "CH4O"), ("c1ccccc1", "C7H8"), ("N", "CH5N"), ("C(=O)O", "C2H4O2"), ("C1CC1", "C4H8"), ("Cl", "CH3Cl"), ("S(=O)(=O)C", "C2H6O2S"), ("C#N", "C2H3N"), ("C(C)(C)Br", "C4H9Br"), ("c1ccc2ccccc2c1", "C11H10")]
# What goes wrong for every so-many-th part: the structure's beginning and end, and the rows' own faults.
FAULTS = {3: ("", ".O"), 5: ("[13CH3]", ""), 7: ("[NH3+]", ""), 11: ("*", ""), 13: ("C(", ""), 17: ("C1", "")}
K = "p_partkey"


def _formula_mass(formula: str) -> float:
    import re

    return sum(mass.ATOMIC_MASS[e] * int(n or 1) for e, n in re.findall("([A-Z][a-z]?)([0-9]*)", formula))


CH2 = mass.ATOMIC_MASS["C"] + 2 * mass.ATOMIC_MASS["H"]
ENDS_SQL = ", ".join(f"({i}, {_formula_mass(f)!r}::double)" for i, (_, f) in enumerate(ENDS))
#: A row's fault: the first number of FAULTS (or 19, no structure; 23, oxygen alone) by which the key divides with a rest of one; 0 for none.
FAULT_SQL = f"case {' '.join(f'when p_partkey % {n} = 1 then {n}' for n in (*FAULTS, 19, 23))} else 0 end"
STRUCTURES = f"""ends(e, m) as (values {ENDS_SQL}), st as (select p_partkey as k, {FAULT_SQL} as fault, m + (p_partkey // 10 % 9) * {CH2!r}::double as mass, p_partkey % 31 = 2 as bad_key, p_partkey % 37 = 3 as off, p_partkey % 41 = 4 as unseen, p_partkey // 10 % 9 as extra, p_partkey % 10 as e from part join ends on e = p_partkey % 10)"""


def structures(t: Tables) -> DataFrame:
    """k, smiles, key and what is wrong with a row."""
    k = F.col(K)
    fault = F.lit(0)
    for n in reversed((*FAULTS, 19, 23)):
        fault = F.when(k % n == 1, n).otherwise(fault)
    end = F.get(F.array(*[F.lit(s) for s, _ in ENDS]), (k % 10).cast("int"))
    extra = (F.floor(k / 10) % 9).cast("int")
    rows = t.part.select(k.alias("k"), fault.alias("fault"), F.concat(F.lit("C"), F.repeat(F.lit("C"), extra), end).alias("plain"), (k % 31 == 2).alias("bad_key"), (k % 37 == 3).alias("off"), (k % 41 == 4).alias("unseen"))
    smiles = F.col("plain")
    for n, (before, after) in FAULTS.items():
        smiles = F.when(F.col("fault") == n, F.concat(F.lit(before), F.col("plain"), F.lit(after))).otherwise(smiles)
    smiles = F.when(F.col("fault") == 19, "").when(F.col("fault") == 23, "O=O").otherwise(smiles)
    letters = F.translate(F.lpad(F.col("k").cast("string"), 14, "0"), "0123456789", "ABCDEFGHIJ")
    return rows.withColumn("smiles", smiles).withColumn("key", F.when(F.col("bad_key"), F.lower(letters)).otherwise(letters))


def imports(t: Tables) -> list[DataFrame]:
    """The same structures as three readers would give them."""
    s = structures(t).withColumn("g", graphs.graph(F.col("plain")))
    base = lambda origin: [F.col("key").alias("inchikey14"), F.col("smiles").alias("normalized_smiles"), F.lit(origin).alias("origin"), "k"]
    computed = graphs.composition(F.col("g"))["mass"]
    declared = F.when(F.col("k") % 43 == 5, None).otherwise(computed + F.when(F.col("off"), 0.5).otherwise(0.004))
    pubchem = s.select(*base("pubchemlite"), declared.alias("mass"))
    chebi = s.select(F.when(F.col("k") % 47 == 6, "").otherwise(F.col("key")).alias("inchikey14"), *base("chebi")[1:], (~F.col("unseen")).alias("reviewed"))
    return [catalog.imported(pubchem, "pubchemlite"), catalog.imported(s.select(*base("chembl")), "chembl"), catalog.imported(chebi, "chebi")]


INVALID = "fault in (13, 17, 19)"
REASONS = f"""{STRUCTURES}, rs as (
    select k, mass, 'pubchemlite' as origin, case when {INVALID} or k % 43 = 5 then 'invalid' when bad_key then 'identity_mismatch' when fault = 11 or fault in (3, 5, 7, 23) or off then 'mass_disagreement' else 'retained' end as reason from st
    union all select k, mass, 'chembl', case when {INVALID} then 'invalid' when fault in (3, 23) then 'mixture_or_nonorganic' when fault in (5, 7, 11) then 'charged_generic_or_isotopic' when bad_key then 'identity_disagreement' else 'retained' end from st
    union all select k, mass, 'chebi', case when unseen then 'not_reviewed_default' when {INVALID} then 'invalid' when fault in (3, 23) then 'mixture_or_nonorganic' when fault in (5, 7, 11) then 'charged_generic_or_isotopic' when bad_key and k % 47 <> 6 then 'identity_disagreement' else 'retained' end from st)"""


@query(f"with {REASONS} select origin, reason, count(*) as rows from rs group by 1, 2")
def catalog_import(t: Tables) -> DataFrame:
    """Three catalogs through the native normaliser: rows by origin and reason."""
    return catalog.catalog_of(imports(t))[1]


@query(f"with {REASONS}, u as (select k, mass, origin, row_number() over (partition by k order by case origin when 'pubchemlite' then 0 when 'chembl' then 1 else 2 end) as i from rs where reason = 'retained' and not (origin = 'chebi' and k % 47 = 6)) select k, origin, round(mass, 6) as mass from u where i = 1")
def catalog_imported(t: Tables) -> DataFrame:
    """What the three retain, each structure once, with its computed mass."""
    kept = catalog.catalog_of([i.where("inchikey14 <> ''") for i in imports(t)])[0]
    k = F.translate("inchikey14", "ABCDEFGHIJ", "0123456789").cast("long")
    return kept.select(k.alias("k"), "origin", F.round("mass", 6).alias("mass"))


def whole(t: Tables) -> DataFrame:
    """The structures without a fault: k, smiles, mass by the graph."""
    own = structures(t).where("fault = 0").select("k", "smiles").withColumn("g", graphs.graph(F.col("smiles")))
    return own.select("k", "smiles", "g", graphs.composition(F.col("g"))["mass"].alias("mass"))


@query()
def structure_fragments(t: Tables) -> DataFrame:
    """The masses of each structure's fragments; the tests hold them against removing all pairs of bonds one after the other."""
    f = whole(t).select("k", F.size("g.bonds").alias("bonds"), graphs.fragment_masses(F.col("g")).alias("f"))
    return f.select("k", "bonds", F.size("f").alias("fragments"), F.round(F.array_min("f"), 6).alias("smallest"), F.round(F.aggregate("f", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(
    f"""with {STRUCTURES}, ty(e, atoms, rings, bonds, branches) as (values (0, 1, 0, 0, 0), (1, 6, 2, 0, 0), (2, 1, 0, 0, 0), (3, 3, 0, 1, 2), (4, 3, 2, 0, 0), (5, 1, 0, 0, 0), (6, 4, 0, 2, 4), (7, 2, 0, 1, 0), (8, 4, 0, 0, 4), (9, 10, 4, 0, 0))
    select k, 1 + extra + atoms as atoms, rings, bonds, branches from st join ty using (e) where fault = 0"""
)
def structure_tokens(t: Tables) -> DataFrame:
    """Tokens of every structure by kind."""
    kinds = F.transform(smiles_tokens(F.col("smiles")), token_kind)
    n = lambda kind: F.size(F.filter(kinds, lambda x: x == kind)).alias({"atom": "atoms", "ring": "rings", "bond": "bonds", "branch": "branches"}[kind])
    return structures(t).where("fault = 0").select("k", *[n(kind) for kind in ("atom", "ring", "bond", "branch")])


@query(
    """with p as (select p_partkey as key, p_retailprice as mass from part), a as (select 'legacy' as index, round(900 + abs(s_acctbal) % 100, 4) as c from supplier union select 'union', round(900 + abs(s_acctbal) % 100, 4) from supplier union select 'union', round(900 + abs(c_acctbal) % 1100, 4) from customer)
    select distinct index, key from p join a on abs(mass - c) <= mass * 35e-6"""
)
def reference_indexes(t: Tables) -> DataFrame:
    """Two indexes of the parts from one scan: near suppliers, and near suppliers or customers."""
    s = t.supplier.select(F.round(900 + F.abs("s_acctbal") % 100, 4).alias("center"))
    c = t.customer.select(F.round(900 + F.abs("c_acctbal") % 1100, 4).alias("center"))
    targets = s.select(F.lit("legacy").alias("index"), "center").union(s.select(F.lit("union"), "center")).union(c.select(F.lit("union"), "center"))
    rows = t.part.select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("mass"))
    return stores.tagged(rows, targets).select("index", "key")


@query("select s_suppkey as grp, p_partkey as key, round(p_retailprice, 4) as mass from (select s_suppkey, round(900 + abs(s_acctbal) % 1000, 4) as c from supplier) join part on abs(p_retailprice - c) <= greatest(c * 35e-6, 0.006)")
def store_window(t: Tables) -> DataFrame:
    """A window join over a store bucketed by mass, made in the shared folder."""
    at = new_folder(t.spark, "store")
    name = at.rsplit("/", 1)[1].replace("-", "_")
    stores.write_store(t.part.select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("mass")), name, at, buckets=16)
    centers = t.supplier.select(F.col("s_suppkey").alias("grp"), F.round(900 + F.abs("s_acctbal") % 1000, 4).alias("center"))
    return stores.store_window(centers, name).select("grp", "key", F.round("mass", 4).alias("mass"))


@query("select round(p_retailprice, 4) as mass, p_name as value from part where p_retailprice between 905.25 and 940.5 and p_name is not null")
def blob_window(t: Tables) -> DataFrame:
    """Names of the parts in a window of price, from byte blobs written in the shared folder."""
    at = new_folder(t.spark, "blobs")
    blobs.write(t.part, at, "p_name", "p_retailprice", block=256)
    return blobs.window(t.spark, at, 905.25, 940.5).select(F.round("mass", 4).alias("mass"), "value")


# How every eighth of the parts' structures is charged: what goes before and after them, and what becomes of it.
CHARGED = [
    ("", "", "net_neutral"), ("[NH3+]", "", "retained"), ("[NH3+]", ".O", "mixture_or_nonorganic"), ("[15NH3+]", "", "generic_or_isotopic"), ("C(", "", "invalid"), ("[NH2+]" * 9, "", "charge_out_of_supported_range"),
    ("[NH3+]", "", "identity_disagreement"), ("[O-]", "", "retained"),
]
N_MASS, H_MASS, O_MASS, E_MASS = mass.ATOMIC_MASS["N"], mass.ATOMIC_MASS["H"], mass.ATOMIC_MASS["O"], mass.ELECTRON


@query(
    f"""with {STRUCTURES}, ways(w, reason) as (values {', '.join(f"({i}, '{r}')" for i, (_, _, r) in enumerate(CHARGED))})
    select k, reason, case when reason = 'retained' then round(mass + case w when 1 then {N_MASS + 2 * H_MASS - E_MASS!r}::double else {O_MASS - H_MASS + E_MASS!r}::double end, 6) end as mass, case when reason = 'retained' then case w when 1 then 1 else -1 end end as formal_charge
    from st join ways on w = k % 8"""
)
def charged_catalog(t: Tables) -> DataFrame:
    """Structures charged in eight ways through the normaliser of charged ones."""
    way = (F.col("k") % 8).cast("int")
    piece = lambda i: F.get(F.array(*[F.lit(c[i]) for c in CHARGED]), way)
    letters = F.translate(F.lpad(F.col("k").cast("string"), 14, "0"), "0123456789", "ABCDEFGHIJ")
    rows = structures(t).select("k", F.concat(piece(0), F.col("plain"), piece(1)).alias("normalized_smiles"), F.when(piece(2) == "identity_disagreement", F.lower(letters)).otherwise(letters).alias("inchikey14"))
    out, kept = catalog.charged_imported(rows), F.col("reason") == "retained"
    return out.select("k", "reason", F.when(kept, F.round("mass", 6)).alias("mass"), F.when(kept, F.col("formal_charge")).alias("formal_charge"))


def _heavy(formula: str) -> float:
    import re

    return _formula_mass("".join(e + n for e, n in re.findall("([A-Z][a-z]?)([0-9]*)", formula) if e != "H"))


HEAVY_SQL = ", ".join(f"({i}, {_heavy(f)!r}::double)" for i, (_, f) in enumerate(ENDS))


@query(
    f"""with {STRUCTURES}, heavy(e, h) as (values {HEAVY_SQL})
    select k, round(h + extra * {mass.ATOMIC_MASS['C']!r}::double + case fault when 5 then {graphs.ISOTOPE_MASS['13C']!r}::double when 7 then {N_MASS!r}::double else 0 end, 6) as lower_bound from st join heavy using (e) where fault in (0, 5, 7, 11)"""
)
def token_masses(t: Tables) -> DataFrame:
    """The lower bound of each structure's mass by its tokens, also with isotopes, charges and wildcards."""
    masses = F.transform(smiles_tokens(F.col("smiles")), graphs.token_mass)
    return structures(t).where("fault in (0, 5, 7, 11)").select("k", F.round(F.aggregate(masses, F.lit(0.0), lambda s, x: s + x), 6).alias("lower_bound"))
