"""Formulas, adducts and masses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Monoisotopic masses, the proton, water, the electron, and the shifts of ten adducts.
ATOMIC_MASS = {
    "H": 1.00782503223, "C": 12.0, "N": 14.00307400443, "O": 15.99491461957, "P": 30.97376199842, "S": 31.9720711744, "F": 18.99840316273,
    "Cl": 34.968852682, "Br": 78.9183376, "I": 126.904468, "Si": 27.97692653465, "B": 11.00930536, "Na": 22.9897692820, "K": 38.9637064864,
}
PROTON = 1.007276466621
WATER = 18.01056468403
ELECTRON = 0.000548579909
ADDUCT_MASS = {
    "[M+H]+": PROTON, "[M+NH4]+": 18.033825553, "[M-H2O+H]+": PROTON - WATER, "[M-2H2O+H]+": PROTON - 2 * WATER, "[M+Na]+": 22.989218, "[M+K]+": 38.963158,
    "[M-H]-": -PROTON, "[M-H2O-H]-": -WATER - PROTON, "[M+CH2O2-H]-": 46.005479303 - PROTON, "[M+Cl]-": 34.969402,
}
# The ions of a second table, each with its molecules, charge, atoms added and taken, protons, and electrons added.
IONS = {
    "[M+H]+": (1, 1, "", "", 1, 0), "[M+NH4]+": (1, 1, "NH4", "", 0, -1), "[M+Na]+": (1, 1, "Na", "", 0, -1), "[M+K]+": (1, 1, "K", "", 0, -1), "[M-H2O+H]+": (1, 1, "", "H2O", 1, 0),
    "[M-2H2O+H]+": (1, 1, "", "H4O2", 1, 0), "[M+2H]2+": (1, 2, "", "", 2, 0), "[M]+": (1, 1, "", "", 0, -1), "[M-H2O]+": (1, 1, "", "H2O", 0, -1), "[M+CH3OH+H]+": (1, 1, "CH4O", "", 1, 0),
    "[M+CH3CN+H]+": (1, 1, "C2H3N", "", 1, 0), "[M-H]-": (1, 1, "", "", -1, 0), "[M-H2O-H]-": (1, 1, "", "H2O", -1, 0), "[M+CH2O2-H]-": (1, 1, "CH2O2", "", -1, 0), "[M+C2H4O2-H]-": (1, 1, "C2H4O2", "", -1, 0),
    "[M+Cl]-": (1, 1, "Cl", "", 0, 1), "[M]-": (1, 1, "", "", 0, 1), "[M-2H]-": (1, 2, "", "", -2, 0), "[M+Na-2H]-": (1, 1, "Na", "", -2, 0), "[2M+H]+": (2, 1, "", "", 1, 0), "[2M+Na]+": (2, 1, "Na", "", 0, -1),
    "[2M+NH4]+": (2, 1, "NH4", "", 0, -1), "[2M+K]+": (2, 1, "K", "", 0, -1), "[2M-H]-": (2, 1, "", "", -1, 0), "[2M+CH2O2-H]-": (2, 1, "CH2O2", "", -1, 0), "[2M+C2H4O2-H]-": (2, 1, "C2H4O2", "", -1, 0),
    "[2M+Na-2H]-": (2, 1, "Na", "", -2, 0), "[3M+H]+": (3, 1, "", "", 1, 0), "[3M-H]-": (3, 1, "", "", -1, 0),
}
FORMULA = "([A-Z][a-z]?)([0-9]*)"
ADDUCT = r"^\[([0-9]*)M((?:[+-][A-Za-z0-9]+)*)\]([0-9]*)([+-])$"


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _count(digits: Column) -> Column:
    return F.when(digits == "", F.lit(1.0)).otherwise(digits.cast("double"))


def formula_mass(formula: Column) -> Column:
    """Monoisotopic mass of a formula like C6H12O6; null if it doesn't parse wholly or has an unknown element."""
    names, counts = F.regexp_extract_all(formula, F.lit(FORMULA), F.lit(1)), F.regexp_extract_all(formula, F.lit(FORMULA), F.lit(2))
    known = literal_map(ATOMIC_MASS)
    parts = F.zip_with(names, counts, lambda n, c: F.try_element_at(known, n) * _count(c))
    return F.when(formula.rlike(f"^({FORMULA})+$"), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def ion_formula_mass(formula: Column) -> Column:
    """formula_mass() after a charge sign at the end is taken off."""
    return formula_mass(F.regexp_replace(formula, "[+-]$", ""))


#: The elements of count vectors, in the order of hydrogen-last formulas: carbon, hydrogen, then by letter.
HILL = ["C", "H", "B", "Br", "Cl", "F", "I", "K", "N", "Na", "O", "P", "S", "Si"]


def formula_counts(formula: Column, most: int = 256) -> Column:
    """How often each element of HILL occurs; null if the formula doesn't parse or a count exceeds ``most``."""
    names, counts = F.regexp_extract_all(formula, F.lit(FORMULA), F.lit(1)), F.regexp_extract_all(formula, F.lit(FORMULA), F.lit(2))
    pairs = F.arrays_zip(names.alias("e"), counts.alias("c"))
    of = lambda e: F.aggregate(F.filter(pairs, lambda p: p["e"] == e), F.lit(0), lambda s, p: s + _count(p["c"]).cast("int"))
    vector = F.array(*[of(e) for e in HILL])
    fine = formula_mass(formula).isNotNull() & (F.array_max(vector) <= most)
    return F.when(fine, vector)


def count_formula(counts: Column) -> Column:
    """The formula of a count vector; elements that occur once have no number."""
    parts = [F.when(counts[i] > 1, F.concat(F.lit(e), counts[i].cast("string"))).when(counts[i] == 1, F.lit(e)).otherwise("") for i, e in enumerate(HILL)]
    return F.concat(*parts)


def parse_adduct(adduct: Column) -> Column:
    """Struct (molecules, charge, shift) of [nM+X-Y]z+; null if it doesn't parse, has an unknown element, no molecule, or a charge beyond 8.

    The shift is the added less the removed atoms' mass, corrected for the
    electrons of the charge.
    """
    number = lambda i: F.when(F.regexp_extract(adduct, ADDUCT, i) == "", F.lit(1)).otherwise(F.regexp_extract(adduct, ADDUCT, i).try_cast("int"))
    charge = number(3) * F.when(F.regexp_extract(adduct, ADDUCT, 4) == "+", 1).otherwise(-1)
    part = r"([+-])([0-9]*)([A-Za-z][A-Za-z0-9]*)"
    terms = F.regexp_extract(adduct, ADDUCT, 2)
    get = lambda i: F.regexp_extract_all(terms, F.lit(part), F.lit(i))
    weighed = F.zip_with(F.zip_with(get(1), get(2), lambda s, n: F.when(s == "+", 1.0).otherwise(-1.0) * _count(n)), get(3), lambda k, f: k * formula_mass(f))
    shift = F.aggregate(weighed, -charge * F.lit(ELECTRON), lambda s, x: s + x)
    fine = adduct.rlike(ADDUCT) & (number(1) >= 1) & F.abs(charge).between(1, 8) & shift.isNotNull()
    return F.when(fine, F.struct(number(1).alias("molecules"), charge.cast("int").alias("charge"), shift.alias("shift")))


def finite_positive(x: Column) -> Column:
    return F.when(~F.isnan(x) & (x > 0) & (x < float("inf")), x)


def ion_neutral_mass(ion: Column, mz: Column) -> Column:
    """(|charge| * mz - shift) / molecules, where finite and positive; else null."""
    return finite_positive((F.abs(ion["charge"]) * mz - ion["shift"]) / ion["molecules"])


def neutral_mass(adduct: Column, mz: Column) -> Column:
    """By the parsed adduct."""
    return ion_neutral_mass(parse_adduct(adduct), mz)


def table_neutral_mass(adduct: Column, mz: Column) -> Column:
    """By the table of ten adducts; null for others and for what isn't finite."""
    x = mz - F.try_element_at(literal_map(ADDUCT_MASS), adduct)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ion_table_mass(adduct: Column, mz: Column) -> Column:
    """(charge * mz - shift) / molecules by the table IONS, where finite and positive; null for other adducts."""
    part = lambda i: F.try_element_at(literal_map({name: row[i] for name, row in IONS.items()}), adduct)
    weight = lambda i: F.when(part(i) == "", F.lit(0.0)).otherwise(formula_mass(part(i)))
    shift = weight(2) - weight(3) + part(4) * F.lit(PROTON) + part(5) * F.lit(ELECTRON)
    return finite_positive((part(1) * mz - shift) / part(0))


def ppm_error(mass: Column, center: Column) -> Column:
    return F.abs(mass - center) / center * 1e6


def ppm_penalty(mass: Column, center: Column, width: float = 15.0) -> Column:
    """exp(-(ppm / width)**2 / 2)."""
    return F.exp(-0.5 * F.pow(ppm_error(mass, center) / width, F.lit(2.0)))


def mass_tolerance(center: Column, ppm: float = 35.0, floor: float = 0.006) -> Column:
    return F.greatest(center * (ppm * 1e-6), F.lit(floor))


def ppm_fine(error: Column, most: float = 30.0) -> Column:
    """Whether a recorded mass error is missing or within bounds."""
    return error.isNull() | (F.abs(error) <= most)


# The names that a fragment engine knows adducts by.
ENGINE_ALIASES = {
    "[M+H]+": "[M+H]+", "[M-H]-": "[M-H]-", "[M+Na]+": "[M+Na]+", "[M+K]+": "[M+K]+", "[M+NH4]+": "[M+NH4]+", "[M+Cl]-": "[M+Cl]-", "[M+CH2O2-H]-": "[M+HCOO]-", "[M+C2H4O2-H]-": "[M+CH3COO]-", "[M+CH3OH+H]+": "[M+CH3OH+H]+",
}


def engine_alias(adduct: Column) -> Column:
    """The engine's name of an adduct, null for those it doesn't know; the query fails if the two names differ in composition."""
    alias = F.try_element_at(literal_map(ENGINE_ALIASES), adduct)
    ion, own = parse_adduct(adduct), parse_adduct(alias)
    same = (ion["molecules"] == own["molecules"]) & (ion["charge"] == own["charge"]) & (F.abs(ion["shift"] - own["shift"]) < 1e-9)
    return F.when(alias.isNull() | same, alias).otherwise(F.raise_error(F.lit("an alias changes the ion")).cast("string"))
