"""Table schemas and contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(**kinds: str) -> T.StructType:
    of = {"s": T.StringType(), "d": T.DoubleType(), "l": T.LongType(), "i": T.IntegerType(), "b": T.BooleanType(), "ad": T.ArrayType(T.DoubleType()), "as": T.ArrayType(T.StringType()), "bin": T.BinaryType()}
    return T.StructType([T.StructField(k, of[v]) for k, v in kinds.items()])


LIBRARY = _struct(inchikey14="s", normalized_smiles="s", ingest_lib="s", molecular_formula="s", ms2_mzs="ad", ms2_normalized_intensities="ad", precursor_mz="d", adduct="s", ionization_mode="s", instrument_type="s", collision_energy_ev="ad", precursor_error_ppm="d")
QUERY = _struct(molecule_id="s", spectrum_id="s", precursor_mz="d", adduct="s", ionization_mode="s", instrument_type="s", collision_energy_ev="ad", ms2_mzs="ad", ms2_normalized_intensities="ad")
CATALOG = _struct(inchikey14="s", normalized_smiles="s", mass="d", origin="s")
COCONUT = _struct(inchikey="s", canonical_smiles="s", exact_mass="d")
PUBCHEM = _struct(Identifier="l", FirstBlock="s", SMILES="s", MolecularFormula="s", MonoisotopicMass="d", AnnoTypeCount="i")
CHEMBL = _struct(chembl_id="s", canonical_smiles="s", standard_inchi_key="s")
CHEBI = _struct(compound_id="l", status_id="i", default_structure="s", smiles="s", standard_inchi_key="s")
SUBMISSION = _struct(molecule_id="s", smiles="s")
#: What a table of queries must not hold.
LABELS = ("inchikey14", "normalized_smiles", "molecular_formula", "fingerprint")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The table, if it has all these columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def forbid(df: DataFrame, columns: tuple[str, ...] = LABELS) -> DataFrame:
    """The table, if it has none of these columns, in any case of letters."""
    found = sorted({c.lower() for c in df.columns} & {c.lower() for c in columns})
    if found:
        raise ValueError(f"label columns in a table of queries: {', '.join(found)}")
    return df


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of keys that occur more than once: key columns and ``rows``.  Empty if the keys are unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def same_lengths(a: Column, b: Column) -> Column:
    """True where two arrays have one length; null arrays count as empty."""
    size = lambda x: F.coalesce(F.size(x), F.lit(0))
    return size(a) == size(b)


def checked(condition: Column, value: Column, message: str) -> Column:
    """The value where the condition holds; elsewhere the query fails with the message."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def confidence(value: Column) -> Column:
    """A confidence within 1e-6 of [0, 1], clipped to it; the query fails on others."""
    fine = value.isNotNull() & ~F.isnan(value) & (value >= -1e-6) & (value <= 1 + 1e-6)
    return checked(fine, F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), "confidence outside [0, 1]")


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: key, side ('left' or 'right')."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left")).union(right.join(left, key, "left_anti").withColumn("side", F.lit("right")))
