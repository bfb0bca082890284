"""Sources: spectra, catalogs, rankings, events; projected, filtered and with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.mass import formula_mass, ppm_fine
from ..functions.peaks import usable
from ..functions.text import identity_key
from ..operators.range_join import near_any


def library(spark: SparkSession, path: str, columns: list[str] | None = None, excluded_source: str | None = None, source: str | None = None) -> DataFrame:
    """The spectral library's columns; a source may be excluded or chosen, which reaches the scan."""
    df = schema.require(spark.read.parquet(path), "inchikey14", "normalized_smiles", "molecular_formula", "ms2_mzs", "ms2_normalized_intensities")
    if excluded_source is not None:
        df = df.where(~F.col("ingest_lib").eqNullSafe(excluded_source))
    if source is not None:
        df = df.where(F.col("ingest_lib") == source)
    return df.select(*columns) if columns else df


def near_targets(rows: DataFrame, targets: DataFrame, ppm: float = 35.0, floor: float = 0.0) -> DataFrame:
    """Library rows with a formula mass near a target, a key, a structure, usable peaks and a fine mass error; with ``mass``."""
    fine = (
        F.col("inchikey14").isNotNull() & (F.col("inchikey14") != "") & F.col("normalized_smiles").isNotNull() & (F.col("normalized_smiles") != "")
        & ppm_fine(F.col("precursor_error_ppm")) & usable(F.col("ms2_mzs"), F.col("ms2_normalized_intensities"))
    )
    return near_any(rows.withColumn("mass", formula_mass(F.col("molecular_formula"))).where(F.col("mass").isNotNull() & fine), targets, "mass", "center", ppm, floor)


def observed_keys(rows: DataFrame, targets: DataFrame, ppm: float = 35.0) -> DataFrame:
    """The distinct keys of near_targets(), without vectors."""
    return near_targets(rows, targets, ppm, 0.006).select("inchikey14").distinct()


def mass_or_precursor(rows: DataFrame) -> DataFrame:
    """``mass``: by the formula, or the precursor where that has none."""
    return rows.withColumn("mass", F.coalesce(formula_mass(F.col("molecular_formula")), F.when(~F.isnan("precursor_mz"), F.col("precursor_mz"))))


def queries(spark: SparkSession, path: str) -> DataFrame:
    """Query spectra, refused if they hold labels."""
    return schema.require(schema.forbid(spark.read.parquet(path)), "molecule_id", "precursor_mz", "adduct", "ms2_mzs", "ms2_normalized_intensities")


def coconut(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.COCONUT).parquet(path)


def pubchem(spark: SparkSession, path: str, every: bool = False) -> DataFrame:
    """A CSV catalog as inchikey14, normalized_smiles, mass, origin, pubchem_cid, annotation_count; rows without key, structure or positive mass go, unless ``every`` row is wanted, as by catalog.imported()."""
    df = spark.read.schema(schema.PUBCHEM).option("header", True).csv(path)
    out = df.select(F.col("FirstBlock").alias("inchikey14"), F.col("SMILES").alias("normalized_smiles"), F.col("MonoisotopicMass").alias("mass"), F.lit("pubchemlite").alias("origin"), F.col("Identifier").alias("pubchem_cid"), F.col("AnnoTypeCount").alias("annotation_count"))
    return out if every else out.where("inchikey14 is not null and normalized_smiles is not null and mass > 0")


def chembl(spark: SparkSession, path: str, partitions: int | None = None, every: bool = False) -> DataFrame:
    """A TSV, gzipped or not, as inchikey14, normalized_smiles, chembl_id, origin.  A gzip file is read by one task, so it is dealt out after."""
    df = spark.read.schema(schema.CHEMBL).option("header", True).option("sep", "\t").csv(path)
    out = df.select(identity_key(F.col("standard_inchi_key")).alias("inchikey14"), F.col("canonical_smiles").alias("normalized_smiles"), "chembl_id", F.lit("chembl").alias("origin"))
    out = out if every else out.where("inchikey14 is not null and normalized_smiles is not null")
    return out.repartition(partitions) if partitions else out


def chebi(spark: SparkSession, path: str, every: bool = False) -> DataFrame:
    """The same of compounds with status 1 or 3 and their default structures; of all compounds, with ``reviewed``, if ``every`` row is wanted."""
    df = spark.read.schema(schema.CHEBI).option("header", True).option("sep", "\t").csv(path)
    fine = F.col("status_id").isin(1, 3) & (F.lower("default_structure") == "true")
    out = df.select(identity_key(F.col("standard_inchi_key")).alias("inchikey14"), F.col("smiles").alias("normalized_smiles"), F.col("compound_id").alias("chebi_id"), F.lit("chebi").alias("origin"), F.coalesce(fine, F.lit(False)).alias("reviewed"))
    return out if every else out.where("reviewed").drop("reviewed")


def records(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """JSON records, one a line or one document a file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(kind) if kind else reader).json(path)


def routing(spark: SparkSession, path: str, ids: DataFrame, key: str = "molecule_id") -> DataFrame:
    """A CSV of routing decisions, refused unless its ids are unique and exactly the expected ones."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if schema.unique(df, key).limit(1).count() or schema.symmetric_difference(df, ids, key).limit(1).count():
        raise ValueError("routing ids are repeated, missing or unexpected")
    return df


def located(spark: SparkSession, path: str) -> str:
    """The one path a glob matches; none or several raise an error.  Through the cluster's file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} matches of {path}, not one")
    return found[0].getPath().toString()


def windowed(spark: SparkSession, path: str, low: float, high: float, column: str = "mass") -> DataFrame:
    """Rows of a table sorted by mass within a window: the bounds are pushed down to the row groups' statistics."""
    return spark.read.parquet(path).where(F.col(column).between(low, high))
