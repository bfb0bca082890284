"""Deterministic splits, samples and identities from hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(value: Column, prefix: str = "42:") -> Column:
    """The first 8 bytes of SHA-256 of prefix and value, as an unsigned number in decimal(20, 0)."""
    text = F.concat(F.lit(prefix), F.coalesce(value.cast("string"), F.lit("None")))
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def bucket(value: Column, buckets: int, prefix: str = "42:") -> Column:
    return (digest(value, prefix) % buckets).cast("int")


def split_of(key: Column, diagnostics: list[str] | None = None) -> Column:
    """'train', 'dev' or 'holdout' for 80, 10 and 10 of a hundred keys; 'diagnostic' for those listed."""
    b = bucket(key, 10000)
    out = F.when(b < 8000, "train").when(b < 9000, "dev").otherwise("holdout")
    return F.when(key.isin(diagnostics), "diagnostic").otherwise(out) if diagnostics else out


def fold_of(key: Column, folds: int = 5, prefix: str = "fold:") -> Column:
    return bucket(key, folds, prefix)


def pick_of(key: Column, size: Column, prefix: str = "single:") -> Column:
    """Which of a group's rows, from 0, a deterministic single pick takes."""
    return (digest(key, prefix) % size).cast("long")


def signature(*columns: Column) -> Column:
    """SHA-256 of the values' JSON: equal values, equal signatures."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def table_identity(df: DataFrame) -> DataFrame:
    """One row (rows, checksum) that is the same for the same bag of rows in any order."""
    cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"))
