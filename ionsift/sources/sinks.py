"""Sinks: submissions, reference tables, audits; and the checks before them."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import joined, parts
from ..lineage import settled
from ..operators.ranking import lists
from ..schema import symmetric_difference, unique


def submission(ranking: DataFrame, molecules: DataFrame, molecule: str = "molecule_id", value: str = "smiles", k: int = 25, default: str | None = None) -> DataFrame:
    """(molecule, values joined by ;) for every molecule: the first k of its ranking, or a default."""
    rows = lists(ranking, [molecule], value, k).select(molecule, joined(F.col("ranking")).alias(value))
    out = molecules.select(molecule).distinct().join(rows, molecule, "left")
    return out.withColumn(value, F.coalesce(value, F.lit(default))) if default is not None else out


def shared_submission(ranking: DataFrame, asked: DataFrame, molecules: DataFrame, molecule: str = "molecule_id", by: str = "center", value: str = "smiles", k: int = 25, default: str | None = None) -> DataFrame:
    """submission() of rankings (by, value, rank) that molecules share: asked (molecule, by) says whose is which, a row for a molecule.

    Values are joined once for each ranking, so that what is exchanged of a
    molecule is its id and what it asks for.
    """
    rows = lists(ranking, [by], value, k).select(by, joined(F.col("ranking")).alias(value))
    out = molecules.select(molecule).distinct().join(asked.select(molecule, by), molecule, "left").join(rows, by, "left").select(molecule, value)
    return out.withColumn(value, F.coalesce(value, F.lit(default))) if default is not None else out


def violations(frame: DataFrame, molecules: DataFrame, molecule: str = "molecule_id", value: str = "smiles", most: int = 25, identity=None) -> DataFrame:
    """(molecule, problem) of a submission: missing, unexpected, repeated, empty, too_many, invalid (null identity), duplicate.  Empty if it is fine."""
    v = parts(F.coalesce(F.col(value), F.lit("")))
    ids = F.transform(v, identity) if identity else v
    problem = (
        F.when(F.size(v) < 1, "empty").when(F.size(v) > most, "too_many").when(F.exists(ids, lambda x: x.isNull()), "invalid").when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate")
    )
    rows = frame.select(molecule, problem.alias("problem")).where("problem is not null")
    sides = symmetric_difference(frame, molecules, molecule).select(molecule, F.when(F.col("side") == "left", "unexpected").otherwise("missing").alias("problem"))
    return rows.unionByName(sides).unionByName(unique(frame, molecule).select(molecule, F.lit("repeated").alias("problem")))


def write_submission(frame: DataFrame, path: str, order: Column | str = "molecule_id") -> None:
    """One CSV, sorted: a row a molecule, the only place where all rows meet in one task."""
    frame.orderBy(order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, by_mass: str | None = None, partitions: int | None = None) -> None:
    """Parquet; with a mass column, range-partitioned and sorted by it, so that row-group statistics prune windows."""
    if by_mass:
        df = (df.repartitionByRange(partitions, by_mass) if partitions else df.repartitionByRange(by_mass)).sortWithinPartitions(by_mass)
    df.write.mode("overwrite").parquet(path)


def _file(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in it: the cluster's, whatever that is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    system, at = _file(spark, path)
    if not system.exists(at):
        return None
    stream = system.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through the cluster's file system, whole or not at all: written under another name, then renamed."""
    system, at = _file(spark, path)
    _, draft = _file(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = system.create(draft, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if system.exists(at):
        system.delete(at, False)
    if not system.rename(draft, at):
        raise OSError(f"{path} could not be written")


def write_once(df: DataFrame, path: str, config: dict) -> bool:
    """Writes unless a table of this very configuration is there; another configuration raises an error.  Whether it wrote.  The marker lies beside the table, in the same file system."""
    marker, own = f"{path.rstrip('/')}/_config.json", json.dumps(config, sort_keys=True)
    found = read_text(df.sparkSession, marker)
    if found is not None:
        if found != own:
            raise ValueError(f"{path} was made with another configuration")
        return False
    df.write.mode("overwrite").parquet(path)
    write_text(df.sparkSession, marker, own)
    return True


def audited(df: DataFrame, by: list[str], **measures: Column) -> tuple[DataFrame, DataFrame]:
    """The table, and what is counted of it by some columns: two outputs of one plan, which is computed once and kept in the shared folder for both."""
    rows = settled(df)
    return rows, rows.groupBy(*by).agg(*[m.alias(n) for n, m in measures.items()])


def write_json_text(path: str, text: str) -> None:
    """On the driver's own disk: whole or not at all, by a temporary file that is renamed."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=os.path.dirname(path) or ".", delete=False) as f:
        f.write(text)
    os.replace(f.name, path)


def write_json(path: str, value: object) -> None:
    """As write_json_text(); numbers that aren't finite raise an error."""
    write_json_text(path, json.dumps(value, indent=2, ensure_ascii=False, allow_nan=False) + "\n")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, most: int = 100) -> str:
    """A small result as a table in Markdown; ValueError for more than ``most`` rows, for a report that leaves some out would look whole."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: aggregate them, or raise the bound")
    show = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(x) for x in r) + " |" for r in rows]) + "\n"
