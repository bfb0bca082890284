"""Cohorts: who was used before, who is drawn, which rows pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import digest
from ..functions.text import energy_signature
from .range_join import met


def fresh(keys: DataFrame, earlier: list[DataFrame], key: str) -> DataFrame:
    """Keys that no earlier cohort used."""
    out = keys.select(key).distinct()
    for e in earlier:
        out = out.join(e.select(key).distinct(), key, "left_anti")
    return out


def drawn(keys: DataFrame, earlier: list[DataFrame], key: str, limit: int, prefix: str) -> DataFrame:
    """The fresh keys with the smallest digests under a prefix."""
    return fresh(keys, earlier, key).orderBy(digest(F.col(key), prefix), key).limit(limit)


def usage(cohort: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """keys, repeated, fresh of a cohort against all used before."""
    used = registry.select(key).distinct().withColumn("__u", F.lit(1))
    both = cohort.select(key).distinct().join(used, key, "left")
    return both.agg(F.count("*").alias("keys"), F.count("__u").alias("repeated"), (F.count("*") - F.count("__u")).alias("fresh"))


def extended(old: DataFrame, keys: DataFrame, key: str, more: int, prefix: str) -> DataFrame:
    """The old sample exactly, and more keys drawn from the others."""
    return old.select(key).unionByName(drawn(keys, [old], key, more, prefix))


#: What counts as no value in a column that pairing needs to know (fixed values).
UNKNOWN = ("", "unknown", "none", "nan", "n/a")


def _paired(df: DataFrame, group: list[str], energies: str, known: list[str]) -> DataFrame:
    """Rows that can have partners at other energies: ``__sig``, their signature, is there, and the columns of ``known`` hold a value."""
    rows = df.withColumn("__sig", energy_signature(F.col(energies))).where("__sig is not null")
    for c in known:
        rows = rows.where(F.col(c).isNotNull() & ~F.lower(F.trim(F.col(c).cast("string"))).isin(*UNKNOWN))
    return rows


def energy_classes(df: DataFrame, group: list[str], row: str, energies: str, known: list[str] | None = None) -> DataFrame:
    """For each row that has one: ``signature``, ``partners`` (rows of its group at other energies) and ``place`` in its class, from 0.

    Linear in the rows: a row's partners are its group's rows less those of
    its class.
    """
    rows = _paired(df, group, energies, known or []).select(*group, row, F.col("__sig").alias("signature"))
    sizes = rows.groupBy(*group, "signature").agg(F.count("*").alias("__own"))
    totals = sizes.withColumn("__all", F.sum("__own").over(Window.partitionBy(*group)))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(*group, "signature").orderBy(row)) - 1)
    return met(placed, totals, [*group, "signature"]).select(*group, row, "signature", "place", (F.col("__all") - F.col("__own")).alias("partners"))


def energy_pairs(df: DataFrame, group: list[str], row: str, energies: str, known: list[str] | None = None) -> DataFrame:
    """Ordered pairs of a group's rows at different energies, nulls of the group equal: row, other.

    All of them, so as many as the square of a group's rows: for groups that
    are bounded, as a molecule's spectra are.  energy_classes() says the same
    of any group in as many rows as it has, drawn_partner() takes one each.
    """
    own = _paired(df, group, energies, known or []).select(*group, row, "__sig")
    a, b = own.alias("a"), own.alias("b")
    same = F.lit(True)
    for c in group:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same & (F.col("a.__sig") != F.col("b.__sig"))).select(F.col(f"a.{row}").alias(row), F.col(f"b.{row}").alias("other"))


def drawn_partner(df: DataFrame, group: list[str], row: str, energies: str, known: list[str] | None = None, seed: str = "energy") -> DataFrame:
    """(row, other): for each row one partner at another energy, the one a hash of the row points at; rows without any meet themselves.

    Classes are numbered within their group in the order of their signatures,
    and their rows within them, so that a partner is a number among those of
    the group less the row's own class: a join, no pairs.
    """
    classes = energy_classes(df, group, row, energies, known)
    heads = classes.groupBy(*group, "signature").agg(F.count("*").alias("__own"))
    heads = heads.withColumn("__first", F.sum("__own").over(Window.partitionBy(*group).orderBy("signature")) - F.col("__own"))
    name = F.to_json(F.struct(*[F.col(c) for c in group]), {"ignoreNullFields": "false"})
    rows = met(classes, heads, [*group, "signature"]).withColumn("__group", name)
    k = F.pmod(digest(F.col(row), f"{seed}:"), F.col("partners")).cast("long")
    asked = rows.where("partners > 0").select("__group", row, F.when(k >= F.col("__first"), k + F.col("__own")).otherwise(k).alias("__at"))
    there = rows.select("__group", (F.col("__first") + F.col("place")).alias("__at"), F.col(row).alias("other"))
    found = asked.join(there, ["__group", "__at"]).select(row, "other")
    return df.select(row).join(found, row, "left").select(row, F.coalesce("other", row).alias("other"))


def second_rows(df: DataFrame, representatives: DataFrame, group: list[str], row: str, seed: str = "second") -> DataFrame:
    """(row, other): for each representative another row of its group, nulls of the group equal, the one a hash points at; itself where it is alone."""
    name = F.to_json(F.struct(*[F.col(c) for c in group]), {"ignoreNullFields": "false"})
    rows = df.select(row, name.alias("__group"))
    rows = rows.withColumn("__at", F.row_number().over(Window.partitionBy("__group").orderBy(row)) - 1)
    sizes = rows.groupBy("__group").agg(F.count("*").alias("__n"))
    own = representatives.select(row).join(rows, row).join(sizes, "__group")
    k = F.pmod(digest(F.col(row), f"{seed}:"), F.greatest(F.col("__n") - 1, F.lit(1))).cast("long")
    asked = own.select(row, "__group", F.when(F.col("__n") == 1, F.col("__at")).when(k >= F.col("__at"), k + 1).otherwise(k).alias("__at"))
    return asked.join(rows.select("__group", "__at", F.col(row).alias("other")), ["__group", "__at"]).select(row, "other")


def merge_in_order(parts: list[DataFrame], order: DataFrame, key: str, position: str) -> DataFrame:
    """Parts joined to the order they came from, with ``count``: the parts that hold the key, which is one if they are disjoint and whole."""
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    counted = all_.withColumn("count", F.count("*").over(Window.partitionBy(key)))
    return order.select(key, position).join(counted, key, "left").withColumn("count", F.coalesce("count", F.lit(0)))


def dealt(df: DataFrame, position: str, parts: int) -> DataFrame:
    """``part``: rows dealt out in turn."""
    return df.withColumn("part", (F.col(position) % parts).cast("int"))
