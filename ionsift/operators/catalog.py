"""Structure catalogs: union, append, reasons of rejection, exclusion of copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import graphs
from ..functions.hashing import signature
from ..functions.text import identity_key


def union_first(tables: list[DataFrame], key: str, order: list[str] | None = None) -> DataFrame:
    """All tables' rows, each key once: from the earliest table that has it, then by the order columns."""
    parts = [t.withColumn("__t", F.lit(i)) for i, t in enumerate(tables)]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    w = Window.partitionBy(key).orderBy("__t", *(order or []))
    return all_.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__t")


def candidate_pool(library: DataFrame, coconut: DataFrame) -> DataFrame:
    """library (inchikey14, normalized_smiles, mass) and coconut (inchikey, canonical_smiles, exact_mass), each key once, with origin; rows need a key, a structure and a positive finite mass."""
    other = coconut.select(identity_key(F.col("inchikey")).alias("inchikey14"), F.col("canonical_smiles").alias("normalized_smiles"), F.col("exact_mass").alias("mass"))
    cols = ["inchikey14", "normalized_smiles", "mass"]
    fine = F.col("inchikey14").isNotNull() & F.col("normalized_smiles").isNotNull() & ~F.isnan("mass") & (F.col("mass") > 0) & (F.col("mass") < float("inf"))
    both = [library.select(*cols, F.lit("library").alias("origin")).where(fine), other.select(*cols, F.lit("coconut").alias("origin")).where(fine)]
    return union_first(both, "inchikey14", ["mass", "normalized_smiles"])


def appended(pool: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """The pool, and the extra rows whose key it lacks."""
    return pool.unionByName(extra.join(pool.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def with_reason(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """``reason``: the first check that fails (false or null), else 'retained'."""
    ladder = None
    for name, passes in checks:
        failed = ~F.coalesce(passes, F.lit(False))
        ladder = F.when(failed, name) if ladder is None else ladder.when(failed, name)
    return df.withColumn("reason", ladder.otherwise("retained") if ladder is not None else F.lit("retained"))


def reason_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("reason").agg(F.count("*").alias("rows"))


ORIGINS = ("pubchemlite", "chembl", "chebi")


def imported(rows: DataFrame, origin: str, computed_key: Column | None = None) -> DataFrame:
    """A reader's every row with ``reason`` ('retained', or why it is rejected), ``formula`` and the computed ``mass`` (null where the structure isn't read).

    rows are as the reader of that origin gives them: inchikey14,
    normalized_smiles; for pubchemlite the declared mass as ``mass``; for chebi
    ``reviewed``.  The structure's own key needs a chemistry runtime: where
    ``computed_key`` gives it, it must be the declared one; else a declared key
    must have its form.
    """
    if origin not in ORIGINS:
        raise ValueError(f"unknown origin {origin}")
    declared = F.col("mass") if "mass" in rows.columns else F.lit(None).cast("double")
    own = rows.withColumn("__declared", declared.cast("double")).drop("mass", "reason", "formula").withColumn("__graph", graphs.graph(F.col("normalized_smiles")))
    own = own.withColumn("__c", graphs.composition(F.col("__graph")))
    c, key = F.col("__c"), F.coalesce(F.col("inchikey14"), F.lit(""))
    formed = key.rlike("^[A-Z]{14}$")
    identical = formed & (computed_key.eqNullSafe(key) if computed_key is not None else F.lit(True))
    read = c.isNotNull()
    if origin == "pubchemlite":
        d = F.col("__declared")
        checks = [("invalid", read & d.isNotNull() & ~F.isnan(d) & (d > 0) & (d < float("inf"))), ("identity_mismatch", identical), ("mass_disagreement", F.abs(c["mass"] - d) <= 0.01)]
    else:
        plain = ~c["generic"] & ~c["isotopes"] & (c["charge"] == 0)
        same = identical if origin == "chembl" else identical | (key == "")
        checks = [("invalid", read), ("mixture_or_nonorganic", (c["parts"] == 1) & (c["carbons"] > 0)), ("charged_generic_or_isotopic", plain), ("identity_disagreement", same), ("invalid_mass", c["mass"] > 0)]
        checks = [("not_reviewed_default", F.col("reviewed")), *checks] if origin == "chebi" else checks
    out = with_reason(own, checks).withColumn("formula", c["formula"]).withColumn("mass", c["mass"])
    return out.drop("__declared", "__graph", "__c")


def charged_imported(rows: DataFrame, computed_key: Column | None = None, most: int = 8) -> DataFrame:
    """A catalog's charged structures (inchikey14, normalized_smiles): every row with ``reason``, ``formula``, ``mass`` (less the electrons of the charge) and ``formal_charge``.

    What imported() rejects for its charge is retained here: one part with
    carbon, a net charge of 1 to ``most`` either way, no wildcard, no isotope.
    Keys are compared as imported() does; stereo marks stay in the structure.
    """
    own = rows.drop("mass", "reason", "formula", "formal_charge").withColumn("__graph", graphs.graph(F.col("normalized_smiles")))
    own = own.withColumn("__c", graphs.composition(F.col("__graph")))
    c, key = F.col("__c"), F.coalesce(F.col("inchikey14"), F.lit(""))
    identical = key.rlike("^[A-Z]{14}$") & (computed_key.eqNullSafe(key) if computed_key is not None else F.lit(True))
    out = with_reason(own, [
        ("invalid", c.isNotNull()), ("net_neutral", c["charge"] != 0), ("charge_out_of_supported_range", F.abs(c["charge"]) <= most), ("mixture_or_nonorganic", (c["parts"] == 1) & (c["carbons"] > 0)),
        ("generic_or_isotopic", ~c["generic"] & ~c["isotopes"]), ("identity_disagreement", identical), ("invalid_mass", c["mass"] > 0),
    ])
    return out.withColumns({"formula": c["formula"], "mass": c["mass"], "formal_charge": c["charge"]}).drop("__graph", "__c")


def catalog_of(rows: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """imported() tables as one catalog, each key once, of the earliest table that has it; and the rows of each origin by reason.  Read the tables from a checkpoint if both are needed."""
    kept = [r.where("reason = 'retained'").select("inchikey14", "normalized_smiles", "mass", "formula", "origin") for r in rows]
    counts = [r.groupBy("origin", "reason").agg(F.count("*").alias("rows")) for r in rows]
    for c in counts[1:]:
        counts[0] = counts[0].unionByName(c)
    return union_first(kept, "inchikey14", ["mass", "normalized_smiles"]), counts[0]


def merged_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The join of two tables by keys that are unique on both sides; the query fails on a key that comes twice."""

    def once(df: DataFrame) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(*keys))
        return df.withColumn("__once", F.when(n > 1, F.raise_error(F.lit(f"repeated {', '.join(keys)}")).cast("boolean")).otherwise(F.lit(True))).where("__once").drop("__once")

    return once(left).join(once(right), keys, how)


def generated_funnel(rows: DataFrame, group: str, key: str, mass: Column, center: Column, score: str, stages: list[tuple[str, Column]], ppm: float = 35.0, floor: float = 0.006) -> tuple[DataFrame, DataFrame]:
    """Generated candidates through their checks: (kept, counts).

    ``stages`` are named conditions, after which the mass has to lie in its
    window; kept has for each (group, key) the row of the best score (equals:
    the first by all columns), and ``samples``, how many rows had the key.
    counts has for each group the rows that reach each stage.
    """
    from ..functions.mass import mass_tolerance

    steps = [*stages, ("in_window", F.abs(mass - center) <= mass_tolerance(center, ppm, floor))]
    passed, marks = F.lit(True), {}
    for name, check in steps:
        passed = passed & F.coalesce(check, F.lit(False))
        marks[name] = passed
    counts = rows.groupBy(group).agg(F.count("*").alias("generated"), *[F.count_if(c).alias(n) for n, c in marks.items()], F.count_distinct(F.when(passed, F.col(key))).alias("kept"))
    own = [c for c in rows.columns if c not in (group, key)]
    best = F.max_by(F.struct(*own), F.struct(F.col(score), F.xxhash64(*own)))
    kept = rows.where(passed).groupBy(group, key).agg(best.alias("__b"), F.count("*").alias("samples"))
    return kept.select(group, key, *[F.col(f"__b.{c}").alias(c) for c in own], "samples"), counts


def unanswered(molecules: DataFrame, rankings: DataFrame, key: str, ranking: str = "ranking") -> DataFrame:
    """(key, problem): molecules without any ranking, which must count as empty ones, and rankings of unknown molecules; nothing else is let pass in silence."""
    asked, given = molecules.select(key).distinct(), rankings.select(key, ranking)
    missing = asked.join(given, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    stray = given.join(asked, key, "left_anti").select(key, F.lit("unexpected").alias("problem"))
    empty = given.join(asked, key, "left_semi").where(F.coalesce(F.size(ranking), F.lit(0)) == 0).select(key, F.lit("empty").alias("problem"))
    return missing.unionByName(stray).unionByName(empty)


def without_copies(rows: DataFrame, queries: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Rows whose content, under the same key, is no query's."""
    marked = queries.select(key, signature(*[F.col(c) for c in content]).alias("__sig")).distinct()
    return rows.withColumn("__sig", signature(*[F.col(c) for c in content])).join(marked, [key, "__sig"], "left_anti").drop("__sig")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both: empty if a split leaks nothing."""
    return a.select(key).intersect(b.select(key))


def coverage(catalog_before: DataFrame, catalog_after: DataFrame, truths: DataFrame, key: str) -> DataFrame:
    """truths, before, after: how many keys each catalog holds."""
    before, after = (c.select(key).distinct().withColumn(n, F.lit(1)) for c, n in ((catalog_before, "__b"), (catalog_after, "__a")))
    both = truths.select(key).distinct().join(before, key, "left").join(after, key, "left")
    return both.agg(F.count("*").alias("truths"), F.count("__b").alias("before"), F.count("__a").alias("after"))
