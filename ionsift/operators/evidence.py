"""Evidence of a spectrum for chemical rules, and what candidates make of it.

Spectra come as one row per peak: spectrum, at (place by m/z), mz, intensity
(relative), with the spectrum's precursor and the rules it may use.  Matches
are joins by bins of mass, then exact tolerances.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import motifs
from ..functions.mass import ELECTRON, formula_mass, ion_neutral_mass, parse_adduct
from ..functions.peaks import let
from ..functions.text import high_resolution
from ..lineage import small
from .range_join import band_join

# Names, kinds, formulas (less an electron for the ion), modes, adducts and weights of the rules.
PROTONATED = ["[M+H]+", "[M-H]-", "[M-H2O+H]+", "[M-2H2O+H]+", "[M-H2O-H]-"]
BOTH = ["positive", "negative"]
RULES = [
    ("water", "loss", "H2O", 0.0, BOTH, PROTONATED, 0.25), ("ammonia", "loss", "NH3", 0.0, ["positive"], ["[M+H]+"], 0.4), ("carbon_monoxide", "loss", "CO", 0.0, BOTH, PROTONATED, 0.3),
    ("carbon_dioxide", "loss", "CO2", 0.0, BOTH, PROTONATED, 0.5), ("hexose_residue", "loss", "C6H10O5", 0.0, BOTH, PROTONATED, 0.7), ("deoxyhexose_residue", "loss", "C6H10O4", 0.0, BOTH, PROTONATED, 0.6),
    ("pentose_residue", "loss", "C5H8O4", 0.0, BOTH, PROTONATED, 0.6), ("phosphocholine", "ion", "C5H15NO4P", -ELECTRON, ["positive"], ["[M+H]+"], 1.0),
]
# Broader rules of the same form, all of weight 1.
POSITIVE, NEGATIVE = (-ELECTRON, ["positive"], ["[M+H]+"], 1.0), (ELECTRON, ["negative"], ["[M-H]-"], 1.0)
BROAD_LOSS = (0.0, BOTH, PROTONATED, 1.0)
BROAD = [
    ("phenyl_ion", "ion", "C6H5", *POSITIVE), ("benzyl_tropylium_ion", "ion", "C7H7", *POSITIVE), ("benzoyl_ion", "ion", "C7H5O", *POSITIVE), ("benzoate_ion", "ion", "C7H5O2", *NEGATIVE),
    ("phosphate_ion", "ion", "PO3", *NEGATIVE), ("dihydrogen_phosphate_ion", "ion", "H2PO4", *NEGATIVE), ("methanol", "loss", "CH4O", *BROAD_LOSS), ("sulfur_dioxide", "loss", "SO2", *BROAD_LOSS),
    ("sulfur_trioxide", "loss", "SO3", *BROAD_LOSS), ("phosphoric_acid", "loss", "H3PO4", *BROAD_LOSS), ("metaphosphoric_acid", "loss", "HPO3", *BROAD_LOSS), ("acetic_acid", "loss", "C2H4O2", *BROAD_LOSS),
]
# The motif with which a structure supports each rule.
PHOSPHATE = "[P](=[O])([O])([O])[O]"
MOTIFS = {
    "water": "[O;H1,H2]", "ammonia": "[N;H1,H2,H3]", "carbon_monoxide": "[C,c]=[O]", "carbon_dioxide": "[C](=[O])[O]", "hexose_residue": "[O;R]1[C;R][C;R][C;R][C;R][C;R]1",
    "deoxyhexose_residue": "[O;R]1[C;R][C;R][C;R][C;R][C;R]1", "pentose_residue": "[O;R]1[C;R][C;R][C;R][C;R]1", "phosphocholine": "[P](=[O])([O])([O])[O]CC[N+](C)(C)C",
    "phenyl_ion": "c1ccccc1", "benzyl_tropylium_ion": "c1ccccc1", "benzoyl_ion": "c1ccccc1[C](=[O])", "benzoate_ion": "c1ccccc1[C](=[O])[O]", "phosphate_ion": PHOSPHATE, "dihydrogen_phosphate_ion": PHOSPHATE,
    "methanol": "[O][CH3]", "sulfur_dioxide": "[S](=[O])(=[O])", "sulfur_trioxide": "[S](=[O])(=[O])[O]", "phosphoric_acid": PHOSPHATE, "metaphosphoric_acid": PHOSPHATE, "acetic_acid": "[CH3][C](=[O])[O]",
}
KINDS = ["ion", "precursor_loss", "peak_loss"]


def rule_table(spark: SparkSession, rules: list[tuple] = RULES) -> DataFrame:
    """rule, kind, mass, modes, adducts, weight: a dimension of a few rows, of the caller's own rules if given."""
    df = spark.createDataFrame(rules, "rule string, kind string, formula string, shift double, modes array<string>, adducts array<string>, weight double")
    return df.select("rule", "kind", (formula_mass(F.col("formula")) + F.col("shift")).alias("mass"), "modes", "adducts", "weight")


def rules_for(spectra: DataFrame, rules: DataFrame) -> DataFrame:
    """Spectra (spectrum, adduct, ionization_mode, instrument_type, precursor_mz) with each rule they may use: high resolution, one molecule, one charge, and the rule's mode and adduct."""
    ion = parse_adduct(F.col("adduct"))
    fine = spectra.where(high_resolution(F.col("instrument_type")) & (ion["molecules"] == 1) & (F.abs(ion["charge"]) == 1))
    # exploded modes make it an equi-join with a few broadcast rows
    each = rules.select("rule", "kind", "mass", "weight", F.explode("modes").alias("ionization_mode"), "adducts").select("*", F.explode("adducts").alias("adduct")).drop("adducts")
    return fine.join(small(each), ["ionization_mode", "adduct"])


def _tolerance(x: Column, ppm: float, absolute: float) -> Column:
    return F.greatest(F.lit(absolute), F.abs(x) * (ppm * 1e-6))


def matches(spectra: DataFrame, peaks: DataFrame, rules: DataFrame, ppm: float = 10.0, absolute: float = 0.002) -> DataFrame:
    """spectrum, rule, kind, mz, error_da, strength, from_at, to_at.

    Diagnostic ions lie at the rule's mass; precursor losses below the
    precursor by it, with both ends' tolerances; peak losses between two
    peaks, the higher first.
    """
    use = rules_for(spectra, rules).select("spectrum", "rule", F.col("kind").alias("rule_kind"), F.col("mass").alias("rule_mass"), "precursor_mz")
    near = peaks.join(use, "spectrum")
    ions = near.where((F.col("rule_kind") == "ion") & (F.abs(F.col("mz") - F.col("rule_mass")) <= _tolerance(F.col("rule_mass"), ppm, absolute)))
    ions = ions.select("spectrum", "rule", F.lit("ion").alias("kind"), "mz", (F.col("mz") - F.col("rule_mass")).alias("error_da"), F.sqrt("intensity").alias("strength"), F.lit(-2).alias("from_at"), F.col("at").alias("to_at"))
    error = F.col("precursor_mz") - F.col("mz") - F.col("rule_mass")
    both = _tolerance(F.col("precursor_mz"), ppm, absolute) + _tolerance(F.col("mz"), ppm, absolute)
    losses = near.where((F.col("rule_kind") == "loss") & (F.col("precursor_mz") > F.col("mz")) & (F.abs(error) <= both))
    losses = losses.select("spectrum", "rule", F.lit("precursor_loss").alias("kind"), "mz", error.alias("error_da"), F.sqrt("intensity").alias("strength"), F.lit(-1).alias("from_at"), F.col("at").alias("to_at"))
    pairs = peak_pairs(near.where("rule_kind = 'loss'"), peaks, ppm, absolute)
    return ions.unionByName(losses).unionByName(pairs)


def peak_pairs(low: DataFrame, peaks: DataFrame, ppm: float = 10.0, absolute: float = 0.002, width: float = 0.5) -> DataFrame:
    """Pairs of one spectrum's peaks that differ by a rule's mass: a self-join by (spectrum, bin of the target), then the tolerance."""
    target = F.col("mz") + F.col("rule_mass")
    tol = _tolerance(F.col("mz"), ppm, absolute) + _tolerance(target, ppm, absolute)
    left = low.withColumn("__t", target).withColumn("__tol", tol)
    left = left.withColumn("__bin", F.explode(F.sequence(F.floor((F.col("__t") - F.col("__tol")) / width), F.floor((F.col("__t") + F.col("__tol")) / width))))
    right = peaks.select("spectrum", F.col("at").alias("__at2"), F.col("mz").alias("__mz2"), F.col("intensity").alias("__i2"), F.floor(F.col("mz") / width).alias("__bin"))
    hit = left.join(right, ["spectrum", "__bin"]).where((F.col("__at2") > F.col("at")) & (F.abs(F.col("__mz2") - F.col("__t")) <= F.col("__tol")))
    return hit.select("spectrum", "rule", F.lit("peak_loss").alias("kind"), "mz", (F.col("__mz2") - F.col("mz") - F.col("rule_mass")).alias("error_da"), F.sqrt(F.least("intensity", "__i2")).alias("strength"), F.col("__at2").alias("from_at"), F.col("at").alias("to_at"))


def chains(found: DataFrame) -> DataFrame:
    """Two losses in sequence, the second from where the first leads: spectrum, first, second, strength."""
    losses = found.where("kind <> 'ion'")
    a = losses.select("spectrum", F.col("to_at").alias("__meet"), F.col("rule").alias("first"), F.col("strength").alias("__a"))
    b = losses.select("spectrum", F.col("from_at").alias("__meet"), F.col("rule").alias("second"), F.col("strength").alias("__b"))
    return a.join(b, ["spectrum", "__meet"]).select("spectrum", "first", "second", F.least("__a", "__b").alias("strength"))


def strongest(found: DataFrame, by: list[str], what: list[str]) -> DataFrame:
    """The largest strength of each rule or chain over a molecule's spectra."""
    return found.groupBy(*by, *what).agg(F.max("strength").alias("strength"))


def channels(found: DataFrame, by: list[str], rules: list[str]) -> DataFrame:
    """A column for each rule and kind with the largest strength, 0 where there is none."""
    names = [f"{r}:{k}" for r in rules for k in KINDS]
    wide = found.withColumn("__c", F.concat_ws(":", "rule", "kind")).groupBy(*by).pivot("__c", names).agg(F.max("strength"))
    return wide.fillna(0.0, names)


def candidate_scores(found: DataFrame, chained: DataFrame, support: DataFrame, rules: DataFrame, group: str, key: str, component: str = "combined") -> DataFrame:
    """Of candidates by the rules their structure supports (group, key, rule): group, key, diagnostic, loss, combination, evidence.

    Strengths count once a molecule, at their largest, times the rule's
    weight; chains of supported rules a tenth.
    """
    if component not in ("diagnostic", "loss", "combined"):
        raise ValueError(component)
    dim = small(rules.select("rule", F.col("kind").alias("__kind"), "weight"))
    values = support.join(strongest(found, [group], ["rule"]), [group, "rule"]).join(dim, "rule").withColumn("__v", F.col("weight") * F.col("strength"))
    single = values.groupBy(group, key).agg(F.sum(F.when(F.col("__kind") == "ion", F.col("__v")).otherwise(0.0)).alias("diagnostic"), F.sum(F.when(F.col("__kind") == "loss", F.col("__v")).otherwise(0.0)).alias("loss"))
    best = strongest(chained, [group], ["first", "second"])
    a, b = support.select(group, key, F.col("rule").alias("first")), support.select(group, key, F.col("rule").alias("second"))
    double = best.join(a, [group, "first"]).join(b, [group, "second", key]).groupBy(group, key).agg((0.1 * F.sum("strength")).alias("combination"))
    out = support.select(group, key).distinct().join(single, [group, key], "left").join(double, [group, key], "left").fillna(0.0, ["diagnostic", "loss", "combination"])
    total = {"diagnostic": F.col("diagnostic"), "loss": F.col("loss") + F.col("combination"), "combined": F.col("diagnostic") + F.col("loss") + F.col("combination")}[component]
    return out.withColumn("evidence", total)


def contrasts(credits: DataFrame, group: str, spectrum: str, key: str, peak: str, weight: str, candidates: str = "candidates") -> DataFrame:
    """Fragment contrast of candidates: credited peaks weigh ln(n / support) / ln n; spectra need two such peaks and 0.05 of intensity; the median over three spectra at least: (group, key, contrast, spectra)."""
    w = credits.groupBy(group, spectrum, peak).agg(F.countDistinct(key).alias("__support"))
    idf = F.log(F.col(candidates) / F.col("__support")) / F.log(F.col(candidates))
    rows = credits.join(w, [group, spectrum, peak]).withColumn("__w", F.when(F.col(candidates) > 1, idf).otherwise(0.0)).where("__w > 0")
    per = rows.groupBy(group, spectrum, key).agg(F.sum(F.col("__w") * F.col(weight)).alias("__s"), F.sum(weight).alias("__i"), F.count("*").alias("__n")).where("__n >= 2 and __i >= 0.05")
    return per.groupBy(group, key).agg(F.percentile(F.col("__s"), 0.5).alias("contrast"), F.count("*").alias("spectra")).where("spectra >= 3")


def normalized_mean(scores: DataFrame, group: str, spectrum: str, key: str, score: str = "score") -> DataFrame:
    """Mean over informative spectra of a key's score over the spectrum's largest; a spectrum informs if its scores differ and one is positive."""
    per = scores.groupBy(group, spectrum).agg(F.max(score).alias("__max"), F.min(score).alias("__min"))
    fine = per.where((F.col("__max") > 0) & (F.col("__max") > F.col("__min")))
    n = fine.groupBy(group).agg(F.count("*").alias("__n"))
    rows = scores.join(fine, [group, spectrum]).groupBy(group, key).agg(F.sum(F.col(score) / F.col("__max")).alias("__s"))
    return rows.join(n, group).select(group, key, (F.col("__s") / F.col("__n")).alias("evidence"))


def monomer_view(adduct: Column, precursor: Column, instrument: Column, peaks: Column, aliases: list[str]) -> Column:
    """A dimer's spectrum as its monomer's: struct (adduct, precursor_mz, peaks), null without a marker peak at the monomer and products below it."""
    ion, single = parse_adduct(adduct), F.regexp_replace(adduct, r"^\[2M", "[M")
    virtual = ion_neutral_mass(ion, precursor) + parse_adduct(single)["shift"]
    marker = F.exists(peaks, lambda p: (F.abs(p["mz"] - virtual) <= F.greatest(F.lit(0.002), virtual * 1e-5)) & (p["i"] >= 0.05))
    products = F.filter(peaks, lambda p: p["mz"] < virtual - 0.01)
    fine = (ion["molecules"] == 2) & (F.abs(ion["charge"]) == 1) & single.isin(aliases) & high_resolution(instrument) & marker & (F.size(products) > 0)
    return F.when(F.coalesce(fine, F.lit(False)), F.struct(single.alias("adduct"), virtual.alias("precursor_mz"), products.alias("peaks")))


def _near(mass: Column, other: Column) -> Column:
    return F.abs(mass - other) <= F.greatest(F.lit(0.002), mass * 1e-5)


def merge_peaks(spectra: DataFrame, group: str) -> DataFrame:
    """Spectra (group, row, alias, mass, precursor_mz, mzs, intensities) merged: group, alias, precursor_mz, mzs, intensities, merged.

    In the order of rows, a spectrum opens a cluster unless one of its alias
    lies within max(0.002, 10 ppm) of its mass, in which case it joins the
    first such.  A cluster's peaks below the precursors are cut into runs that
    begin at the lowest peak and at each one out of tolerance of the run's
    first, and a run is its first mass with its largest intensity; its
    precursor is the median.  Spectra without alias or mass, and clusters of
    one, stay as they are.  Both orders matter, so both are folds over the
    arrays of one group, a molecule's spectra.
    """
    own = F.struct("row", "alias", "mass", "precursor_mz", "mzs", "intensities")
    all_ = spectra.groupBy(group).agg(F.array_sort(F.collect_list(own)).alias("__rows"))
    usable = F.filter("__rows", lambda r: r["alias"].isNotNull() & r["mass"].isNotNull())
    fits = lambda c, r: (c["alias"] == r["alias"]) & _near(r["mass"], c["mass"])
    opened = F.aggregate(
        usable, F.expr("cast(array() as array<struct<alias: string, mass: double>>)"),
        lambda cs, r: F.when(F.exists(cs, lambda c: fits(c, r)), cs).otherwise(F.concat(cs, F.array(F.struct(r["alias"].alias("alias"), r["mass"].cast("double").alias("mass"))))),
    )
    # the first cluster that fits, from 1; spectra without one count down from -1
    joined = let(opened, lambda cs: F.transform("__rows", lambda r, i: F.struct(F.coalesce(F.nullif(F.array_position(F.transform(cs, lambda c: F.coalesce(fits(c, r), F.lit(False))), F.lit(True)), F.lit(0)), -1 - i).alias("cluster"), r.alias("r"))))
    each = all_.select(group, F.explode(joined).alias("__x")).select(group, "__x.cluster", "__x.r")
    clusters = each.groupBy(group, "cluster").agg(F.array_sort(F.collect_list("r")).alias("__rows"), F.percentile("r.precursor_mz", 0.5).alias("__middle"))
    peaks = F.flatten(F.transform("__rows", lambda r: F.filter(F.arrays_zip(r["mzs"].alias("m"), r["intensities"].alias("i")), lambda p: p["m"] < r["precursor_mz"] - 0.01)))
    run = F.aggregate(
        F.array_sort(F.transform(peaks, lambda p, at: F.struct(p["m"].cast("double").alias("m"), at.alias("at"), p["i"].cast("double").alias("i")))),
        F.expr("cast(array() as array<struct<m: double, i: double>>)"),
        lambda runs, p: let(F.try_element_at(runs, F.lit(-1)), lambda last: F.when(
            _near(p["m"], last["m"]), F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.struct(last["m"].alias("m"), F.greatest(last["i"], p["i"]).alias("i"))))
        ).otherwise(F.concat(runs, F.array(F.struct(p["m"].alias("m"), p["i"].alias("i")))))),
    )
    first, alone = F.col("__rows")[0], F.size("__rows") == 1
    merged = clusters.withColumn("__first", first).withColumn("__run", F.when(~alone, run))
    kept = lambda field, part: F.when(alone, F.coalesce(F.col(f"__first.{field}").cast("array<double>"), F.expr("cast(array() as array<double>)"))).otherwise(F.transform("__run", lambda p: p[part]))
    return merged.select(
        group, F.col("__first.alias").alias("alias"), F.when(alone, F.col("__first.precursor_mz")).otherwise(F.col("__middle")).alias("precursor_mz"),
        kept("mzs", "m").alias("mzs"), kept("intensities", "i").alias("intensities"), F.size("__rows").cast("long").alias("merged"),
    )


def band_evidence(peaks: DataFrame, fragments: DataFrame, by: list[str], tolerance: float = 0.01) -> DataFrame:
    """Peaks (by, mz, i) with fragment masses (by, key, mass) within a tolerance: the share of root intensity each key explains."""
    total = peaks.groupBy(*by).agg(F.sum(F.sqrt("i")).alias("__all"))
    cells = peaks.withColumn("__bin", F.explode(F.sequence(F.floor((F.col("mz") - tolerance) / 1.0), F.floor((F.col("mz") + tolerance) / 1.0))))
    hit = cells.join(fragments.withColumn("__bin", F.floor(F.col("mass") / 1.0)), [*by, "__bin"]).where(F.abs(F.col("mz") - F.col("mass")) <= tolerance)
    part = hit.select(*by, "key", "mz", "i").distinct().groupBy(*by, "key").agg(F.sum(F.sqrt("i")).alias("__part"))
    return part.join(total, by).select(*by, "key", (F.col("__part") / F.col("__all")).alias("score"))


def diagnostic_ions(peaks: DataFrame, ions: DataFrame, ppm: float = 10.0, absolute: float = 0.002) -> DataFrame:
    """All peaks at any of a long list of ion masses (rule, mass), by a band join rather than a broadcast."""
    m = F.col("mass")
    return band_join(ions, peaks, m - _tolerance(m, ppm, absolute), m + _tolerance(m, ppm, absolute), F.col("mz"), 0.05)


def support(g: Column, rules: list[str]) -> Column:
    """How often a structure's graph has each rule's motif, in the rules' order; null for a null graph."""
    return motifs.counts(g, [MOTIFS[r] for r in rules])


#: The broad rules' formulas.
FORMULAS = {r[0]: r[2] for r in BROAD}


def connected_support(g: Column, rules: list[str]) -> Column:
    """Whether the atoms of a broad rule's formula, hydrogen aside, are one side of a single bond outside rings; true for other rules."""
    return motifs.connected(g, [FORMULAS.get(r) for r in rules])


def exact_support(g: Column, rules: list[str]) -> Column:
    """Whether a broad rule's formula, hydrogens included as the structure has them, is one side of a single bond outside rings; true for other rules."""
    return motifs.connected(g, [FORMULAS.get(r) for r in rules], hydrogens=True)


def pooled(found: DataFrame, spectra: DataFrame, group: str, pooling: str = "mean") -> DataFrame:
    """Each rule and kind's strength over a group's spectra (spectrum, group): (group, rule, kind, strength).

    ``max`` is the largest, ``mean`` the mean over all spectra of the group,
    those without the evidence at 0, and ``intensity`` the mean of the squares,
    the peaks' intensities.  A group without evidence has no rows.
    """
    if pooling not in ("max", "mean", "intensity"):
        raise ValueError(pooling)
    own, s = spectra.select("spectrum", group), F.col("strength")
    top = strongest(found, ["spectrum"], ["rule", "kind"]).join(own, "spectrum")
    if pooling == "max":
        return top.groupBy(group, "rule", "kind").agg(F.max(s).alias("strength"))
    n = own.groupBy(group).agg(F.count("*").alias("__n"))
    total = top.groupBy(group, "rule", "kind").agg(F.sum(s if pooling == "mean" else s * s).alias("__s"))
    return total.join(n, group).select(group, "rule", "kind", (F.col("__s") / F.col("__n")).alias("strength"))


def channel_rows(strengths: DataFrame, by: list[str], rules: list[str]) -> DataFrame:
    """channels() as one array: (by, channels), three kinds a rule in the rules' order."""
    wide = channels(strengths, by, rules)
    return wide.select(*by, F.array(*[F.col(f"`{r}:{k}`") for r in rules for k in KINDS]).alias("channels"))


def compatibility(channels: Column, support: Column) -> Column:
    """Observed channels (three kinds a rule, in the rules' order) where the candidate supports the rule, else 0."""
    return F.transform(channels, lambda x, at: x * F.get(support, F.floor(at / 3).cast("int")))


def multiplicity(channels: Column, counts: Column) -> Column:
    """Observed channels by how often the candidate has the rule's motif beyond once, (n - 1) / (n + 1)."""
    more = F.transform(counts, lambda n: F.greatest(n - 1, F.lit(0)) / (n + 1))
    return compatibility(channels, more)


def bonus(score: Column, evidence: Column, weights: list[float], budget: float = 0.05) -> Column:
    """The score plus the weighed evidence (an array, null counts as 0); weights are not negative and stay within a budget."""
    if any(not 0 <= w < float("inf") for w in weights) or sum(weights) > budget + 1e-9:
        raise ValueError("weights are finite, not negative, and within the budget")
    own = F.array(*[F.lit(float(w)) for w in weights])
    delta = F.aggregate(F.zip_with(evidence, own, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return F.when(delta > 0, score + delta).otherwise(score)


def with_bonus(score: Column, channels: Column, support: Column, weights: list[float], budget: float = 0.05) -> Column:
    """bonus() by the compatible channels."""
    return bonus(score, compatibility(channels, support), weights, budget)


@dataclass(frozen=True)
class Bonus:
    """A way of adding evidence to candidates' scores: rules, how spectra are pooled, the weights' budget, and what is weighed beside the compatible channels.

    ``extra``: "counts" (multiplicity()), "predicted" (channels by the
    candidate's predicted ones, cut to 0..1), "conditional" (conditional()).
    ``refined`` names rules whose ions count only for candidates that also
    have them by a column ``sides``: connected_support() or exact_support().
    """

    rules: tuple[str, ...]
    pooling: str = "mean"
    budget: float = 0.05
    extra: str | None = None
    refined: tuple[str, ...] = ()

    @property
    def dimension(self) -> int:
        return len(self.rules) * len(KINDS) * (2 if self.extra else 1)


FIRST_RULES = tuple(r[0] for r in RULES)
ALL_RULES = (*FIRST_RULES, *(r[0] for r in BROAD))
BONUSES = {
    "first": Bonus(FIRST_RULES), "extended": Bonus(ALL_RULES), "max": Bonus(ALL_RULES, "max"), "intensity": Bonus(ALL_RULES, "intensity"), "full_gap": Bonus(ALL_RULES, budget=2.0),
    "connected": Bonus(ALL_RULES, budget=2.0, refined=tuple(r[0] for r in BROAD if r[1] == "ion")), "count": Bonus(ALL_RULES, budget=2.0, extra="counts"), "forward": Bonus(ALL_RULES, budget=2.0, extra="predicted"), "energy": Bonus(ALL_RULES, budget=2.0, extra="conditional"),
    "aromatic": Bonus(ALL_RULES, budget=2.0, refined=("benzyl_tropylium_ion", "benzoyl_ion", "benzoate_ion")),
}


def candidate_bonus(candidates: DataFrame, found: DataFrame, spectra: DataFrame, group: str, way: Bonus, weights: list[float]) -> DataFrame:
    """Candidates (group, key, score, counts, and predicted, conditional or sides if the way asks for them) with their scores raised: all their columns.

    counts are support()'s, in the way's order of rules; sides are
    connected_support()'s for the way "connected", exact_support()'s for
    "aromatic".  Scores never fall,
    and stay as they are for groups without evidence and candidates whose
    structure is unknown (null counts).
    """
    if len(weights) != way.dimension:
        raise ValueError(f"{way.dimension} weights are needed, not {len(weights)}")
    seen = channel_rows(pooled(found.where(F.col("rule").isin(*way.rules)), spectra, group, way.pooling), [group], list(way.rules))
    c, n = F.col("channels"), F.col("counts")
    has = F.transform(n, lambda k: (k > 0).cast("double"))
    evidence = compatibility(c, has)
    if way.refined:
        ions = [k == "ion" and r in way.refined for r in way.rules for k in KINDS]
        exact = F.array(*[F.col("sides")[i // len(KINDS)] if ion else F.lit(True) for i, ion in enumerate(ions)])
        evidence = F.zip_with(evidence, exact, lambda x, fine: F.when(fine, x).otherwise(0.0))
    if way.extra == "counts":
        evidence = F.concat(evidence, multiplicity(compatibility(c, has), n))
    elif way.extra == "predicted":
        evidence = F.concat(evidence, F.zip_with(c, "predicted", lambda x, p: x * F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))))
    elif way.extra == "conditional":
        evidence = F.concat(evidence, F.coalesce("conditional", F.transform(c, lambda x: F.lit(0.0))))
    rows = candidates.join(seen, group, "left")
    return rows.withColumn("score", F.when(c.isNotNull() & n.isNotNull(), bonus(F.col("score"), evidence, weights, way.budget)).otherwise(F.col("score"))).select(*candidates.columns)


def conditional(found: DataFrame, spectra: DataFrame, predicted: DataFrame, group: str, key: str, rules: list[str]) -> DataFrame:
    """Each spectrum's channels by those predicted for a candidate at the spectrum's conditions, cut to 0..1, summed over spectra and divided by the number of all the group's: (group, key, conditional).

    predicted is (spectrum, key, predicted); spectra without evidence or a
    prediction add nothing.
    """
    own = spectra.select("spectrum", group)
    n = own.groupBy(group).agg(F.count("*").alias("__n"))
    rows = channel_rows(strongest(found, ["spectrum"], ["rule", "kind"]), ["spectrum"], rules).join(own, "spectrum").join(predicted.select("spectrum", key, "predicted"), "spectrum")
    part = lambda i: F.sum(F.col("channels")[i] * F.least(F.greatest(F.get("predicted", F.lit(i)), F.lit(0.0)), F.lit(1.0)))
    total = rows.groupBy(group, key).agg(F.array(*[F.coalesce(part(i), F.lit(0.0)) for i in range(len(rules) * len(KINDS))]).alias("__s"))
    return total.join(n, group).select(group, key, F.transform("__s", lambda x: x / F.col("__n")).alias("conditional"))


def informative_row(df: DataFrame, group: str, intensities: str, content: list[str]) -> DataFrame:
    """Each group's row with the most effective peaks; ties by a hash of the content."""
    from pyspark.sql import Window

    from ..functions.hashing import signature
    from ..functions.peaks import effective_peaks

    order = [F.round(effective_peaks(F.col(intensities)), 9).desc(), signature(*[F.col(c) for c in content])]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("__n = 1").drop("__n")
