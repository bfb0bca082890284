"""Bonuses: broad evidence of users' events, pooled over spectra, for the structures of parts by the motifs they have; records of variants; scores admitted for reuse."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mass
from ..lineage import settled
from ..operators import evidence, retrieval, scorers
from .registry import Tables, query
from .spectra import P, relative, spectra_of
from .structures import STRUCTURES, whole

GROUPS = 20
RULES = [*evidence.RULES, *evidence.BROAD]


def _mass(formula: str) -> float:
    return sum(mass.ATOMIC_MASS[e] * int(n or 1) for e, n in re.findall("([A-Z][a-z]?)([0-9]*)", formula))


#: Every rule that a protonated molecule may use, numbered among all.
RULE_ROWS = ", ".join(f"('{r[0]}', '{r[1]}', {_mass(r[2]) + r[3]!r}::double, {i})" for i, r in enumerate(RULES) if "positive" in r[4] and "[M+H]+" in r[5])
FOUND = f"""{P}, rel as (select spectrum, mz, i / max(i) over (partition by spectrum) as intensity, row_number() over (partition by spectrum order by mz, event_id) - 1 as at_ from p where i > 0),
    rules(rule, way, m, r) as (values {RULE_ROWS}), pr as (select * from rel, rules),
    found as (select spectrum, rule, r, 0 as j, sqrt(intensity) as strength from pr where way = 'ion' and abs(mz - m) <= greatest(0.02, m * 10e-6)
      union all select spectrum, rule, r, 1, sqrt(intensity) from pr where way = 'loss' and 400 > mz and abs(400 - mz - m) <= 0.02 + greatest(0.02, mz * 10e-6)
      union all select a.spectrum, a.rule, a.r, 2, sqrt(least(a.intensity, b.intensity)) from pr a join rel b on a.spectrum = b.spectrum and b.at_ > a.at_ and a.way = 'loss' and abs(b.mz - (a.mz + a.m)) <= greatest(0.02, a.mz * 10e-6) + greatest(0.02, (a.mz + a.m) * 10e-6)),
    top as (select spectrum, rule, r, j, max(strength) as s from found group by all), n as (select spectrum % {GROUPS} as grp, count(distinct spectrum) as n from p group by 1),
    pooled as (select grp, rule, r, j, max(s) as largest, sum(s) / any_value(n) as mean, sum(s * s) / any_value(n) as intensity from top join n on grp = spectrum % {GROUPS} group by all)"""


def grouped(t: Tables) -> DataFrame:
    return spectra_of(t).withColumn("grp", F.col("spectrum") % GROUPS)


def broad(t: Tables) -> DataFrame:
    """All rules' matches, held for the several ways in which they are pooled."""
    return settled(evidence.matches(spectra_of(t), relative(t), evidence.rule_table(t.spark, RULES), absolute=0.02).select("spectrum", "rule", "kind", "strength"))


@query(f"with {FOUND} select grp, rule, case j when 0 then 'ion' when 1 then 'precursor_loss' else 'peak_loss' end as kind, round(largest, 8) as largest, round(mean, 8) as mean, round(intensity, 8) as intensity from pooled")
def broad_evidence(t: Tables) -> DataFrame:
    """Twenty rules' evidence over groups of spectra, pooled in three ways."""
    f, s, on = broad(t), grouped(t), ["grp", "rule", "kind"]
    parts = [evidence.pooled(f, s, "grp", how).withColumnRenamed("strength", name) for how, name in (("max", "largest"), ("mean", "mean"), ("intensity", "intensity"))]
    return parts[0].join(parts[1], on).join(parts[2], on).select(*on, *[F.round(c, 8).alias(c) for c in ("largest", "mean", "intensity")])


#: How often structures with each end have a motif; those of a methyl next to the end only in the shortest chain.
OF_ENDS = {
    "water": {0: 1, 3: 1}, "ammonia": {2: 1}, "carbon_monoxide": {3: 1}, "carbon_dioxide": {3: 1}, "phenyl_ion": {1: 1, 9: 2}, "benzyl_tropylium_ion": {1: 1, 9: 2}, "sulfur_dioxide": {6: 1}, "methanol": {0: 1}, "acetic_acid": {3: 1},
}
COUNT_ROWS = ", ".join(f"('{rule}', {e}, {n}, {str(rule in ('methanol', 'acetic_acid')).lower()})" for rule, ends in OF_ENDS.items() for e, n in ends.items())
COUNTS = f"{STRUCTURES}, oe(rule, e, n, shortest) as (values {COUNT_ROWS}), cn as (select k, rule, n from st join oe using (e) where fault = 0 and (extra = 0 or not shortest))"


@query(f"with {COUNTS} select k, {', '.join(f'cast(coalesce(max(n) filter (where rule = {r!r}), 0) as int) as {r}' for r in evidence.ALL_RULES)} from st left join cn using (k) where fault = 0 group by k")
def structure_motifs(t: Tables) -> DataFrame:
    """How often each structure has the motif of each rule."""
    c = whole(t).select("k", evidence.support(F.col("g"), list(evidence.ALL_RULES)).alias("c"))
    return c.select("k", *[F.col("c")[i].alias(r) for i, r in enumerate(evidence.ALL_RULES)])


def rising(way: evidence.Bonus) -> list[float]:
    """Weights that use the whole budget, each larger than the one before."""
    n = way.dimension
    return [way.budget * (i + 1) * 2 / (n * (n + 1)) for i in range(n)]


def _w(budget: float, n: int, i: str) -> str:
    return f"({budget}::double * ({i} + 1) * 2 / {n * (n + 1)})"


I, PREDICTED = "(3 * r + j)", "least(1, greatest(0, (k + 3 * r + j) % 7 / 5.0::double - 0.2::double))"
DELTAS = {
    "first": f"case when n > 0 and r < 8 then mean * {_w(0.05, 24, I)} end", "extended": f"case when n > 0 then mean * {_w(0.05, 60, I)} end", "max": f"case when n > 0 then largest * {_w(0.05, 60, I)} end",
    "intensity": f"case when n > 0 then intensity * {_w(0.05, 60, I)} end", "full_gap": f"case when n > 0 then mean * {_w(2.0, 60, I)} end",
    "count": f"case when n > 0 then mean * ({_w(2.0, 120, I)} + (n - 1) / (n + 1)::double * {_w(2.0, 120, f'(60 + {I})')}) end",
    "forward": f"mean * (case when n > 0 then {_w(2.0, 120, I)} else 0 end + {PREDICTED} * {_w(2.0, 120, f'(60 + {I})')})",
}


@query(
    f"""with {FOUND}, {COUNTS}, d as (select k, {', '.join(f'sum({sql}) as d_{name}' for name, sql in DELTAS.items())} from (select st.k, pooled.*, cn.n from st join pooled on grp = k % {GROUPS} left join cn on cn.k = st.k and cn.rule = pooled.rule where fault = 0) group by k)
    select k, {', '.join(f'round(k % 100 / 100.0::double + coalesce(d_{name}, 0), 8) as {name}' for name in DELTAS)} from st left join d using (k) where fault = 0"""
)
def bonus_scores(t: Tables) -> DataFrame:
    """Structures' scores after seven ways of rewarding the evidence that their motifs support."""
    f, s = broad(t), grouped(t)
    counts = evidence.support(F.col("g"), list(evidence.ALL_RULES))
    predicted = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: (F.col("k") + i) % 7 / 5.0 - 0.2)
    rows = settled(whole(t).select((F.col("k") % GROUPS).alias("grp"), "k", (F.col("k") % 100 / 100.0).alias("score"), counts.alias("counts"))).withColumn("predicted", predicted)
    out = rows.select("grp", "k")
    for name in DELTAS:
        way = evidence.BONUSES[name]
        scored = evidence.candidate_bonus(rows, f, s, "grp", way, rising(way))
        out = out.join(scored.select("grp", "k", F.round("score", 8).alias(name)), ["grp", "k"])
    return out.drop("grp")


ION_ROWS = ", ".join(f"({i}, '{name}', {n}, {z}, {_mass(more) - _mass(less) + p * mass.PROTON + e * mass.ELECTRON!r}::double)" for i, (name, (n, z, more, less, p, e)) in enumerate(mass.IONS.items()))


@query(f"with ions(i, adduct, n, z, shift) as (values {ION_ROWS}) select p_partkey as key, adduct, round(case when (z * (p_retailprice - 880) - shift) / n > 0 then (z * (p_retailprice - 880) - shift) / n end, 7) as neutral from part left join ions on i = p_partkey % {len(mass.IONS) + 1}")
def ion_table_masses(t: Tables) -> DataFrame:
    """Prices as m/z, read by the table of ions; every thirtieth part has an ion that the table doesn't know."""
    names = F.array(*[F.lit(a) for a in mass.IONS])
    p = t.part.select(F.col("p_partkey").alias("key"), F.get(names, (F.col("p_partkey") % (len(mass.IONS) + 1)).cast("int")).alias("adduct"), (F.col("p_retailprice") - 880).alias("mz"))
    return p.select("key", "adduct", F.round(mass.ion_table_mass(F.col("adduct"), F.col("mz")), 7).alias("neutral"))


FLAGS = ["A", "N", "R"]


@query(
    f"""with v as (select l_suppkey as grp, l_returnflag as variant, l_partkey as key, max(l_extendedprice) as score from lineitem group by all), o as (select *, row_number() over (partition by grp, variant order by score desc, key) as i from v),
    m as (select grp, {', '.join(f"string_agg(cast(key as varchar), ';' order by i) filter (where variant = '{m}' and i <= 5) as {m.lower()}" for m in FLAGS)}, max(score) filter (where variant = 'N' and i = 1) as best, max(score) filter (where variant = 'N' and i = 2) as second, count(distinct key) as candidates from o group by grp)
    select grp, {', '.join(f"coalesce({m.lower()}, '') as {m.lower()}" for m in FLAGS)}, round(coalesce(best, 0), 4) as confidence, round(coalesce(best, 0) - coalesce(second, 0), 4) as margin, candidates, grp % 3 = 0 as known from m"""
)
def variant_records(t: Tables) -> DataFrame:
    """Suppliers' parts by the lines' flags as the variants of a ranking, a record each."""
    v = t.lineitem.groupBy(F.col("l_suppkey").alias("grp"), F.col("l_returnflag").alias("variant"), F.col("l_partkey").alias("key")).agg(F.max("l_extendedprice").alias("score"))
    known = t.supplier.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("grp"))
    r = retrieval.records(v, known, "grp", "key", "N", 5)
    of = lambda m: F.coalesce(F.array_join(F.try_element_at("rankings", F.lit(m)), ";"), F.lit("")).alias(m.lower())
    return r.select("grp", *[of(m) for m in FLAGS], F.round("confidence", 4).alias("confidence"), F.round("margin", 4).alias("margin"), "candidates", "known")


@query(
    """with s as (select l_orderkey as context, l_linenumber as key, case when l_quantity = 50 then 'nan'::double else l_discount end as score from lineitem), c as (select distinct l_orderkey as context, l_linenumber as key from lineitem where l_linenumber <= 6),
    f as (select s.context, bool_or(c.key is null) as foreign_, bool_or(isnan(score)) as odd, count(*) as rows, sum(score) as total from s left join c using (context, key) group by 1)
    select o_orderkey as context, case when o_orderstatus <> 'F' then 'incomplete' when foreign_ then 'unknown_candidate' when odd then 'invalid_score' else 'admitted' end as outcome, case when o_orderstatus = 'F' and not foreign_ and not odd then rows else 0 end as scores,
      case when o_orderstatus = 'F' and not foreign_ and not odd then round(total, 6) end as total from orders join f on context = o_orderkey"""
)
def scores_admitted(t: Tables) -> DataFrame:
    """Orders as results of a scorer, their lines as scores: whole results enter, or none of their scores."""
    complete = F.when(F.col("o_orderstatus") == "F", "complete").otherwise("running")
    results = t.orders.select(F.col("o_orderkey").alias("context"), complete.alias("status"))
    scores = t.lineitem.select(F.col("l_orderkey").alias("context"), F.col("l_linenumber").alias("key"), F.when(F.col("l_quantity") == 50, float("nan")).otherwise(F.col("l_discount").cast("double")).alias("score"))
    candidates = t.lineitem.where("l_linenumber <= 6").select(F.col("l_orderkey").alias("context"), F.col("l_linenumber").alias("key"))
    fine, outcome = scorers.admitted(results, scores, candidates)
    totals = fine.groupBy("context").agg(F.count("*").alias("n"), F.sum("score").alias("t"))
    answered = outcome.join(scores.select("context").distinct(), "context", "left_semi")
    return answered.join(totals, "context", "left").select("context", "outcome", F.coalesce("n", F.lit(0)).alias("scores"), F.round("t", 6).alias("total"))
