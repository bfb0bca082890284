"""Scalar functions over parts, each with one of a few written-out values, and over documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, mass, peaks
from ..functions import text as tx
from ..operators import cohort, ranking
from .registry import Tables, query

FORMULAS = ["C6H12O6", "H2O", "CH4", "NaCl", "C10H16N5O13P3", "C8H10N4O2", "BrCl", "Xx2", "c6", "C6H12O6-", "", "C0", "C2H6OSi"]
ADDUCTS = [("[M+H]+", 301.1), ("[M-H]-", 301.1), ("[M+2H]2+", 151.0), ("[M+3H]3+", 101.0), ("[2M+Na]+", 623.0), ("[2M-H]-", 599.0), ("[M]+", 300.0), ("[M-2H2O+H]+", 265.0), ("[Cat]2+", 300.0), ("[M]0+", 300.0), ("unknown", 300.0), ("[M+Xx]+", 300.0), ("[M+H]+", 0.5)]
SMILES = ["CC(=O)Oc1ccccc1C(=O)O", "C[C@@H](N)C(=O)O", "[Na+].[Cl-]", "BrCCl", "C%10CCCCC%10", "[se]1cccc1"]
INSTRUMENTS = ["Q-TOF", "Orbitrap", "Q Exactive", "ion trap", None, "LC-FT", "timsTOF", "", "QqQ"]
ATOMS = ", ".join(f"('{k}', {v!r})" for k, v in mass.ATOMIC_MASS.items())


def values(rows: list, kind: str = "varchar") -> str:
    show = lambda x: f"cast(null as {kind})" if x is None else repr(x) if not isinstance(x, str) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(show(x) for x in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)


def fed(t: Tables, rows: list, columns: list[str]) -> DataFrame:
    """Every part's key with the one of the rows that its key points at."""
    each = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(columns, r if isinstance(r, tuple) else (r,), strict=True)]) for r in rows])
    return t.part.select(F.col("p_partkey").alias("key"), F.get(each, (F.col("p_partkey") % len(rows)).cast("int")).alias("x")).select("key", "x.*")


def _fed(sql: str, rows: list, columns: list[str]) -> str:
    """The SQL of one value's results, for every part."""
    numbered = values([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)])
    same = " and ".join(f"q.{c} is not distinct from lit.{c}" for c in columns)
    return f"with q as ({sql}), lit(i, {', '.join(columns)}) as (values {numbered}) select p_partkey as key, q.* from part join lit on i = p_partkey % {len(rows)} join q on {same}"


MASS = f"""atoms(el, am) as (values {ATOMS}), f(formula) as (values {values(FORMULAS)}),
    p as (select formula, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)', 1)) as el, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)', 2)) as ct from f where regexp_full_match(formula, '([A-Z][a-z]?[0-9]*)+')),
    m as (select formula, case when count(*) = count(am) then sum(am * case when ct = '' then 1 else cast(ct as int) end) end as mass from p left join atoms using (el) group by 1)"""


@query(_fed(f"with {MASS} select f.formula, round(mass, 8) as mass from f left join m using (formula)", FORMULAS, ['formula']))
def formula_mass_parse(t: Tables) -> DataFrame:
    df = fed(t, FORMULAS, ["formula"])
    return df.select("key", "formula", F.round(mass.formula_mass(F.col("formula")), 8).alias("mass"))


@query(_fed(f"""with f(formula) as (values {values(FORMULAS)}), p as (select formula, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)', 1)) as el, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)', 2)) as ct
    from f where formula in ('C6H12O6', 'H2O', 'CH4', 'NaCl', 'C10H16N5O13P3', 'C8H10N4O2', 'BrCl', 'C0', 'C2H6OSi')), c as (select formula, el, case when ct = '' then 1 else cast(ct as int) end as n from p)
    select formula, cast(coalesce(sum(n) filter (where el = 'C'), 0) as int) as carbons, cast(coalesce(sum(n) filter (where el = 'H'), 0) as int) as hydrogens, cast(coalesce(sum(n) filter (where el = 'O'), 0) as int) as oxygens from c group by 1
    union all select formula, null, null, null from f where formula not in (select formula from p)""", FORMULAS, ['formula']))
def formula_count_vectors(t: Tables) -> DataFrame:
    v = mass.formula_counts(F.col("formula"))
    df = fed(t, FORMULAS, ["formula"]).withColumn("v", v)
    at = {e: i for i, e in enumerate(mass.HILL)}
    return df.select("key", "formula", F.col("v")[at["C"]].alias("carbons"), F.col("v")[at["H"]].alias("hydrogens"), F.col("v")[at["O"]].alias("oxygens"))


H, NA, O2, E = mass.ATOMIC_MASS["H"], mass.ATOMIC_MASS["Na"], mass.ATOMIC_MASS["O"], mass.ELECTRON


@query(_fed(f"""with a(adduct, mz) as (values {values(ADDUCTS)}), i(adduct, molecules, charge, shift) as (values ('[M+H]+', 1, 1, {H - E!r}), ('[M-H]-', 1, -1, {-H + E!r}), ('[M+2H]2+', 1, 2, {2 * H - 2 * E!r}), ('[M+3H]3+', 1, 3, {3 * H - 3 * E!r}),
    ('[2M+Na]+', 2, 1, {NA - E!r}), ('[2M-H]-', 2, -1, {-H + E!r}), ('[M]+', 1, 1, {-E!r}), ('[M-2H2O+H]+', 1, 1, {H - 2 * (2 * H + O2) - E!r}))
    select adduct, mz, molecules, charge, round(shift, 9) as shift, round(case when (abs(charge) * mz - shift) / molecules > 0 then (abs(charge) * mz - shift) / molecules end, 7) as neutral from a left join i using (adduct)""", ADDUCTS, ['adduct', 'mz']))
def adduct_parse(t: Tables) -> DataFrame:
    df = fed(t, ADDUCTS, ["adduct", "mz"]).withColumn("ion", mass.parse_adduct(F.col("adduct")))
    return df.select("key", "adduct", "mz", "ion.molecules", "ion.charge", F.round("ion.shift", 9).alias("shift"), F.round(mass.ion_neutral_mass(F.col("ion"), F.col("mz")), 7).alias("neutral"))


@query(_fed(f"with a(adduct, mz) as (values {values(ADDUCTS)}), i(adduct, shift) as (values {values(list(mass.ADDUCT_MASS.items()))}) select adduct, mz, round(mz - shift, 7) as neutral from a left join i using (adduct)", ADDUCTS, ['adduct', 'mz']))
def table_neutral_mass(t: Tables) -> DataFrame:
    df = fed(t, ADDUCTS, ["adduct", "mz"])
    return df.select("key", "adduct", "mz", F.round(mass.table_neutral_mass(F.col("adduct"), F.col("mz")), 7).alias("neutral"))


@query(_fed(f"""with s(smiles) as (values {values(SMILES)}), k as (select smiles, regexp_extract_all(smiles, '(\\[[^\\]]+\\]|Br|Cl|Si|Na|Li|Ca|Mg|Al|Se|se|@@|%[0-9][0-9]|.)', 1) as tok from s)
    select smiles, len(tok) as n, array_to_string(tok, ' ') as tokens from k""", SMILES, ['smiles']))
def smiles_tokenizer(t: Tables) -> DataFrame:
    tok = tx.smiles_tokens(F.col("smiles"))
    return fed(t, SMILES, ["smiles"]).select("key", "smiles", F.size(tok).cast("long").alias("n"), F.array_join(tok, " ").alias("tokens"))


@query(_fed(f"""with i(name) as (values {values(INSTRUMENTS)}) select name, regexp_matches(regexp_replace(lower(coalesce(name, '')), '[- ]', '', 'g'), 'qtof|orbitrap|qexactive|ft|timstof|toftime') as high, coalesce(nullif(name, ''), '<missing>') as category,
    trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as slug from i""", INSTRUMENTS, ['name']))
def instrument_predicates(t: Tables) -> DataFrame:
    df = fed(t, INSTRUMENTS, ["name"])
    c = F.col("name")
    return df.select("key", "name", tx.high_resolution(c).alias("high"), tx.category(c).alias("category"), tx.slug(c).alias("slug"))


SPLIT = "cast(('0x' || substr(sha256('42:' || cast(doc_id as varchar)), 1, 16)) as ubigint) % 10000"


@query(f"select doc_id, case when {SPLIT} < 8000 then 'train' when {SPLIT} < 9000 then 'dev' else 'holdout' end as split, cast(cast(('0x' || substr(sha256('fold:' || cast(doc_id as varchar)), 1, 16)) as ubigint) % 5 as int) as fold from documents")
def hash_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", hashing.split_of(F.col("doc_id")).alias("split"), hashing.fold_of(F.col("doc_id")).alias("fold"))


@query(
    """with n as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as i, count(*) over (partition by user_id) as c from events)
    select user_id, event_id from n where i = cast(('0x' || substr(sha256('single:' || cast(user_id as varchar)), 1, 16)) as ubigint) % c"""
)
def single_pick(t: Tables) -> DataFrame:
    return ranking.single_pick(t.events.select("user_id", "event_id"), "user_id", "event_id")


@query(
    """with n as (select user_id, event_id, row_number() over (partition by user_id order by cast(('0x' || substr(sha256('sample:' || cast(user_id as varchar) || ':' || cast(event_id as varchar)), 1, 16)) as ubigint), event_id) as i from events)
    select user_id, event_id from n where i <= 4"""
)
def hash_sample4(t: Tables) -> DataFrame:
    """A deterministic sample in place of a reservoir that depends on the scan's order."""
    return ranking.hash_sample(t.events.select("user_id", "event_id"), "user_id", "event_id", 4)


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderkey % 10 = 0) order by cast(('0x' || substr(sha256('cohort:' || cast(c_custkey as varchar)), 1, 16)) as ubigint), c_custkey limit 100")
def cohort_draw(t: Tables) -> DataFrame:
    """A hundred fresh keys by the order of their digests."""
    return cohort.drawn(t.customer, [t.orders.where("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("c_custkey"))], "c_custkey", 100, "cohort:")


@query("with u as (select distinct o_custkey as k from orders) select count(*) as keys, count(k) as repeated, count(*) - count(k) as fresh from customer left join u on k = c_custkey")
def cohort_usage(t: Tables) -> DataFrame:
    return cohort.usage(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(
    """with e as (select user_id, list(value order by event_id) as v from events group by 1), k as (select user_id, list_sort(list_distinct(v)) as s from e)
    select user_id, len(s) as n, s[1] as lowest, s[-1] as highest from k"""
)
def energy_signatures(t: Tables) -> DataFrame:
    e = t.events.groupBy("user_id").agg(F.collect_list("value").alias("v")).withColumn("s", tx.energy_signature(F.col("v")))
    return e.select("user_id", F.size("s").cast("long").alias("n"), F.element_at("s", 1).alias("lowest"), F.element_at("s", -1).alias("highest"))


@query(
    """with e as (select user_id, max(value) as precursor, list(value) filter (where event_type = 'view') as ce from events group by 1)
    select user_id, precursor, round(coalesce(list_aggregate(ce, 'avg'), 0), 8) as energy_mean, coalesce(list_aggregate(ce, 'min'), 0) as energy_min, coalesce(list_aggregate(ce, 'max'), 0) as energy_max, case when ce is null then 1.0 else 0.0 end as no_energy from e"""
)
def numeric_metadata(t: Tables) -> DataFrame:
    e = t.events.groupBy("user_id").agg(F.max("value").alias("p"), F.collect_list(F.when(F.col("event_type") == "view", F.col("value"))).alias("ce"))
    m = e.select("user_id", tx.numeric_metadata(F.col("p"), F.col("ce")).alias("m"))
    return m.select("user_id", "m.precursor", F.round("m.energy_mean", 8).alias("energy_mean"), "m.energy_min", "m.energy_max", "m.no_energy")


@query(
    """with u as (select user_id, event_type, sum(value) as v from events group by 1, 2), s as (select user_id, v / sum(v) over (partition by user_id) as p from u)
    select user_id, round(exp(-sum(case when p > 0 then p * ln(p) else 0 end)), 8) as effective from s group by 1"""
)
def effective_peaks(t: Tables) -> DataFrame:
    u = t.events.groupBy("user_id", "event_type").agg(F.sum("value").alias("v")).groupBy("user_id").agg(F.collect_list("v").alias("v"))
    return u.select("user_id", F.round(peaks.effective_peaks(F.col("v")), 8).alias("effective"))


@query("select count(*) as rows, count(distinct doc_id) as ids, count(distinct source) as sources from documents")
def distinct_counts(t: Tables) -> DataFrame:
    return t.documents.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids"), F.countDistinct("source").alias("sources"))


@query()
def table_identity(t: Tables) -> DataFrame:
    """The same for the same rows in any order; by Spark's own hash, so rows only."""
    return hashing.table_identity(t.lineitem)


@query("select json_extract_string(props, '$.k') as k, count(*) as n, round(avg(value), 8) as mean from events group by 1")
def json_fields(t: Tables) -> DataFrame:
    k = F.from_json("props", "k string")["k"].alias("k")
    return t.events.groupBy(k).agg(F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean"))
