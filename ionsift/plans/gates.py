"""Branches, gates, promotions and audits over the lists of fusing.py, with scores that come from the keys themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lists
from ..operators import catalog, cohort, evaluation, ranking, router, scorers
from ..sources import sinks
from ..streaming import handoff
from .fusing import KEYS, LISTS, base, text, three_lists
from .registry import ORACLE_SQL, Tables, query


def _a() -> Column:
    return F.col("a")


def _b() -> Column:
    return F.col("b")


def _c() -> Column:
    return F.col("c")



def fr(k: str) -> str:
    """SQL of a key's fragment score; keys divisible by five have none, which counts as 0."""
    return f"(case when cast({k} as int) % 5 = 0 then 0.0::double else (cast({k} as int) * 7 % 13) / 10.0::double end)"


def cr(k: str) -> str:
    return f"((cast({k} as int) * 5 % 11) / 10.0::double)"


def scores(t: Tables) -> DataFrame:
    """The three lists with maps of their keys' scores: fr without the keys divisible by five, cr of all; ``late`` for some groups."""
    keys = F.array_distinct(F.concat(_a(), _b(), _c()))
    n = lambda k: k.cast("int")
    known = F.filter(keys, lambda k: n(k) % 5 != 0)
    maps = {"fr": F.map_from_arrays(known, F.transform(known, lambda k: (n(k) * 7 % 13) / 10)), "cr": F.map_from_arrays(keys, F.transform(keys, lambda k: (n(k) * 5 % 11) / 10))}
    return three_lists(t).withColumns({**maps, "late": F.col("grp").endswith("3")})


def named(r: Column, other: str) -> list[Column]:
    return [text(r["ranking"]).alias("ranking"), text(r[other]).alias(other)]


S = f"{LISTS}, s as (select *, list_slice(b, 1, 6) as p, grp like '%3' as late from l)"
NOVEL = "list_slice(list_filter({new}, lambda x: not list_contains({base}, x)), 1, {slots})"


def ins(base_: str, new: str, prefix: int = 3, slots: int = 3) -> str:
    return f"list_concat(list_slice({base_}, 1, {prefix}), {NOVEL.format(new=new, base=base_, slots=slots)}, list_slice({base_}, {prefix + 1}, 1000))"


def informative(p: str) -> str:
    v = f"list_transform({p}, lambda x: {fr('x')})"
    return f"(len({p}) > 1 and list_max({v}) > 0 and list_max({v}) > list_min({v}) and {v}[1] > 0)"


@query(
    f"""with {S}, g as (select *, not late and {informative('p')} and {fr('p[1]')} > {fr('a[1]')} and {cr('p[1]')} > {cr('a[1]')} + 0.05::double as fine from s),
    r as (select *, {ins('a', 'p')} as n from g) select grp, case when fine then 'low_supported_leader_first' when late then 'fragment_budget_fallback' else 'fragment_evidence_fallback' end as status,
    array_to_string(case when fine then list_concat([p[1]], list_filter(n, lambda x: x <> p[1])) else a end, ';') as ranking, array_to_string(case when fine then list_slice(p, 1, 3) else [] end, ';') as inserted from r"""
)
def low_branch(t: Tables) -> DataFrame:
    """The branch of low confidence: proposals enter where fragments and critic agree on the first."""
    r = scores(t).select("grp", lists.low_fragment(_a(), lists.take(_b(), 6), F.col("cr"), F.col("fr"), F.col("late"), True).alias("r"))
    return r.select("grp", "r.status", *named(F.col("r"), "inserted"))


HIGH = "case when late then 'high_fragment_budget_keep_tail' when not info then 'high_fragment_evidence_keep_tail' when {yes} then 'high_fragment_inserted' else 'high_fragment_remove_tail' end as status"


@query(
    f"""with {S}, g as (select *, {informative('p')} as info, {fr('p[1]')} > {fr('a[1]')} and {cr('p[1]')} > {cr('a[1]')} + 0.05::double as better from s) select grp, {HIGH.format(yes='better')},
    array_to_string(case when late or not info then c when better then {ins('a', 'p')} else a end, ';') as ranking, array_to_string(case when late or not info then list_slice(b, 1, 3) when better then list_slice(p, 1, 3) else [] end, ';') as inserted from g"""
)
def high_branch(t: Tables) -> DataFrame:
    """The branch of high confidence: the tail stays, proposals enter, or neither."""
    r = scores(t).select("grp", lists.high_fragment(_a(), _c(), lists.take(_b(), 6), _b(), F.col("cr"), F.col("fr"), F.col("late")).alias("r"))
    return r.select("grp", "r.status", *named(F.col("r"), "inserted"))


def _individual_sql(prefix: int, slots: int) -> str:
    strong = f"list_filter(p, lambda x: {fr('x')} > {fr('a[1]')} and {cr('x')} > {cr('a[1]')} + 0.05::double)"
    return f"""with {S}, g as (select *, {informative('p')} as info, {strong} as strong from s) select grp, {HIGH.format(yes='len(strong) > 0')},
    array_to_string(case when late or not info then c when len(strong) > 0 then {ins('a', 'strong', prefix, slots)} else a end, ';') as ranking,
    array_to_string(case when late or not info then list_slice(b, 1, {slots}) when len(strong) > 0 then list_slice(strong, 1, {slots}) else [] end, ';') as inserted from g"""


def _individual(t: Tables, prefix: int, slots: int) -> DataFrame:
    r = scores(t).select("grp", lists.individual_fragment(_a(), _c(), lists.take(_b(), 6), _b(), F.col("cr"), F.col("fr"), F.col("late"), slots, prefix).alias("r"))
    return r.select("grp", "r.status", *named(F.col("r"), "inserted"))


@query(_individual_sql(3, 3))
def individual_gates(t: Tables) -> DataFrame:
    """The gate of the high branch for each proposal on its own."""
    return _individual(t, 3, 3)


@query(_individual_sql(1, 5))
def individual_gates_deep(t: Tables) -> DataFrame:
    """The same with five slots behind the first place."""
    return _individual(t, 1, 5)


DEEP = "greatest(1, case when list_contains(c, a[3]) then 3 when list_contains(c, a[2]) then 2 else 1 end)"


@query(
    f"""with {S}, g as (select *, cast(a[1] as int) % 5 = 0 or cast(a[2] as int) % 5 = 0 or cast(a[3] as int) % 5 = 0 or late as unknown, greatest({fr('a[1]')}, {fr('a[2]')}, {fr('a[3]')}) as level, {DEEP} as deep from s),
    h as (select *, {fr('p[1]')} <= level as gate, list_filter(list_slice(p, 1, 3), lambda x: {fr('x')} > level and {cr('x')} > {cr('a[1]')} + 0.05::double) as strong from g)
    select grp, case when unknown then 'strong_original_evidence_fallback' when gate then 'strong_original_gate_fallback' else 'high_strong_slot_inserted' end as status,
    array_to_string(case when unknown or gate then b else list_concat(list_slice(a, 1, deep), list_slice(list_filter(strong, lambda x: not list_contains(a, x)), 1, 3), list_slice(a, deep + 1, 1000)) end, ';') as ranking,
    array_to_string(case when unknown or gate then [] else strong end, ';') as inserted from h"""
)
def strong_slot_choice(t: Tables) -> DataFrame:
    """Proposals stronger than the first three originals, behind the deepest observed of those."""
    r = scores(t).select("grp", lists.strong_slots(_a(), _b(), lists.take(_b(), 6), F.col("cr"), F.col("fr"), F.col("fr"), F.col("late"), _c()).alias("r"))
    return r.select("grp", "r.status", *named(F.col("r"), "inserted"))


@query(
    f"""with {S}, g as (select *, greatest({fr('a[1]')}, {fr('a[2]')}, {fr('a[3]')}, 0) as level, list_concat(list_slice(a, 1, 3), p, list_slice(a, 4, 100)) as cur from s),
    h as (select *, list_filter(p, lambda x: not late and {fr('x')} > level and {cr('x')} > {cr('a[1]')} + 0.05::double) as sup from g)
    select grp, array_to_string(list_concat(sup, list_filter(list_distinct_in_order, lambda x: not list_contains(sup, x))), ';') as ranking, array_to_string(sup, ';') as supported from (select *, list_filter(cur, lambda x, i: list_position(cur, x) = i) as list_distinct_in_order from h)"""
)
def supported_promotion(t: Tables) -> DataFrame:
    """Added keys that beat the first three originals move to the front."""
    current = F.array_distinct(F.concat(lists.take(_a(), 3), lists.take(_b(), 6), lists.rest(_a(), 3)))
    r = scores(t).select("grp", lists.supported_promoted(_a(), current, lists.take(_b(), 6), F.col("cr"), F.col("fr"), F.col("late")).alias("r"))
    return r.select("grp", *named(F.col("r"), "supported"))


@query(
    f"""with {S}, g as (select grp, a, late, list_filter(p, lambda x: not list_contains(a, x)) as nw from s), h as (select *, {ins('a', 'nw')} as fine from g),
    k as (select *, list_slice(nw, 1, 3) as used, case when late then list_concat(['zzz'], fine) else fine end as sel from h)
    select grp, case when late or len(used) = 0 then null else array_to_string(list_concat([used[1]], list_filter(sel, lambda x: x <> used[1])), ';') end as ranking from k"""
)
def leader_promotion(t: Tables) -> DataFrame:
    """The first key inserted behind three moved to the head; null where the list did not come about that way."""
    chosen = lists.inserted(_a(), lists.take(_b(), 6), 3, 3)
    selected = F.when(F.col("late"), F.concat(F.array(F.lit("zzz")), chosen)).otherwise(chosen)
    return scores(t).select("grp", text(lists.leader_promoted(_a(), selected)).alias("ranking"))


@query(
    f"""with {S} select grp, list_max(list_transform(p, lambda x: {cr('x')})) > {cr('a[1]')} + 0.5::double as critic, array_to_string(list_filter(p, lambda x: {fr('x')} > 0 and {cr('x')} > {cr('a[1]')} + 0.05::double), ';') as supported,
    array_to_string(list_filter(p, lambda x: {fr('x')} > greatest(0, {fr('a[1]')})), ';') as relative, {informative('p')} as informative,
    case when not list_contains(c, a[1]) then 1 else 2 end as first1, case when not list_contains(c, a[1]) then 0 else 2 end as first0, 1 as prefix1, 2 as baseline,
    case when len(nw) > 0 and {cr('nw[1]')} > {cr('a[1]')} + 0.2::double then 0 else 3 end as promotion from (select *, list_filter(p, lambda x: not list_contains(a, x)) as nw from s)"""
)
def gate_values(t: Tables) -> DataFrame:
    """The single gates and prefixes: critic, supported proposals by either rule, informative fragments, expanded and promotion prefixes."""
    p, first = lists.take(_b(), 6), F.get(_a(), F.lit(0))
    names = {"first1": "unsupported_first1", "first0": "unsupported_first0", "prefix1": "expanded_prefix1", "baseline": "baseline"}
    return scores(t).select(
        "grp", lists.critic_gate(p, F.col("cr"), first, 0.5).alias("critic"), text(lists.supported(p, F.col("cr"), first, F.col("fr"), 0.05)).alias("supported"), text(lists.relatively_supported(p, F.col("fr"), first)).alias("relative"),
        lists.informative(p, F.col("fr")).alias("informative"), *[lists.expanded_prefix(_a(), _c(), v).alias(n) for n, v in names.items()], lists.promotion_prefix(_a(), p, F.col("cr"), 3, 0.2).alias("promotion"),
    )


def _rerank_array_sql(keys: str, score, weight: float, name: str) -> str:
    """CTEs that rerank an array column ``keys`` of table ``name``_in (grp, keys) by a score; ends in {name} (grp, ranking)."""
    return f"""{name}_e as (select grp, unnest({keys}) as k, generate_subscripts({keys}, 1) as i from {name}_in), {name}_s as (select *, {score('k')} as e from {name}_e),
    {name}_p as (select *, rank() over (partition by grp order by e desc) as place, min(e) over (partition by grp) = max(e) over (partition by grp) as tied from {name}_s),
    {name} as (select grp, list(k order by round(case when tied then 1.0 / (60 + i) else {1 - weight} / (60 + i) + {weight} / (60 + place) end, 12) desc, i) as ranking from {name}_p group by 1)"""


@query(
    f"""with {S}, f_in as (select grp, list_filter(b, lambda x: not list_contains(a, x)) as keys from s), {_rerank_array_sql('keys', fr, 0.5, 'f')}
    select grp, array_to_string(list_concat(list_slice(a, 1, 3), list_slice(coalesce(ranking, []), 1, 5), list_slice(a, 4, 100)), ';') as ranking from s left join f using (grp)"""
)
def fragment_ranked_slots(t: Tables) -> DataFrame:
    """Novel candidates reranked by fragments among themselves before five of them are inserted."""
    return scores(t).select("grp", text(lists.fragment_ranked_insert(_a(), _b(), F.col("fr"), 0.5)).alias("ranking"))


@query(
    f"""with {S}, e as (select grp, unnest(a) as k, generate_subscripts(a, 1) as i, list_slice(b, 1, 8) as g from s), q as (select *, list_contains(g, k) as gen, {fr('k')} + 0.15::double * {cr('k')} as v from e),
    pl as (select grp, i, row_number() over (partition by grp order by i) as j from q where not gen), it as (select grp, k, row_number() over (partition by grp order by round(v, 12) desc, i) as j from q where not gen),
    o as (select grp, i, k from pl join it using (grp, j) union all select grp, i, k from q where gen) select grp, string_agg(k, ';' order by i) as ranking from o group by 1"""
)
def popularity_slots(t: Tables) -> DataFrame:
    """Pool items permuted by z and popularity; generated ones keep their places."""
    return scores(t).select("grp", text(lists.popularity_reranked(_a(), lists.take(_b(), 8), F.col("fr"), F.col("cr"))).alias("ranking"))


@query(f"with {S} select grp, array_to_string(case when late then a else b end, ';') as final from s")
def deadline_fallback(t: Tables) -> DataFrame:
    """Rankings that came too late give way to the original."""
    rows = scores(t).select("grp", _a().alias("original"), _b().alias("ranking"), F.col("late").alias("expired"))
    return handoff.settled(rows).select("grp", text(F.col("final")).alias("final"))


@query(
    f"""with {S}, v as (select *, (cast(a[1] as int) % 90 + 1) / 100.0 as conf, len(a) + len(b) as n from s) select grp, round(0.02 / greatest(conf, 1e-6), 9) as relative_margin, round(ln(1 + n), 9) as log_candidates, 0.0 as center,
    round(-(0.25 * ln(0.25) + 0.75 * ln(0.75) + 2 * 0.5 * ln(0.5) + 0.75 * ln(0.75) + 0.25 * ln(0.25)) / 3, 9) as entropy, 1.5 as expected_bits, {cr('b[1]')} as neural_top, round({cr('b[1]')} - {cr('b[2]')}, 9) as neural_margin,
    round(coalesce(1.0 / nullif(list_position(b, a[1]), 0), 0), 9) as historical_in_neural, round(coalesce(1.0 / nullif(list_position(a, b[1]), 0), 0), 9) as neural_in_historical, round(coalesce(1.0 / nullif(list_position(c, b[1]), 0), 0), 9) as neural_in_union,
    case when a[1] = b[1] then 1.0 else 0.0 end as same_first, len(list_intersect(list_slice(a, 1, 5), list_slice(b, 1, 5))) / 5.0 as overlap5, len(list_intersect(list_slice(a, 1, 25), list_slice(b, 1, 25))) / 25.0 as overlap25 from v"""
)
def router_features(t: Tables) -> DataFrame:
    """What the router sees of a molecule's rankings, scores and probabilities."""
    n = lambda c: c.cast("int")
    rows = scores(t).select(
        "grp", ((n(_a()[0]) % 90 + 1) / 100).alias("confidence"), F.lit(0.02).alias("margin"), (F.size(_a()) + F.size(_b())).alias("candidates"), F.lit(3).alias("spectra"), F.lit(20.0).alias("mean_peaks"), F.lit(None).cast("double").alias("center"),
        F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)).alias("probabilities"), _a().alias("historical"), _b().alias("neural"), _c().alias("union"), F.transform(_b(), lambda k: (n(k) * 5 % 11) / 10).alias("neural_scores"),
    )
    f = router.features(rows)
    names = [c for c in router.FEATURES if c not in ("confidence", "margin", "spectra", "mean_peaks")]
    return f.select("grp", *[F.round(c, 9).alias(c) for c in names])


@query(
    f"""with {KEYS}, s as (select grp, key, size, n, row_number() over (partition by grp order by size desc, n, key) as rank from base), f as (select grp, min(key) as lowest, arg_min(key, struct_pack(a := n, b := key)) as first from base group by 1)
    select s.grp, s.key, s.rank, f.first as representative from s join f using (grp) where rank <= 5"""
)
def stable_ranks(t: Tables) -> DataFrame:
    """Ranks whose ties keep an input order, and each group's first row in another."""
    rows = base(t).withColumn("order", F.row_number().over(_window("n", "key")))
    r = ranking.stably_ranked(rows, ["grp"], "order", "size").where("rank <= 5").select("grp", "key", F.col("rank").cast("long").alias("rank"))
    return r.join(ranking.representative(base(t), ["grp"], [F.col("n"), F.col("key")]).select("grp", F.col("key").alias("representative")), "grp")


def _window(*order: str):
    from pyspark.sql import Window

    return Window.partitionBy("grp").orderBy(*order)


@query(
    f"""with {LISTS}, j as (select substr(grp, 7, 1) as stratum, list_slice(a, 1, 5) as x, case when grp like '%4' then list_slice(a, 1, 5) else list_slice(b, 1, 5) end as y from l),
    v as (select stratum, len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) as s from j) select stratum, count(*) as pairs, round(avg(s), 9) as mean_jaccard, count(*) filter (where s = 1) as same, count(*) filter (where s > 0 and s < 1) as partial, count(*) filter (where s = 0) as disjoint from v group by 1"""
)
def pair_stability(t: Tables) -> DataFrame:
    """How far pairs of sets agree, by stratum."""
    first = lists.take(_a(), 5)
    rows = three_lists(t).select(F.substring("grp", 7, 1).alias("stratum"), first.alias("x"), F.when(F.col("grp").endswith("4"), first).otherwise(lists.take(_b(), 5)).alias("y"))
    return evaluation.stability(rows, ["stratum"], "x", "y").withColumn("mean_jaccard", F.round("mean_jaccard", 9))


@query(
    """with r as (select p_brand as brand, p_size > 5 as s1, p_size > 5 and p_retailprice > 920 as s2, p_size > 12 and p_retailprice > 920 as s3 from part) select brand, count(*) as molecules, count(*) filter (where s1) as n_window, count(*) filter (where not s1) as lost_window,
    count(*) filter (where s2) as n_scored, count(*) filter (where s1 and not s2) as lost_scored, count(*) filter (where s3) as n_ranked, count(*) filter (where s2 and not s3) as lost_ranked from r group by 1"""
)
def stage_retention(t: Tables) -> DataFrame:
    """How many truths each stage holds and loses."""
    size, price = F.col("p_size"), F.col("p_retailprice") > 920
    return evaluation.retention(t.part.withColumnRenamed("p_brand", "brand"), ["brand"], {"window": size > 5, "scored": (size > 5) & price, "ranked": (size > 12) & price})


@query(
    """with o as (select s_suppkey as key, s_suppkey * 7 % 1000 as position from supplier), p as (select s_suppkey as key from supplier where s_nationkey < 10 union all select s_suppkey from supplier where s_nationkey >= 10 and s_nationkey < 20)
    select o.key, position, count(p.key) as count from o left join p using (key) group by 1, 2"""
)
def merged_parts(t: Tables) -> DataFrame:
    """Parts of a cohort back in its order, with what is missing."""
    s = t.supplier.select(F.col("s_suppkey").alias("key"), "s_nationkey")
    parts = [s.where("s_nationkey < 10").select("key"), s.where("s_nationkey >= 10 and s_nationkey < 20").select("key")]
    return cohort.merge_in_order(parts, s.select("key", (F.col("key") * 7 % 1000).alias("position")), "key", "position")


@query(
    """with old as (select distinct c_custkey as key from customer where c_custkey % 10 = 0), f as (select c_custkey as key, row_number() over (order by cast(('0x' || substr(sha256('ext:' || cast(c_custkey as varchar)), 1, 16)) as ubigint), c_custkey) as i from customer where c_custkey % 10 <> 0)
    select key, 'old' as part from old union all select key, 'new' from f where i <= 40"""
)
def cohort_extension(t: Tables) -> DataFrame:
    """The old sample exactly, and forty keys more by their digests."""
    keys = t.customer.select(F.col("c_custkey").alias("key"))
    old = keys.where("key % 10 = 0")
    all_ = cohort.extended(old, keys, "key", 40, "ext:")
    return all_.withColumn("part", F.when(F.col("key") % 10 == 0, "old").otherwise("new"))


@query(
    """with q as (select o_orderkey as id, o_custkey % 100 as k from orders), c as (select distinct c_custkey % 100 as k from customer where c_custkey % 100 < 60) select count(*) filter (where k in (select k from c)) as answered, count(*) filter (where k not in (select k from c)) as open from q"""
)
def reused_scores(t: Tables) -> DataFrame:
    """Requests that earlier scores answer, and those they don't."""
    requests = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("k"))
    cache = t.customer.select((F.col("c_custkey") % 100).alias("k")).where("k < 60").distinct().withColumn("score", F.lit(1.0))
    done, open_ = scorers.reused(requests, cache, ["k"])
    return done.agg(F.count("*").alias("answered")).crossJoin(F.broadcast(open_.agg(F.count("*").alias("open"))))  # one row each


@query("select n_nationkey as key, n_name, n from nation join (select s_nationkey as n_nationkey, count(*) as n from supplier group by 1) using (n_nationkey)")
def validated_merge(t: Tables) -> DataFrame:
    """A join whose keys are checked to be unique on both sides."""
    n = t.supplier.groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").alias("n"))
    return catalog.merged_one_to_one(t.nation.select(F.col("n_nationkey").alias("key"), "n_name"), n, ["key"])


GEN = """g as (select l_orderkey as grp, l_partkey % 20 as key, l_quantity as lp, l_linestatus = 'O' as ended, l_returnflag <> 'R' as parses, l_shipmode_ as mode, 100.0 + l_suppkey % 3 as mass from (select *, l_linenumber as l_shipmode_ from lineitem)),
    w as (select *, ended as s1, ended and parses as s2, ended and parses and mode <> 3 as s3, ended and parses and mode <> 3 and abs(mass - 101) <= greatest(101 * 35e-6, 0.006) as s4 from g)"""


def _generated(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("grp"), (F.col("l_partkey") % 20).alias("key"), F.col("l_quantity").alias("lp"), (F.col("l_linestatus") == "O").alias("ended"), (F.col("l_returnflag") != "R").alias("parses"),
        F.col("l_linenumber").alias("mode"), (100.0 + F.col("l_suppkey") % 3).alias("mass"),
    )
    stages = [("terminated", F.col("ended")), ("parsed", F.col("parses")), ("single", F.col("mode") != 3)]
    return catalog.generated_funnel(rows, "grp", "key", F.col("mass"), F.lit(101.0), "lp", stages)


@query(f"with {GEN} select grp, count(*) as generated, count(*) filter (where s1) as terminated, count(*) filter (where s2) as parsed, count(*) filter (where s3) as single, count(*) filter (where s4) as in_window, count(distinct key) filter (where s4) as kept from w group by 1")
def generated_funnel_counts(t: Tables) -> DataFrame:
    """How many generated candidates reach each check."""
    return _generated(t)[1]


@query(f"with {GEN} select grp, key, max(lp) as lp, count(*) as samples from w where s4 group by 1, 2")
def generated_funnel_kept(t: Tables) -> DataFrame:
    """The best of each key that passes all checks, with the number of its samples."""
    return _generated(t)[0].select("grp", "key", "lp", "samples")


@query(
    """with m as (select c_custkey as key from customer), r as (select o_custkey as key, max(case when o_orderkey % 7 = 0 then 0 else 1 end) as n from orders where o_custkey % 3 > 0 group by 1 union all select -s_suppkey - 1, 1 from supplier)
    select key, 'missing' as problem from m where key not in (select key from r) union all select key, 'unexpected' from r where key not in (select key from m) union all select key, 'empty' from r where n = 0 and key in (select key from m)"""
)
def unanswered_molecules(t: Tables) -> DataFrame:
    """Molecules without a ranking, rankings without a molecule, and empty rankings."""
    given = t.orders.where("o_custkey % 3 > 0").groupBy(F.col("o_custkey").alias("key")).agg(F.max(F.when(F.col("o_orderkey") % 7 == 0, 0).otherwise(1)).alias("n"))
    stray = t.supplier.select((-F.col("s_suppkey") - 1).alias("key"), F.lit(1).alias("n"))
    rankings = given.unionByName(stray).select("key", F.when(F.col("n") > 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("ranking"))
    return catalog.unanswered(t.customer.select(F.col("c_custkey").alias("key")), rankings, "key")


@query("select distinct s_nationkey as key from supplier where s_acctbal > 0 and s_nationkey in (select c_nationkey from customer where c_mktsegment = 'BUILDING' and c_acctbal > 9000)")
def leaked_keys(t: Tables) -> DataFrame:
    """Keys in both parts of a split."""
    a, b = t.supplier.where("s_acctbal > 0").select(F.col("s_nationkey").alias("key")), t.customer.where("c_mktsegment = 'BUILDING' and c_acctbal > 9000").select(F.col("c_nationkey").alias("key"))
    return catalog.overlap(a, b, "key")



def _joint_sql(prefix: str, strong: str) -> str:
    used = "list_slice(list_filter(list_slice({0}, 1, 3), lambda x: not list_contains(a, x)), 1, 3)".format(strong)
    return f"array_to_string(case when fine then list_concat(list_slice(a, 1, {prefix}), {used}, list_slice(a, {prefix} + 1, 1000)) else c end, ';')"


@query(
    f"""with {S}, g as (select *, greatest({fr('a[1]')}, {fr('a[2]')}, {fr('a[3]')}) as level, {DEEP} as deep, cast(a[1] as int) % 5 = 0 or cast(a[2] as int) % 5 = 0 or cast(a[3] as int) % 5 = 0 as unknown from s),
    h as (select *, not late and not unknown and {fr('p[1]')} > level as fine, list_filter(p, lambda x: {fr('x')} > level and {cr('x')} > {cr('a[1]')} + 0.05::double) as strong from g)
    select grp, fine as promoted, {_joint_sql('1', 'p')} as original_evidence, {_joint_sql('deep', 'p')} as joint_evidence, {_joint_sql('deep', 'strong')} as backfill from h"""
)
def slot_variants(t: Tables) -> DataFrame:
    """Promotions that ask the first three originals' evidence: behind the first place, behind the observed prefix, and with a critic."""
    p, deep = lists.take(_b(), 6), lists.supported_prefix(_a(), _c())
    args = (_a(), _c(), p, F.col("fr"), F.col("fr"), F.col("late"))
    r = scores(t).select("grp", lists.joint_slots(*args).alias("x"), lists.joint_slots(*args, deep).alias("y"), lists.joint_slots(*args, deep, F.col("cr")).alias("z"))
    return r.select("grp", "x.promoted", text(F.col("x.ranking")).alias("original_evidence"), text(F.col("y.ranking")).alias("joint_evidence"), text(F.col("z.ranking")).alias("backfill"))


@query(
    f"""with {S}, e as (select grp, unnest(p) as k, generate_subscripts(p, 1) as i from s), q as (select *, row_number() over (partition by grp order by {cr('k')} desc, k) as j from e),
    o as (select grp, list(k order by round(0.5 / (60 + i) + 0.5 / (60 + j), 12) desc, k) as o from q group by 1), g as (select *, {cr('o[1]')} > {cr('a[1]')} + 0.05::double as promoted from s join o using (grp))
    select grp, promoted, array_to_string(case when promoted then {ins('a', 'o', 10, 3)} else c end, ';') as ranking from g"""
)
def score_fused_tail(t: Tables) -> DataFrame:
    """Proposals by their order and the critic's together, behind ten places."""
    r = scores(t).select("grp", lists.fused_tail(_a(), _c(), lists.take(_b(), 6), F.col("cr")).alias("r"))
    return r.select("grp", "r.promoted", text(F.col("r.ranking")).alias("ranking"))


@query(
    f"""with {S}, f_in as (select grp, list_filter(b, lambda x: not list_contains(list_slice(a, 1, 10), x)) as keys from s), {_rerank_array_sql('keys', cr, 0.25, 'f')} select grp, coalesce(array_to_string(ranking, ';'), '') as ranking from s left join f using (grp)"""
)
def evidence_order(t: Tables) -> DataFrame:
    """Keys that a ranking's head lacks, reranked by evidence among themselves."""
    return scores(t).select("grp", text(lists.evidence_order(_b(), lists.take(_a(), 10), F.col("cr"), 0.25)).alias("ranking"))


TWIN = "case when late then list_concat([a[1]], b) else list_concat([a[1], '7' || a[1]], list_slice(b, 1, 3)) end"


@query(
    f"""with {S}, x as (select grp, a, {TWIN} as e, list_transform(a, lambda t: substr(t, -2)) as ks from s), y as (select *, list_filter(list_slice(e, 1, 3), lambda t: substr(t, -2) <> ks[1])[1] as o from x),
    z as (select *, substr(o, -2) as kx, list_position(ks, substr(o, -2)) as at_, list_filter(a, lambda t: substr(t, -2) <> substr(o, -2)) as others from y)
    select grp, case when o is null then 'same_as_rank1' when at_ = 2 then 'already_rank2' else 'inserted' end as status,
    array_to_string(case when o is null then a else list_slice(list_concat(list_slice(others, 1, 1), case when at_ = 2 then [a[2]] else [o] end, list_slice(others, 2, 100)), 1, 25) end, ';') as ranking from z"""
)
def runner_up_insert(t: Tables) -> DataFrame:
    """Where another engine's first value is the head's twin, its next distinct one comes second."""
    twin = F.concat(F.array(_a()[0], F.concat(F.lit("7"), _a()[0])), lists.take(_b(), 3))
    e = F.when(F.col("late"), F.concat(F.array(_a()[0]), _b())).otherwise(twin)
    r = scores(t).select("grp", lists.runner_up(_a(), e, lambda v: F.substring(v, -2, 2)).alias("r"))
    return r.select("grp", "r.status", text(F.col("r.ranking")).alias("ranking"))


@query(
    """with g as (select c_custkey as id, case c_custkey % 3 when 0 then 'confidence_guarded' when 1 then 'historical_hybrid' else 'neural' end as m, case when c_custkey % 7 = 0 then null else c_custkey % 2 = 0 end as ok, c_custkey % 4 as n, (c_custkey % 11) / 10.0 as h, (c_custkey % 5) / 5.0 as b, case when c_custkey % 5 = 0 then null else c_custkey % 13 > 2 end as k from customer),
    t as (select id, m, case when m = 'confidence_guarded' and not coalesce(ok, false) then 'no_passing_report' when m <> 'neural' then null when not coalesce(k, true) then 'known_spectrum_failure' when n > 0 and h <= b then 'not_above_baseline' end as note from g)
    select id, case when note = 'no_passing_report' then 'refused' when note is not null then 'historical_hybrid' else m end as mode, note from t"""
)
def deployment_gate(t: Tables) -> DataFrame:
    """What of a frozen system may be deployed."""
    k = F.col("c_custkey")
    mode = F.when(k % 3 == 0, "confidence_guarded").when(k % 3 == 1, "historical_hybrid").otherwise("neural")
    d = evaluation.deployment(mode, F.when(k % 7 != 0, k % 2 == 0), k % 4, (k % 11) / 10, (k % 5) / 5, F.when(k % 5 != 0, k % 13 > 2))
    return t.customer.select(k.alias("id"), d.alias("d")).select("id", "d.mode", "d.note")


@query(f"select status, count(*) as molecules, count(*) filter (where inserted <> '') as changed, min(grp) as first from ({ORACLE_SQL['low_branch']}) group by 1")
def branch_audit(t: Tables) -> DataFrame:
    """The branches taken, counted beside the rankings from one computation."""
    _, audit = sinks.audited(low_branch(t), ["status"], molecules=F.count("*"), changed=F.count_if(F.col("inserted") != ""), first=F.min("grp"))
    return audit
