"""Evaluation: two rankings of parts per order's mass window, with the part of the first line as the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fold_of
from ..operators import catalog, evaluation, learning, proposals, range_join, ranking, router
from ..streaming import handoff
from .registry import Tables, query

# A customer's segment stands for a molecule; nations rank suppliers by balance (a) and by key (b); the truth is the supplier of the key a nation's name points at.
R = """sa as (select s_nationkey as grp, s_suppkey as key, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as rank from supplier),
    sb as (select s_nationkey as grp, s_suppkey as key, row_number() over (partition by s_nationkey order by s_name desc, s_suppkey) as rank from supplier),
    tr as (select s_nationkey as grp, max(s_suppkey) as key from supplier group by 1),
    pa as (select tr.grp, coalesce(sa.rank, 0) as rank, case when sa.rank <= 25 then 1.0 / sa.rank else 0.0 end as rr from tr left join sa on sa.grp = tr.grp and sa.key = tr.key and sa.rank <= 25),
    pb as (select tr.grp, coalesce(sb.rank, 0) as rank, case when sb.rank <= 25 then 1.0 / sb.rank else 0.0 end as rr from tr left join sb on sb.grp = tr.grp and sb.key = tr.key and sb.rank <= 25)"""


def ranked(t: Tables, score: str) -> DataFrame:
    s = t.supplier.select(F.col("s_nationkey").alias("group"), F.col("s_suppkey").alias("key"), F.col(score).alias("score"))
    return ranking.ranked(s, ["group"])


def truth(t: Tables) -> DataFrame:
    return t.supplier.groupBy(F.col("s_nationkey").alias("group")).agg(F.max("s_suppkey").alias("key"))


def per_key(t: Tables, score: str) -> DataFrame:
    return evaluation.per_key(ranked(t, score).select("group", "key", "rank"), truth(t), t.supplier.where("s_acctbal > 0").select(F.col("s_nationkey").alias("group"), F.col("s_suppkey").alias("key")))


COVERED = "cov as (select tr.grp, case when s_suppkey is null then 0 else 1 end as covered from tr left join supplier on s_suppkey = tr.key and s_nationkey = tr.grp and s_acctbal > 0)"


@query(
    f"""with {R}, {COVERED} select count(*) as molecules, round(avg(covered), 9) as candidate_recall, round(avg(rr), 9) as mrr25, round(avg(case when rank = 1 then 1 else 0 end), 9) as top1, round(avg(case when rank between 1 and 5 then 1 else 0 end), 9) as top5,
    round(avg(case when rank > 0 then 1 else 0 end), 9) as top25, round(avg(rr) filter (where covered = 1), 9) as conditional_mrr25 from pa join cov using (grp)"""
)
def metrics_mrr25(t: Tables) -> DataFrame:
    r = evaluation.report(per_key(t, "s_acctbal"))
    return r.select("molecules", *[F.round(c, 9).alias(c) for c in r.columns[1:]])


@query(
    f"""with {R}, {COVERED}, j as (select pa.*, covered, n_regionkey as region, substr(n_name, -1) as last from pa join cov using (grp) join nation on n_nationkey = grp)
    select dimension, value, count(*) as molecules, round(avg(rr), 9) as mrr25, round(avg(case when rank = 1 then 1 else 0 end), 9) as top1, round(avg(covered), 9) as candidate_recall
    from (select 'region' as dimension, cast(region as varchar) as value, * from j union all select 'last', last, * from j union all select 'covered', cast(covered as varchar), * from j) group by 1, 2"""
)
def metrics_grouping_sets(t: Tables) -> DataFrame:
    n = t.nation.select(F.col("n_nationkey").alias("group"), F.col("n_regionkey").alias("region"), F.substring("n_name", -1, 1).alias("last"))
    s = evaluation.strata(per_key(t, "s_acctbal").join(n, "group"), ["region", "last", "covered"])
    return s.select("dimension", "value", "molecules", *[F.round(c, 9).alias(c) for c in ("mrr25", "top1", "candidate_recall")])


@query(
    f"""with {R}, j as (select pa.grp, pa.rr as a, pb.rr as b, pb.rr - pa.rr as d, cast(cast(('0x' || substr(sha256('fold:' || cast(grp as varchar)), 1, 16)) as ubigint) % 5 as int) as fold from pa join pb using (grp))
    select fold, count(*) as molecules, round(avg(a), 9) as a, round(avg(b), 9) as b, round(avg(d), 9) as gain from j group by 1"""
)
def fold_summary(t: Tables) -> DataFrame:
    f = evaluation.folds(evaluation.paired(per_key(t, "s_acctbal"), per_key(t, "s_name"), "group"), fold_of(F.col("group")))
    return f.select("fold", "molecules", *[F.round(c, 9).alias(c) for c in ("a", "b", "gain")])


@query()
def bootstrap_ci(t: Tables) -> DataFrame:
    """Poisson weights from a hash of Spark's; rows only."""
    return evaluation.bootstrap(evaluation.paired(per_key(t, "s_acctbal"), per_key(t, "s_name"), "group"), "group")


@query(
    f"""with {R}, j as (select pa.grp, pa.rank as o, pb.rank as n, pa.rr as a, pb.rr as b, n_regionkey as region from pa join pb using (grp) join nation on n_nationkey = grp)
    select region, count(*) as molecules, count(*) filter (where b > a) as better, count(*) filter (where b < a) as worse, count(*) filter (where n = 1 and o <> 1) as top1_gained, count(*) filter (where o = 1 and n <> 1) as top1_lost, round(avg(b - a), 9) as change from j group by 1"""
)
def movement_strata(t: Tables) -> DataFrame:
    n = t.nation.select(F.col("n_nationkey").alias("group"), F.col("n_regionkey").alias("region"))
    pairs = per_key(t, "s_acctbal").select("group", F.col("rank").alias("old_rank")).join(per_key(t, "s_name").select("group", F.col("rank").alias("new_rank")), "group").join(n, "group")
    return evaluation.movement(pairs, ["region"]).withColumn("change", F.round("change", 9))


@query(
    f"""with {R}, {COVERED} select case when rank > 0 and rank <= 3 then 'ranked' when rank > 0 then 'scored_not_ranked' when covered = 1 then 'window_not_scored' else 'absent' end as reason, count(*) as rows from pa join cov using (grp) group by 1"""
)
def funnel_buckets(t: Tables) -> DataFrame:
    p = per_key(t, "s_acctbal")
    b = evaluation.bucket(F.when(F.col("rank") <= 3, F.col("rank")).otherwise(0), F.col("rank") > 0, F.col("covered") == 1, F.lit(False))
    return catalog.reason_counts(p.withColumn("reason", b))


@query(
    """select case when l_shipdate > o_orderdate + interval 90 day then 'late' when l_discount >= 0.09 then 'discounted' when l_quantity is null then 'unknown' else 'fine' end as reason, count(*) as rows from lineitem join orders on o_orderkey = l_orderkey group by 1"""
)
def failure_ladder(t: Tables) -> DataFrame:
    j = t.lineitem.select("l_orderkey", "l_shipdate", "l_discount", "l_quantity").join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    steps = [("late", F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 90 day")), ("discounted", F.col("l_discount") >= 0.09), ("unknown", F.col("l_quantity").isNull())]
    return catalog.reason_counts(evaluation.ladder(j, steps, "fine"))


@query("select l_returnflag, round(quantile_cont(l_extendedprice, 0.0), 4) as q0, round(quantile_cont(l_extendedprice, 0.25), 4) as q25, round(quantile_cont(l_extendedprice, 0.5), 4) as q50, round(quantile_cont(l_extendedprice, 0.75), 4) as q75, round(quantile_cont(l_extendedprice, 1.0), 4) as q100 from lineitem group by 1")
def quantile_summary(t: Tables) -> DataFrame:
    q = evaluation.quantiles(t.lineitem, "l_extendedprice", ["l_returnflag"])
    return q.select("l_returnflag", *[F.round(c, 4).alias(c) for c in q.columns[1:]])


@query("select cast(case when l_discount >= 0.075 then 3 when l_discount >= 0.05 then 2 when l_discount >= 0.025 then 1 else 0 end as int) as interval, count(*) as rows, count(*) filter (where l_returnflag = 'R') as events, round(avg(case when l_returnflag = 'R' then 1.0 else 0.0 end), 9) as rate from lineitem group by 1")
def bucket_association(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_discount", (F.col("l_returnflag") == "R").alias("event"))
    return evaluation.association(rows, "l_discount", "event", (0.0, 0.025, 0.05, 0.075)).withColumn("rate", F.round("rate", 9))


@query("select l_returnflag, count(*) filter (where l_tax > l_discount) as wins, count(*) filter (where l_tax < l_discount) as losses, count(*) filter (where l_tax = l_discount) as ties, bool_or(l_tax > l_discount) as any_win from lineitem group by 1")
def contrast_wins(t: Tables) -> DataFrame:
    return evaluation.contrast(t.lineitem, "l_discount", "l_tax", ["l_returnflag"])


@query("select o_orderpriority, string_agg(distinct o_orderstatus, '|' order by o_orderstatus) as statuses from orders group by 1")
def value_lists(t: Tables) -> DataFrame:
    return evaluation.value_lists(t.orders.select("o_orderpriority", F.col("o_orderstatus").alias("statuses")), ["o_orderpriority"], "statuses")


@query("select p_brand as name, count(*) as runs, round(avg(p_retailprice), 8) as mean, round(stddev_pop(p_retailprice), 8) as std from part group by 1")
def seed_summary(t: Tables) -> DataFrame:
    s = evaluation.seeds(t.part.withColumnRenamed("p_brand", "name"), ["name"], "p_retailprice")
    return s.select("name", "runs", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))


@query(
    """with m as (select p_brand as name, round(avg(p_retailprice) / 1000, 6) as mrr25, count(*) as parameters from part group by 1) select name, mrr25, parameters from m where mrr25 >= (select max(mrr25) from m) - 0.005 order by parameters, mrr25 desc, name limit 1"""
)
def model_selection(t: Tables) -> DataFrame:
    m = t.part.groupBy(F.col("p_brand").alias("name")).agg(F.round(F.avg("p_retailprice") / 1000, 6).alias("mrr25"), F.count("*").alias("parameters"))
    return evaluation.chosen(m)


GATE = [
    ("cohort_size_mismatch", "mn <> mo or xn <> xo"), ("nonfinite_metrics", "un is null or uo is null or isnan(un)"), ("invalid_metric_range", "not coalesce(un between 0 and 1, false) or not coalesce(kn between 0 and 1, false) or isnan(un)"), ("invalid_molecule_count", "least(mn, mo, xn, xo) < 1"),
    ("insufficient_development_molecules", "least(mn, mo) < 50"), ("absolute_gain_below_gate", "un - uo + 1e-12 < 0.01"), ("relative_gain_below_gate", "(case when uo > 0 then (un - uo) / uo when un - uo > 0 then 1 else 0 end) + 1e-12 < 0.05"),
    ("known_mrr_protection_failed", "kn + 1e-12 < ko - 0.02"), ("known_top1_protection_failed", "tn + 1e-12 < t_o - 0.1"), ("no_known_evaluation", "least(xn, xo) < 1"),
]


@query(
    f"""with g as (select c_custkey as id, c_custkey % 4 * 30 as mn, case when c_custkey % 9 = 0 then 30 else c_custkey % 4 * 30 end as mo, c_custkey % 7 * 10 as xn, case when c_custkey % 8 = 0 then 20 else c_custkey % 7 * 10 end as xo,
    case when c_custkey % 13 = 0 then null when c_custkey % 17 = 0 then 1.5 when c_custkey % 19 = 0 then 'nan'::double else (c_custkey * 7 % 101) / 100.0::double end as un, (c_custkey * 3 % 101) / 100.0::double as uo,
    case when c_custkey % 23 = 0 then -0.1::double else (c_custkey * 5 % 101) / 100.0::double end as kn, (c_custkey * 11 % 101) / 100.0::double as ko, (c_custkey * 13 % 101) / 100.0::double as tn, (c_custkey * 17 % 101) / 100.0::double as t_o from customer)
    select id, array_to_string(list_filter([{', '.join(f"case when coalesce({c}, false) then '{n}' end" for n, c in GATE)}], lambda x: x is not null), ';') as reasons, round(case when uo - ko <> 0.1 and (ko - uo) / (0.1 - (uo - ko)) between 0 and 1 then (ko - uo) / (0.1 - (uo - ko)) end, 8) as even from g"""
)
def development_gate(t: Tables) -> DataFrame:
    """Every reason that rejects a system, over metrics that are missing, out of range and odd as well; and the share at which changes cancel."""
    k = F.col("c_custkey")
    part = lambda m: (k * m % 101) / 100
    un = F.when(k % 13 == 0, None).when(k % 17 == 0, 1.5).when(k % 19 == 0, float("nan")).otherwise(part(7))
    row = {
        "unknown_molecules_new": k % 4 * 30, "unknown_molecules_old": F.when(k % 9 == 0, 30).otherwise(k % 4 * 30), "known_molecules_new": k % 7 * 10, "known_molecules_old": F.when(k % 8 == 0, 20).otherwise(k % 7 * 10),
        "unknown_mrr_new": un, "unknown_mrr_old": part(3), "known_mrr_new": F.when(k % 23 == 0, -0.1).otherwise(part(5)), "known_mrr_old": part(11), "unknown_top1_new": part(19), "unknown_top1_old": part(2), "known_top1_new": part(13), "known_top1_old": part(17),
    }
    reasons = evaluation.gate(row, {"molecules": 50, "absolute": 0.01, "relative": 0.05, "known_mrr": 0.02, "known_top1": 0.1})
    return t.customer.select(k.alias("id"), F.array_join(reasons, ";").alias("reasons"), F.round(evaluation.break_even(part(3) - part(11), F.lit(0.1)), 8).alias("even"))


@query("with b as (select count(distinct p_brand) as before from part where p_size < 10), a as (select count(distinct p_brand) as after from part), u as (select count(distinct p_brand) as truths from part) select truths, before, after from a, b, u")
def catalog_coverage(t: Tables) -> DataFrame:
    return catalog.coverage(t.part.where("p_size < 10"), t.part, t.part, "p_brand")


@query(
    f"""with {R}, x as (select grp, key, 1.0::double + rank * pow(2.0, -52) * 3 as a from sa where rank <> 2), y as (select grp, key, case when rank % 5 = 0 then -1.0 * pow(2.0, -1074) * rank else 1.0::double + rank * pow(2.0, -52) end as b from sb where rank <> 3)
    select coalesce(x.grp, y.grp) as grp, coalesce(x.key, y.key) as key, a, b, a is not distinct from b as same,
    case when a is null or b is null then null when b < 0 then 1022 * 4503599627370496 + cast(round((a - 1) * pow(2.0, 52)) as bigint) + 4503599627370496 + cast(round(-b * pow(2.0, 537) * pow(2.0, 537)) as bigint) else cast(abs(round((a - b) * pow(2.0, 52))) as bigint) end as ulps from x full join y on x.grp = y.grp and x.key = y.key"""
)
def score_differences(t: Tables) -> DataFrame:
    """Scores a few doubles from one, and some of the smallest ones below zero, with the number of doubles between them."""
    step = lambda e: F.pow(F.lit(2.0), F.lit(float(e)))
    r = F.col("rank").cast("double")
    a = ranked(t, "s_acctbal").where("rank <> 2").select(F.col("group").alias("grp"), "key", (1.0 + r * step(-52) * 3).alias("score"))
    b = ranked(t, "s_name").where("rank <> 3").select(F.col("group").alias("grp"), "key", F.when(F.col("rank") % 5 == 0, -step(-1074) * r).otherwise(1.0 + r * step(-52)).alias("score"))
    return evaluation.score_differences(a, b, ["grp", "key"])


@query("select user_id, event_type, min(ts) as start, count(*) as n from (select *, time_bucket(interval 1 day, ts) as d from events) group by user_id, event_type, d having count(*) >= 5")
def busy_days(t: Tables) -> DataFrame:
    """An extension: windows of event time over a batch."""
    day = F.date_trunc("day", "ts")
    return t.events.groupBy("user_id", "event_type", day.alias("d")).agg(F.min("ts").alias("start"), F.count("*").alias("n")).where("n >= 5").drop("d")


@query("select cast(time_bucket(interval 1 hour, ts) as timestamp) as start, event_type, count(*) as n from events group by 1, 2")
def event_windows(t: Tables) -> DataFrame:
    return handoff.windowed_counts(t.events, "ts", ["event_type"])


@query(
    """with g as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 12 hour or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events),
    s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as sid from g) select user_id, min(ts) as start, max(ts) + interval 12 hour as "end", count(*) as n from s group by user_id, sid"""
)
def event_sessions(t: Tables) -> DataFrame:
    return handoff.sessions(t.events, "ts", "user_id", "12 hours")


@query()
def router_logistic_oof(t: Tables) -> DataFrame:
    """Reliability of labels by document features, out of fold."""
    d = t.documents.select("doc_id", F.log1p(F.col("n_chars").cast("double")).alias("length"), (F.size(F.split("text", " ")) / F.greatest(F.col("n_chars"), F.lit(1))).cast("double").alias("density"), F.size(F.split("text", "\n")).cast("double").alias("lines"))
    rows = d.join(t.labels.select("doc_id", "quality"), "doc_id")
    return router.out_of_fold(rows, "doc_id", ["length", "density", "lines"], "quality").select("doc_id", "fold", F.round("reliability", 6).alias("reliability"))


@query(
    """with r as (select c_custkey, round((c_acctbal + 1000) / 11000, 6) as confidence, (c_custkey % 10) / 10.0 as reliability from customer), p(name, threshold, guard) as (values ('t0.3_g0.5', 0.3, 0.5), ('t0.3_g0.9', 0.3, 0.9), ('t0.7_g0.5', 0.7, 0.5), ('t0.7_g0.9', 0.7, 0.9))
    select name, case when confidence >= guard or reliability >= threshold then 'historical' else 'neural' end as action, count(*) as n from r, p group by 1, 2"""
)
def router_policies(t: Tables) -> DataFrame:
    r = t.customer.select("c_custkey", F.round((F.col("c_acctbal") + 1000) / 11000, 6).alias("confidence"), ((F.col("c_custkey") % 10) / 10).alias("reliability"))
    return router.actions(r, router.policy_grid(t.spark, [0.3, 0.7], [0.5, 0.9])).groupBy("name", "action").agg(F.count("*").alias("n"))


@query("select 'p_retailprice' as \"column\", round(avg(p_retailprice), 8) as mean, round(greatest(stddev_pop(p_retailprice), 1), 8) as std from part union all select 'p_size', round(avg(p_size), 8), round(greatest(stddev_pop(p_size), 1), 8) from part")
def standardization(t: Tables) -> DataFrame:
    s = router.standardized(t.part, ["p_retailprice", "p_size"])
    return s.select("column", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))


@query(
    """with m as (select avg(l_quantity) as a, avg(l_discount) as b, avg(l_tax) as c, avg(l_extendedprice / 1e5) as d, var_pop(l_quantity) + 0.01 as aa, var_pop(l_discount) + 0.01 as bb, covar_pop(l_quantity, l_discount) as ab,
      covar_pop(l_quantity, l_tax) as ac, covar_pop(l_discount, l_tax) as bc, covar_pop(l_quantity, l_extendedprice / 1e5) as ad, covar_pop(l_discount, l_extendedprice / 1e5) as bd from lineitem),
    w as (select *, (bb * ac - ab * bc) / (aa * bb - ab * ab) as t1, (aa * bc - ab * ac) / (aa * bb - ab * ab) as t2, (bb * ad - ab * bd) / (aa * bb - ab * ab) as p1, (aa * bd - ab * ad) / (aa * bb - ab * ab) as p2 from m)
    select l_orderkey, l_linenumber, round(greatest(0, least(1, c - t1 * a - t2 * b + t1 * l_quantity + t2 * l_discount)), 8) as tax, round(greatest(0, least(1, d - p1 * a - p2 * b + p1 * l_quantity + p2 * l_discount)), 8) as price from lineitem, w"""
)
def ridge_targets(t: Tables) -> DataFrame:
    """Two targets by one penalised fit with free intercepts, predicted for every row."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("a"), F.col("l_discount").cast("double").alias("b"), F.col("l_tax").cast("double").alias("c"), (F.col("l_extendedprice") / 1e5).cast("double").alias("d"))
    fit = learning.ridge(rows, ["a", "b"], ["c", "d"])
    return rows.select("l_orderkey", "l_linenumber", F.round(fit.predicted(0), 8).alias("tax"), F.round(fit.predicted(1), 8).alias("price"))


@query(
    """select 0 as i, 0 as j, round(sum(l_quantity * l_quantity), 2) as value from lineitem union all select 0, 1, round(sum(l_quantity * l_discount), 2) from lineitem union all select 1, 1, round(sum(l_discount * l_discount), 2) from lineitem
    union all select 0, -1, round(sum(l_quantity * l_tax), 2) from lineitem union all select 1, -1, round(sum(l_discount * l_tax), 2) from lineitem"""
)
def ridge_moments(t: Tables) -> DataFrame:
    return router.ridge_moments(t.lineitem, ["l_quantity", "l_discount"], "l_tax").withColumn("value", F.round("value", 2))


@query(
    """with c as (select s_suppkey as grp, round(900 + abs(s_acctbal) % 100, 6) as center from supplier), h as (select grp, p_partkey as formula, p_size as score from c join part on abs(p_retailprice - center) <= 0.3),
    r as (select *, row_number() over (partition by grp order by score desc, formula) as rank from h) select grp, formula, rank from r where rank <= 5"""
)
def mass_proposals(t: Tables) -> DataFrame:
    c = t.supplier.select(F.col("s_suppkey").alias("grp"), F.round(900 + F.abs("s_acctbal") % 100, 6).alias("center"))
    f = t.part.select(F.col("p_partkey").alias("formula"), F.col("p_retailprice").alias("mass"), F.col("p_size").alias("score"))
    return proposals.mass_proposals(c, f, "grp", floor=0.3).select("grp", "formula", F.col("rank").cast("long").alias("rank"))


@query(
    """with b as (select p_brand, max(p_size) as s from part group by 1), c as (select p_brand, w.c as w, x.c as x, y.c as y, z.c as z, -(abs(w.c - s % 8) + abs(x.c - (s + 1) % 8) + abs(y.c - (s + 2) % 8) + abs(z.c - (s + 3) % 8)) / 2.0::double as score from b, range(8) w(c), range(8) x(c), range(8) y(c), range(8) z(c)),
    r as (select *, row_number() over (partition by p_brand order by score desc, w, x, y, z) as k from c) select p_brand, score, concat_ws(',', w, x, y, z) as counts from r where k <= 5"""
)
def formula_beam(t: Tables) -> DataFrame:
    """The best count vectors of brands, by sums of log probabilities, against all vectors in SQL."""
    logp = F.array(*[F.array(*[-F.abs(c - (F.col("s") + e) % 8) / 2.0 for c in range(8)]) for e in range(4)])  # no lambda: Spark does not hand those to a UDF
    beams = t.part.groupBy("p_brand").agg(F.max("p_size").alias("s")).select("p_brand", proposals.beam_column(logp, 5).alias("b")).select("p_brand", F.explode("b").alias("b"))
    return beams.select("p_brand", "b.score", F.array_join(F.transform("b.counts", lambda x: x.cast("string")), ",").alias("counts"))


@query(
    """with e as (select l_orderkey as grp, l_linenumber as rank, l_partkey as key from lineitem), o as (select grp, key, min(rank) as rank from e group by 1, 2) select count(*) as rows, sum(case when rank = 1 then 1 else 0 end) as leaders from o"""
)
def exploded_rankings(t: Tables) -> DataFrame:
    """Lists to rows and back: distinct keys of every order at their first place."""
    l = t.lineitem.groupBy(F.col("l_orderkey").alias("grp")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))  # noqa: E741
    rows = ranking.exploded(l.select("grp", F.transform("l", lambda x: x["l_linenumber"]).alias("ranks"), F.transform("l", lambda x: x["l_partkey"]).alias("ranking")), ["grp"])
    firsts = t.lineitem.groupBy(F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("key")).agg(F.min("l_linenumber").alias("rank"))
    return rows.select("grp", "key").distinct().join(firsts, ["grp", "key"]).agg(F.count("*").alias("rows"), F.count_if(F.col("rank") == 1).alias("leaders"))


@query("select a.s_suppkey as key, b.p_partkey as other from supplier a join part b on abs(b.p_retailprice - (900 + abs(a.s_acctbal) % 100)) <= greatest((900 + abs(a.s_acctbal) % 100) * 35e-6, 0.006)")
def admissible_negatives(t: Tables) -> DataFrame:
    a = t.supplier.select(F.col("s_suppkey").alias("key"), (900 + F.abs("s_acctbal") % 100).alias("mass"))
    b = t.part.select(F.col("p_partkey").alias("other"), F.col("p_retailprice").alias("m2"))
    near = range_join.band_join(a, b, F.col("mass") - 0.1, F.col("mass") + 0.1, F.col("m2"), 0.1)
    return near.where(range_join.admissible(F.col("mass"), F.col("m2"))).select("key", "other")
