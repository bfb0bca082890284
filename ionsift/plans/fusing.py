"""Fusion, reranking, routing and insertion over rankings of parts within a brand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lists
from ..operators import fusion, ranking
from .registry import Tables, query

SOLD = "sold as (select l_partkey, sum(l_quantity) as q, count(*) as n from lineitem group by 1)"
KEYS = f"""{SOLD}, base as (select p_brand as grp, cast(p_partkey as varchar) as key, p_retailprice as price, coalesce(q, 0) as q, coalesce(n, 0) as n, p_type as family, p_size as size from part left join sold on l_partkey = p_partkey),
    ra as (select grp, key, row_number() over (partition by grp order by price desc, key) as rank from base), rb as (select grp, key, row_number() over (partition by grp order by q desc, key) as rank from base),
    rc as (select grp, key, row_number() over (partition by grp order by size desc, key) as rank from base)"""
LISTS = f"""{KEYS}, la as (select grp, list(key order by rank) filter (where rank <= 30) as a from ra group by 1), lb as (select grp, list(key order by rank) filter (where rank <= 30) as b from rb group by 1),
    lc as (select grp, list(key order by rank) filter (where rank <= 30) as c from rc group by 1), l as (select * from la join lb using (grp) join lc using (grp))"""


def base(t: Tables) -> DataFrame:
    sold = t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    joined = t.part.join(sold, F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.select(
        F.col("p_brand").alias("grp"), F.col("p_partkey").cast("string").alias("key"), F.col("p_retailprice").alias("price"), F.coalesce("q", F.lit(0.0)).alias("q"),
        F.coalesce("n", F.lit(0)).alias("n"), F.col("p_type").alias("family"), F.col("p_size").alias("size"),
    )


def by(t: Tables, score: str) -> DataFrame:
    """grp, key, rank by a column of base()."""
    return ranking.ranked(base(t), ["grp"], score).select("grp", "key", "rank")


def three_lists(t: Tables) -> DataFrame:
    """grp and the first 30 keys by price (a), quantity sold (b) and size (c)."""
    each = [ranking.lists(by(t, s), ["grp"], k=30).withColumnRenamed("ranking", n) for n, s in (("a", "price"), ("b", "q"), ("c", "size"))]
    return each[0].join(each[1], "grp").join(each[2], "grp")


def text(c: Column) -> Column:
    return F.array_join(c, ";")


@query(
    f"""with {KEYS}, s as (select grp, key, 1.0 / 2 / (60 + rank) as s from ra union all select grp, key, 1.0 / 2 / (60 + rank) from rb), f as (select grp, key, round(sum(s), 12) as score from s group by 1, 2)
    select grp, key, score, row_number() over (partition by grp order by score desc, key) as rank from f"""
)
def rrf_fusion(t: Tables) -> DataFrame:
    f = fusion.rrf([by(t, "price"), by(t, "q")], ["grp"]).withColumn("score", F.round("score", 12)).drop("rank")
    return ranking.ranked(f, ["grp"]).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""with {KEYS}, e as (select grp, key, row_number() over (partition by grp order by round(sum(s), 12) desc, key) as rank from (select grp, key, 1.0 / 2 / (60 + rank) as s from rb union all select grp, key, 1.0 / 2 / (60 + rank) from rc) group by 1, 2),
    f as (select grp, key, round(sum(s), 12) as score from (select grp, key, 0.25 / (60 + rank) as s from ra union all select grp, key, 0.75 / (60 + rank) from e) group by 1, 2) select grp, key, score, row_number() over (partition by grp order by score desc, key) as rank from f"""
)
def ensemble_fusion(t: Tables) -> DataFrame:
    """Two rankings fused with equal votes, then with a third by weight."""
    f = fusion.ensemble_rrf(by(t, "price"), [by(t, "q"), by(t, "size")], ["grp"], 0.75).withColumn("score", F.round("score", 12)).drop("rank")
    return ranking.ranked(f, ["grp"]).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""with {KEYS}, s as (select grp, key, 0.7 / (60 + rank) as s from ra where rank <= 10 union all select grp, key, 0.3 / (60 + rank) from rc where rank <= 10),
    f as (select grp, key, round(sum(s), 12) as score from s group by 1, 2) select grp, key, score, row_number() over (partition by grp order by score desc, key) as rank from f"""
)
def rrf_weighted_zero(t: Tables) -> DataFrame:
    """A list of weight 0 vanishes with the keys that only it holds."""
    tens = [by(t, s).where("rank <= 10") for s in ("price", "q", "size")]
    f = fusion.rrf(tens, ["grp"], [0.7, 0.0, 0.3]).withColumn("score", F.round("score", 12)).drop("rank")
    return ranking.ranked(f, ["grp"]).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""with {KEYS}, s as (select grp, key, 1.0 / (3 + rank) as s, 0 as l, rank from ra union all select grp, key, 0.6 / (3 + rank), 1, rank from rb),
    f as (select grp, key, round(sum(s), 12) as score, min(l * 1000000 + rank) as pl from s group by 1, 2),
    r as (select *, row_number() over (partition by grp order by score desc, pl) as rank from f) select grp, key, score, rank from r where rank <= 40"""
)
def rrf_k3_alpha(t: Tables) -> DataFrame:
    rows = [by(t, s).withColumn("value", F.col("key")) for s in ("price", "q")]
    f = fusion.ordered_rrf(rows, ["grp"], [1.0, 0.6])
    return f.select("grp", "key", F.round("score", 12).alias("score"), F.col("rank").cast("long").alias("rank"))


IDS = f"""{KEYS}, ia as (select grp, key, rank, substr(key, -2) as ident, row_number() over (partition by grp, substr(key, -2) order by rank) as i from ra),
    ib as (select grp, key, rank, substr(key, -2) as ident, row_number() over (partition by grp, substr(key, -2) order by rank) as i from rb),
    va as (select grp, key, ident, row_number() over (partition by grp order by rank) as rank from ia where i = 1), vb as (select grp, key, ident, row_number() over (partition by grp order by rank) as rank from ib where i = 1)"""


@query(
    f"""with {IDS}, s as (select grp, ident, key, 1.0 / (3 + rank) as s, rank as pl from va union all select grp, ident, key, 0.6 / (3 + rank), 1000000 + rank from vb),
    f as (select grp, ident, arg_min(key, pl) as key, round(sum(s), 12) as score, min(pl) as pl from s group by 1, 2),
    r as (select *, row_number() over (partition by grp order by score desc, pl) as rank from f) select grp, ident, key, score, rank from r where rank <= 40"""
)
def identity_fusion(t: Tables) -> DataFrame:
    """One vote an identity (the last two digits of a key) and list."""
    rows = [by(t, s).withColumn("ident", F.substring("key", -2, 2)) for s in ("price", "q")]
    f = fusion.identity_fusion(rows[0], rows[1], ["grp"], "ident", "key")
    return f.select("grp", "ident", "key", F.round("score", 12).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""with {KEYS}, e as (select ra.grp, ra.key, ra.rank, case when ra.rank <= 100 then b.n else null end as ev from ra join base b using (grp, key)),
    k as (select *, case when ev is not null then rank() over (partition by grp order by ev desc nulls last) end as place, min(ev) over (partition by grp) = max(ev) over (partition by grp) as tied from e),
    f as (select grp, key, rank as old, round(case when tied then 1.0 / (60 + rank) else 0.75 / (60 + rank) + coalesce(0.25 / (60 + place), 0) end, 12) as fused from k)
    select grp, key, fused, row_number() over (partition by grp order by fused desc, old) as rank from f"""
)
def rerank_competition(t: Tables) -> DataFrame:
    """Ranks by price reranked by the number of sales, 100 at most, with competition ranks."""
    evidence = base(t).select("grp", "key", F.col("n").cast("double").alias("evidence"))
    f = fusion.rerank(by(t, "price"), evidence, ["grp"]).join(by(t, "price").withColumnRenamed("rank", "old"), ["grp", "key"]).withColumn("fused", F.round("fused", 12))
    from pyspark.sql import Window

    return f.select("grp", "key", "fused", F.row_number().over(Window.partitionBy("grp").orderBy(F.col("fused").desc(), "old")).cast("long").alias("rank"))


@query(
    f"""with {KEYS}, z as (select grp, key, price, q, case when stddev_pop(q) over w > 1e-9 then (q - avg(q) over w) / stddev_pop(q) over w else 0 end as z, q - max(q) over w as below,
      (row_number() over (partition by grp order by q, key) - 1) / greatest(count(*) over w - 1, 1) as sh, (row_number() over (partition by grp order by price, key) - 1) / greatest(count(*) over w - 1, 1) as sp
      from base window w as (partition by grp))
    select grp, key, round(z, 8) as z, round(below, 6) as below, round(0.88 * sh + 0.12 * sp, 10) as blend, rank() over (partition by grp order by q desc) as competition from z"""
)
def rank_normalise_blend(t: Tables) -> DataFrame:
    df = base(t)
    return df.select(
        "grp", "key", F.round(ranking.z_score(["grp"], "q"), 8).alias("z"), F.round(ranking.below_best(["grp"], "q"), 6).alias("below"),
        F.round(fusion.blended(ranking.rank_share(["grp"], "q", "key"), ranking.rank_share(["grp"], "price", "key")), 10).alias("blend"), ranking.competition_rank(["grp"], "q").cast("long").alias("competition"),
    )


@query(
    f"""with {KEYS}, r as (select b.*, rb.rank, avg(n) over (partition by b.grp) as m from base b join rb using (grp, key)), p as (select grp, family, rank as place, row_number() over (partition by grp, family order by rank) as i from r),
    n as (select grp, family, key, row_number() over (partition by grp, family order by price desc, rank) as i from r) select n.grp, n.key, n.family, p.place as rank from n join p using (grp, family, i)"""
)
def group_slot_permute(t: Tables) -> DataFrame:
    """Parts of one type permuted by price among the places that type holds."""
    rows = base(t).join(by(t, "q"), ["grp", "key"])
    return fusion.slot_rerank(rows, ["grp"], ["family"], "price").select("grp", "key", "family", F.col("rank").cast("long").alias("rank"))


@query(
    f"""with {KEYS}, r as (select grp, key, price, row_number() over (partition by grp order by price desc, key) as rank from base)
    select grp, min(key) filter (where rank = 1) as leader, max(price) as confidence, round(coalesce(max(price) filter (where rank = 1) - max(price) filter (where rank = 2), 0), 6) as margin, count(*) as keys from r group by 1"""
)
def confidence_margin(t: Tables) -> DataFrame:
    return ranking.confidence_margin(base(t), ["grp"], "price").withColumn("margin", F.round("margin", 6))


@query(
    f"""with {LISTS} select grp, array_to_string(list_concat(list_slice(a, 1, 3), list_slice(list_filter(b, lambda x: not list_contains(a, x)), 1, 3), list_slice(a, 4, 30)), ';') as ranking,
    array_to_string(list_slice(a, 1, 1), ';') as head from l"""
)
def slot_insert(t: Tables) -> DataFrame:
    l = three_lists(t)  # noqa: E741
    return l.select("grp", text(lists.inserted(F.col("a"), F.col("b"), 3, 3)).alias("ranking"), text(lists.take(F.col("a"), 1)).alias("head"))


def _merge_sql(n: int = 25, slots: tuple[int, ...] = (4, 8, 12, 16, 20)) -> str:
    news = "list_filter(b, lambda x: not list_contains(a, x))"
    marks = ", ".join(map(str, slots))
    # the k-th new value stands at the k-th slot while there are any; the base fills the other places in order
    return f"""m as (select *, {news} as nw from l), g as (select grp, a, nw, unnest(generate_series(1, {n})) as pos from m),
    s as (select *, len(list_filter([{marks}], lambda x: x <= pos)) as upto, list_contains([{marks}], pos) as slot from g),
    v as (select grp, pos, case when slot and upto <= len(nw) then nw[upto] else a[pos - least(upto, len(nw))] end as value from s)"""


@query(f"with {LISTS}, {_merge_sql()} select grp, string_agg(value, ';' order by pos) as ranking from v where value is not null group by 1")
def fixed_slot_merge(t: Tables) -> DataFrame:
    l = three_lists(t)  # noqa: E741
    return l.select("grp", text(lists.merged_at(F.col("a"), F.col("a"), F.col("b"), F.col("b"), [4, 8, 12, 16, 20])).alias("ranking"))


@query(
    f"""with {LISTS}, {_merge_sql()}, u as (select grp, list(value order by pos) as usual from v where value is not null group by 1)
    select grp, array_to_string(list_slice(list_concat([b[1]], list_filter(usual, lambda x: x <> b[1])), 1, 25), ';') as ranking from u join l using (grp)"""
)
def promote_head(t: Tables) -> DataFrame:
    l = three_lists(t)  # noqa: E741
    return l.select("grp", text(lists.promoted(F.col("a"), F.col("a"), F.col("b"), F.col("b"), [4, 8, 12, 16, 20])).alias("ranking"))


@query(
    f"""with {LISTS}, e as (select grp, unnest(list_concat(a, b)) as v, generate_subscripts(list_concat(a, b), 1) as pos from l),
    i as (select *, row_number() over (partition by grp, substr(v, -2) order by pos) as k from e), r as (select grp, v, pos, row_number() over (partition by grp order by pos) as rank from i where k = 1)
    select grp, string_agg(v, ';' order by pos) as ranking from r where rank <= 25 group by 1"""
)
def safe_extend(t: Tables) -> DataFrame:
    l = three_lists(t)  # noqa: E741
    return l.select("grp", text(lists.safely_extended(F.col("a"), F.col("b"), lambda v: F.substring(v, -2, 2))).alias("ranking"))


@query(
    f"""with recursive {LISTS}, tp as (select grp, (max(price) - 900) / 100 as top from base group by 1), n as (select grp, a, b, case when len(a) > 0 and top >= 0.75 then 2 else 1 end as heads from l join tp using (grp)),
    il as (select grp, 0 as k, []::varchar[] as o from n union all select i.grp, k + 1, case when len(o) >= 25 then o else list_concat(o, list_slice(list_filter(case when k < heads then a when (k - heads) % 6 < 5 then b else a end, lambda x: not list_contains(o, x)), 1, 1)) end
      from il i join n on n.grp = i.grp where k < 158) select grp, array_to_string(o, ';') as ranking from il where k = 158"""
)
def protected_interleave(t: Tables) -> DataFrame:
    """Sequential by nature: a fold here, a recursion in SQL; the tests hold it against its properties as well."""
    l = three_lists(t).join(base(t).groupBy("grp").agg(F.max("price").alias("top")), "grp")  # noqa: E741
    return l.select("grp", text(lists.interleaved(F.col("a"), F.col("b"), (F.col("top") - 900) / 100)).alias("ranking"))


CONF = f"""{LISTS}, cf as (select grp, round((max(price) - 900) / 100, 6) as confidence from base group by 1),
    fs as (select grp, x, sum(w / (60 + i)) as s from (select grp, unnest(a) as x, generate_subscripts(a, 1) as i, 0.25 as w from l union all select grp, unnest(b), generate_subscripts(b, 1), 0.75 from l) group by 1, 2),
    fu as (select grp, list(x order by round(s, 12) desc, x) as fused from fs group by 1)"""


def confidence_of(t: Tables) -> DataFrame:
    return base(t).groupBy("grp").agg(F.round((F.max("price") - 900) / 100, 6).alias("confidence"))


@query(
    f"""with {CONF} select grp, confidence, array_to_string(case when confidence >= 0.998 then a else list_concat(list_slice(a, 1, 1), list_filter(fused, lambda x: x <> a[1])) end, ';') as ranking from l join cf using (grp) join fu using (grp)"""
)
def guarded_route(t: Tables) -> DataFrame:
    l = three_lists(t).join(confidence_of(t), "grp")  # noqa: E741
    fused = lists.fused_arrays([F.col("a"), F.col("b")], [0.25, 0.75])
    return l.select("grp", "confidence", text(lists.guarded(F.col("a"), fused, F.col("confidence"), 0.998)).alias("ranking"))


@query(
    f"""with {CONF}, ex as (select grp, list_concat(a, list_filter(c, lambda x: not list_contains(a, x))) as ext from l),
    gs as (select grp, x, sum(w / (60 + i)) as s from (select grp, unnest(ext) as x, generate_subscripts(ext, 1) as i, 0.6 as w from ex union all select grp, unnest(b), generate_subscripts(b, 1), 0.4 from l) group by 1, 2),
    gu as (select grp, list(x order by round(s, 12) desc, x) as f2 from gs group by 1),
    hs as (select grp, x, sum(w / (60 + i)) as s from (select grp, unnest(c) as x, generate_subscripts(c, 1) as i, 0.25 as w from l union all select grp, unnest(b), generate_subscripts(b, 1), 0.75 from l) group by 1, 2),
    hu as (select grp, list(x order by round(s, 12) desc, x) as f3 from hs group by 1), k as (select unnest(['retrieval', 'current_guard', 'margin', 'protect_top1', 'free_top1']) as kind),
    o as (select grp, kind, case when kind = 'retrieval' then a when kind = 'current_guard' then case when confidence >= 0.65 then c else list_concat(list_slice(c, 1, 1), list_filter(f3, lambda x: x <> c[1])) end when confidence >= 0.999 or (kind = 'margin' and cast(a[1] as int) % 3 / 2.0::double >= 0.5) then a
      when kind = 'protect_top1' then list_concat(list_slice(a, 1, 1), list_filter(f2, lambda x: x <> a[1])) else f2 end as r from l join cf using (grp) join gu using (grp) join hu using (grp) cross join k)
    select grp, kind, array_to_string(list_slice(r, 1, 10), ';') as ranking from o"""
)
def config_router_grid(t: Tables) -> DataFrame:
    """Each group's ranking under five kinds of configuration."""
    kinds = t.spark.createDataFrame([(k,) for k in ("retrieval", "current_guard", "margin", "protect_top1", "free_top1")], "kind string")
    l = three_lists(t).join(confidence_of(t), "grp").crossJoin(F.broadcast(kinds))  # noqa: E741
    r = lists.route(F.col("kind"), F.col("a"), F.col("c"), F.col("b"), F.col("confidence"), F.col("a")[0].cast("int") % 3 / 2, F.lit(0.999), F.lit(0.5), F.lit(0.4))
    return l.select("grp", "kind", text(lists.take(r, 10)).alias("ranking"))


@query(
    f"""with {LISTS} select grp, len(list_intersect(list_slice(a, 1, 5), list_slice(b, 1, 5))) / 5.0 as overlap5, len(list_intersect(list_slice(a, 1, 25), list_slice(b, 1, 25))) / 25.0 as overlap25,
    round(coalesce(1.0 / nullif(list_position(b, a[1]), 0), 0), 10) as rr, len(list_concat(a, list_filter(b, lambda x: not list_contains(a, x)))) as united from l"""
)
def overlap_features(t: Tables) -> DataFrame:
    l = three_lists(t)  # noqa: E741
    a, b = F.col("a"), F.col("b")
    return l.select("grp", lists.overlap(a, b, 5).alias("overlap5"), lists.overlap(a, b, 25).alias("overlap25"), F.round(lists.reciprocal_rank(a[0], b), 10).alias("rr"), F.size(lists.extended(a, b)).cast("long").alias("united"))


@query(
    f"""with {LISTS}, o as (select grp, c as observed from l) select grp, case when not list_contains(observed, a[1]) then 1 else 3 end as adaptive, case when not list_contains(observed, a[2]) then 1 else 2 end as second,
    greatest(1, case when list_contains(observed, a[3]) then 3 when list_contains(observed, a[2]) then 2 else 1 end) as supported, len(list_intersect(list_slice(a, 1, 3), observed)) > 0 as protected from l join o using (grp)"""
)
def prefix_rules(t: Tables) -> DataFrame:
    l = three_lists(t)  # noqa: E741
    a, seen, low = F.col("a"), F.col("c"), F.lit(0.4)
    return l.select(
        "grp", lists.adaptive_prefix(a, seen, low, "unreferenced_first").alias("adaptive"), lists.second_prefix(a, seen, low, "second_unreferenced").alias("second"), lists.supported_prefix(a, seen).alias("supported"),
        lists.protects(a, seen, low, 3).alias("protected"),
    )


@query(
    f"""with {KEYS}, d as (select grp, key, rank, substr(key, -2) as ident, row_number() over (partition by grp, substr(key, -2) order by rank) as i from ra),
    r as (select grp, key, ident, row_number() over (partition by grp order by rank) as rank from d where i = 1) select grp, key, ident, rank from r where rank <= 25"""
)
def identity_dedup(t: Tables) -> DataFrame:
    rows = by(t, "price").withColumn("ident", F.substring("key", -2, 2))
    return fusion.deduplicated(rows, ["grp"], "ident").select("grp", "key", "ident", F.col("rank").cast("long").alias("rank"))


@query(
    f"""with {KEYS}, j as (select b.grp, b.key, b.price, b.q, b.n, row_number() over (partition by grp order by price desc, key) as c, row_number() over (partition by grp order by q desc, key) as p from base b),
    f as (select *, row_number() over (partition by grp order by q + price desc, key) as rank from j where (c <= 20 or p <= 5) and cast(key as int) % 4 > 0) select grp, key, round(q + price, 6) as score, rank from f where rank <= 10"""
)
def two_pass_topk(t: Tables) -> DataFrame:
    """Best by a cheap score or popular, outside the pool, by the full score."""
    pool = base(t).where(F.col("key").cast("int") % 4 == 0).select("grp", "key")
    f = ranking.two_pass_top(base(t), ["grp"], "price", "q", F.col("q") + F.col("price"), "key", 20, 5, 10, pool)
    return f.select("grp", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"with {KEYS} select grp, round(max(q) filter (where family = 'PROMO') - max(q) filter (where family <> 'PROMO'), 6) as gap from base group by 1")
def best_gap(t: Tables) -> DataFrame:
    return ranking.best_gap(base(t), ["grp"], "q", F.col("family") == "PROMO").withColumn("gap", F.round("gap", 6))


@query(f"with {KEYS} select grp, key, ra.rank as old_rank, rb.rank as new_rank from ra full join rb using (grp, key)")
def rank_movement(t: Tables) -> DataFrame:
    m = fusion.movement(by(t, "price"), by(t, "q"), ["grp"])
    return m.select("grp", "key", F.col("old_rank").cast("long").alias("old_rank"), F.col("new_rank").cast("long").alias("new_rank"))


SECOND = "case right(grp, 1) when '1' then list_concat(['CCO'], a) when '2' then []::varchar[] else a end"
ENGINE = "case right(grp, 1) when '3' then []::varchar[] when '4' then list_concat(['', ' CCO ', 'bad;value'], b) when '5' then list_concat([' ', a[2]], b) else list_concat(['CCO'], b) end"


@query(
    f"""with {LISTS}, x0 as (select grp, {SECOND} as a, {ENGINE} as e from l), x as (select *, trim(list_filter(e, lambda s: trim(s) not in ('', 'CCO'))[1]) as x2, list_transform(a, lambda t: substr(t, -2)) as ks from x0),
    y0 as (select *, case when x2 not like '%;%' then substr(x2, -2) end as kx from x), y as (select *, list_position(ks, kx) as at_, list_filter(a, lambda t: substr(t, -2) <> kx) as others from y0),
    z as (select *, case when len(a) = 0 or trim(a[1]) in ('', 'CCO') then 'skipped' when len(e) = 0 then 'no_eng' when kx is null then 'invalid_x2' when kx = ks[1] then 'same_as_rank1' when at_ = 2 then 'already_rank2' else 'inserted' end as status from y)
    select grp, status, case when status = 'already_rank2' then '2' when status = 'inserted' then coalesce(cast(nullif(at_, 0) as varchar), 'absent') end as moved_from,
    array_to_string(case when status in ('inserted', 'already_rank2') then list_slice(list_concat(list_slice(others, 1, 1), case when status = 'inserted' then [x2] else [a[2]] end, list_slice(others, 2, 100)), 1, 25) else a end, ';') as ranking from z"""
)
def second_place_insert(t: Tables) -> DataFrame:
    """Another engine's first usable value at place two, with every outcome."""
    none, last, two = F.array().cast("array<string>"), F.substring("grp", -1, 1), lambda *x: F.array(*[F.lit(v) for v in x])
    a, b = F.col("a"), F.col("b")
    own = F.when(last == "1", F.concat(two("CCO"), a)).when(last == "2", none).otherwise(a)
    other = F.when(last == "3", none).when(last == "4", F.concat(two("", " CCO ", "bad;value"), b)).when(last == "5", F.concat(F.array(F.lit(" "), a[1]), b)).otherwise(F.concat(two("CCO"), b))
    l = three_lists(t).select("grp", own.alias("a"), other.alias("e"))  # noqa: E741
    r = l.select("grp", lists.second_place(F.col("a"), F.col("e"), lambda v: F.substring(v, -2, 2)).alias("r"))
    return r.select("grp", "r.status", "r.moved_from", text(F.col("r.ranking")).alias("ranking"))


@query(
    f"""with {LISTS}, n as (select grp, a, list_slice(list_filter(b, lambda x: not list_contains(a, x)), 1, 5) as nw from l)
    select grp, array_to_string(list_concat(list_slice(nw, 1, 2), list_slice(a, 1, 3), list_slice(nw, 3, 5), list_slice(a, 4, 100)), ';') as ranking from n"""
)
def partial_promotion(t: Tables) -> DataFrame:
    l = three_lists(t)  # noqa: E741
    return l.select("grp", text(lists.partly_promoted(F.col("a"), F.col("b"), 3, 2)).alias("ranking"))


FAR = "case right(grp, 1) when '1' then 700.0 when '2' then 300.0 when '3' then null else 0.0 end"


@query(
    f"""with {LISTS}, {_merge_sql()}, {_merge_sql(slots=(2, 4, 6, 8, 10)).replace('m as', 'm2 as').replace('from m)', 'from m2)').replace('g as', 'g2 as').replace('from g)', 'from g2)').replace('s as', 's2 as').replace('from s)', 'from s2)').replace('v as', 'v2 as')},
    u as (select grp, list(value order by pos) as usual from v where value is not null group by 1), u2 as (select grp, list(value order by pos) as usual2 from v2 where value is not null group by 1), c as (select grp, (max(price) - 900) / 100 as top, max(n) as sales from base group by 1),
    k as (select *, {FAR} as far, case when right(grp, 1) = '4' then []::varchar[] else b end as o from l join u using (grp) join u2 using (grp) join c using (grp)), q as (select *, coalesce(far > 600, false) as wide, coalesce(sales > 5, false) or coalesce(far > 250, false) as leads, case when coalesce(far > 600, false) then usual2 else usual end as body from k)
    select grp, case when len(o) = 0 then 'no_other' when top >= 0.9995 then 'untouched' when wide and leads then 'aggressive_promoted' when wide then 'aggressive' when leads then 'gentle_promoted' else 'gentle' end as status,
    array_to_string(case when len(o) = 0 or top >= 0.9995 then list_slice(a, 1, 25) when leads then list_slice(list_concat([b[1]], list_filter(body, lambda x: x <> b[1])), 1, 25) else body end, ';') as ranking from q"""
)
def gated_merge(t: Tables) -> DataFrame:
    """How far another catalog's values stand out decides where they go; far ones, strong ones, and none among them."""
    c = base(t).groupBy("grp").agg(((F.max("price") - 900) / 100).alias("top"), F.max("n").alias("sales"))
    l = three_lists(t).join(c, "grp")  # noqa: E741
    last = F.substring("grp", -1, 1)
    a, b = F.col("a"), F.when(last == "4", F.array().cast("array<string>")).otherwise(F.col("b"))
    far = F.when(last == "1", 700.0).when(last == "2", 300.0).when(last == "3", None).otherwise(0.0)
    sure = F.when(F.col("top") >= 0.9995, 1.0).otherwise(0.0)
    r = l.select("grp", lists.gated_merge(a, a, b, b, sure, far, F.lit(7.0), F.when(F.col("sales") > 5, 5).otherwise(0)).alias("r"))
    return r.select("grp", "r.status", text(F.col("r.ranking")).alias("ranking"))


@query(
    f"""with {KEYS}, s as (select ra.grp, ra.key, ra.rank, case when b.size > 25 then cast(b.n as double) end as sc from ra join base b using (grp, key)), v as (select *, row_number() over (partition by grp order by rank) as i from s where sc is not null),
    k as (select *, rank() over (partition by grp order by sc desc) as place, min(sc) over (partition by grp) = max(sc) over (partition by grp) as tied from v),
    f as (select *, row_number() over (partition by grp order by round(case when tied then 1.0 / (60 + i) else 0.5 / (60 + i) + 0.5 / (60 + place) end, 12) desc, i) as j from k)
    select f.grp, f.key, v.rank from f join v on v.grp = f.grp and v.i = f.j union all select grp, key, rank from s where sc is null"""
)
def scoreable_reorder(t: Tables) -> DataFrame:
    """Large parts permuted among their own places by sales; the others stay."""
    rows = by(t, "price").join(base(t).select("grp", "key", F.when(F.col("size") > 25, F.col("n").cast("double")).alias("s")), ["grp", "key"])
    return fusion.scoreable_reordered(rows, ["grp"], "s").select("grp", "key", F.col("rank").cast("long").alias("rank"))


def _rerank_sql(name: str, source: str, column: str, weight: float) -> str:
    return f"""{name}_k as (select r.grp, r.key, r.rank, rank() over (partition by r.grp order by b.{column} desc) as place, min(b.{column}) over (partition by r.grp) = max(b.{column}) over (partition by r.grp) as tied from {source} r join base b using (grp, key)),
    {name} as (select grp, key, row_number() over (partition by grp order by round(case when tied then 1.0 / (60 + rank) else {1 - weight} / (60 + rank) + {weight} / (60 + place) end, 12) desc, rank) as rank from {name}_k)"""


@query(
    f"""with {KEYS}, g0 as (select grp, key, row_number() over (partition by grp order by round(-price / greatest(size, 1), 12) desc, key) as rank from base), {_rerank_sql('g1', 'g0', 'n', 0.25)}, {_rerank_sql('g2', 'g1', 'size', 0.25)}, {_rerank_sql('g3', 'g2', 'q', 0.5)}
    select grp, key, rank from g3"""
)
def generated_order(t: Tables) -> DataFrame:
    df = base(t).select("grp", "key", (-F.col("price")).alias("log_probability"), F.col("size").alias("length"), F.col("n").alias("chemical_score"), F.col("size").alias("formula_support"), F.col("q").alias("sample_count"))
    return fusion.generated_order(df, ["grp"], frequency=0.5).select("grp", "key", F.col("rank").cast("long").alias("rank"))
