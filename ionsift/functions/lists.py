"""Rankings as arrays of keys, best first: union, insertion, interleaving, promotion, routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .peaks import let

SIZE = 25


def take(keys: Column, n: Column | int) -> Column:
    return F.slice(keys, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def rest(keys: Column, n: Column | int) -> Column:
    """What comes after the first n."""
    at = n if isinstance(n, Column) else F.lit(n)
    return F.slice(keys, at + 1, F.size(keys))


def extended(first: Column, second: Column) -> Column:
    """The first list, then the keys of the second it lacks, in order."""
    return F.array_union(first, second)


def novel(base: Column, other: Column) -> Column:
    """The distinct keys of other that base lacks, in order."""
    return F.array_except(F.array_distinct(other), base)


def inserted(base: Column, generated: Column, prefix: Column | int, slots: int) -> Column:
    """base with its first ``prefix`` keys, then ``slots`` novel keys at most, then its rest."""
    return F.concat(take(base, prefix), take(novel(base, generated), slots), rest(base, prefix))


def logsumexp(values: Column) -> Column:
    """ln of the sum of exponentials of an array, without overflow; null for an empty one."""
    return let(F.array_max(values), lambda top: top + F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top))))


def softmax(values: Column) -> Column:
    """Shares of exponentials."""
    return let(logsumexp(values), lambda total: F.transform(values, lambda x: F.exp(x - total)))


def reranked(keys: Column, scores: Column, weight: float, top: int | None = None) -> Column:
    """A ranking by (1 - w) / (60 + place) and, for the first ``top``, w / (60 + competition rank by score); scores are a map, missing ones 0.  It stays as it is where all scores tie."""
    if not 0 <= weight <= 1:
        raise ValueError("weight in [0, 1]")
    head = take(keys, top) if top else keys
    evidence = F.transform(head, lambda k: F.coalesce(F.try_element_at(scores, k), F.lit(0.0)))

    def fused(v: Column) -> Column:
        place = lambda i: F.size(F.filter(v, lambda x: x > F.get(v, i))) + 1
        total = lambda i: (1 - weight) / (61 + i) + F.when(i < F.size(v), weight / (60 + place(i))).otherwise(0.0)
        ordered = F.array_sort(F.transform(keys, lambda k, i: F.struct((-F.round(total(i), 12)).alias("s"), i.alias("i"), k.alias("k"))))
        return F.when(F.array_max(v) > F.array_min(v), F.transform(ordered, lambda p: p["k"])).otherwise(keys)

    return let(evidence, fused) if weight else keys


def fragment_ranked_insert(base: Column, candidates: Column, scores: Column, weight: float, prefix: int = 3, slots: int = 5) -> Column:
    """The candidates that base lacks, reranked by their fragment scores among themselves, inserted behind its prefix."""
    return inserted(base, reranked(novel(base, candidates), scores, weight), prefix, slots)


def led(leader: Column, keys: Column) -> Column:
    """The list with one key moved or added to its head."""
    return F.concat(F.array(leader), F.filter(keys, lambda k: k != leader))


def interleaved(library: Column, analog: Column, top_score: Column, protect_from: float = 0.75, size: int = SIZE) -> Column:
    """One library key, two if the top score is high; then five analogs to a library key in turn, without repeats."""
    heads = F.when((F.size(library) > 0) & (top_score >= protect_from), 2).otherwise(1)

    def step(out: Column, k: Column) -> Column:
        source = F.when(k < heads, library).when((k - heads) % 6 < 5, analog).otherwise(library)
        return F.when(F.size(out) >= size, out).otherwise(F.concat(out, take(F.array_except(source, out), 1)))

    # a turn that finds its source used up adds nothing; six times the size is enough turns
    return F.aggregate(F.sequence(F.lit(0), F.lit(6 * size + 8)), F.array().cast("array<string>"), step)


def merged_at(base: Column, base_keys: Column, other: Column, other_keys: Column, slots: list[int], size: int = SIZE) -> Column:
    """Values of other, of keys that base lacks, at the slots (from 1); values of base elsewhere; either where the other is used up."""
    fresh = F.transform(F.filter(F.arrays_zip(other.alias("v"), other_keys.alias("k")), lambda p: ~F.array_contains(base_keys, p["k"])), lambda p: p["v"])
    mark = F.array(*[F.lit(s) for s in slots])

    def merged(news: Column) -> Column:
        def step(acc: Column, pos: Column) -> Column:
            b, j = acc["b"], acc["j"]
            use_new = (F.array_contains(mark, pos) | (b >= F.size(base))) & (j < F.size(news))
            use_base = ~use_new & (b < F.size(base))
            add = F.when(use_new, F.slice(news, j + 1, 1)).when(use_base, F.slice(base, b + 1, 1)).otherwise(F.array().cast("array<string>"))
            return F.struct(F.concat(acc["out"], add).alias("out"), (b + use_base.cast("int")).alias("b"), (j + use_new.cast("int")).alias("j"))

        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("b"), F.lit(0).alias("j"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(size)), start, step)["out"]

    return let(fresh, merged)


def popularity_reranked(keys: Column, generated: Column, z: Column, popularity: Column, weight: float = 0.15) -> Column:
    """Items of the pool permuted among their own places by z plus weighed popularity (maps; missing: 0), equals in their order; generated ones keep their places."""
    score = lambda k: F.coalesce(F.try_element_at(z, k), F.lit(0.0)) + weight * F.coalesce(F.try_element_at(popularity, k), F.lit(0.0))
    pool = F.filter(keys, lambda k: ~F.array_contains(generated, k))
    best = F.transform(F.array_sort(F.transform(pool, lambda k, i: F.struct((-F.round(score(k), 12)).alias("s"), i.alias("i"), k.alias("k")))), lambda p: p["k"])
    before = lambda i: F.size(F.filter(take(keys, i), lambda k: ~F.array_contains(generated, k)))
    return let(best, lambda b: F.transform(keys, lambda k, i: F.when(F.array_contains(generated, k), k).otherwise(F.get(b, before(i)))))


def promoted(base: Column, base_keys: Column, other: Column, other_keys: Column, slots: list[int], size: int = SIZE) -> Column:
    """merged_at(), led by the first value of other if there is one."""
    usual = merged_at(base, base_keys, other, other_keys, slots, size)
    return F.when(F.size(other) > 0, take(led(other[0], usual), size)).otherwise(usual)


def safely_extended(original: Column, extra: Column, identity, size: int = SIZE) -> Column:
    """original then extra, the first value of each identity (a function of a column; null: left out), up to a size."""
    all_ = F.transform(F.concat(original, extra), lambda v: F.struct(identity(F.trim(v)).alias("k"), F.trim(v).alias("v")))

    def step(acc: Column, p: Column) -> Column:
        skip = p["k"].isNull() | F.coalesce(F.array_contains(acc["seen"], p["k"]), F.lit(False)) | (F.size(acc["out"]) >= size)
        return F.when(skip, acc).otherwise(F.struct(F.concat(acc["seen"], F.array(p["k"])).alias("seen"), F.concat(acc["out"], F.array(p["v"])).alias("out")))

    empty = F.array().cast("array<string>")
    return F.aggregate(all_, F.struct(empty.alias("seen"), empty.alias("out")), step)["out"]


def guarded(baseline: Column, fusion: Column, confidence: Column, threshold: float) -> Column:
    """The baseline where the confidence reaches the threshold; else its head and then the fusion."""
    return F.when(confidence >= threshold, baseline).otherwise(F.concat(take(baseline, 1), F.array_except(fusion, take(baseline, 1))))


def protects(ranking: Column, observed: Column, confidence: Column, top: int = 1, threshold: float = 0.0) -> Column:
    return (confidence >= 0.5) | ((confidence >= threshold) & F.arrays_overlap(take(ranking, top), observed))


def supported_prefix(prior: Column, observed: Column) -> Column:
    """The deepest of the first three places whose key is observed, at least 1."""
    places = [F.when(F.array_contains(observed, F.get(prior, F.lit(i))), i + 1).otherwise(1) for i in range(3)]
    return F.coalesce(F.greatest(*places), F.lit(1))


def _unseen(ranking: Column, at: int, observed: Column) -> Column:
    return (F.size(ranking) > at) & ~F.coalesce(F.array_contains(observed, F.get(ranking, F.lit(at))), F.lit(False))


def adaptive_prefix(ranking: Column, observed: Column, confidence: Column, strategy: str) -> Column:
    """3, or 1 where the strategy finds the head weak."""
    low, unseen = confidence < 0.5, _unseen(ranking, 0, observed)
    weak = {"baseline": F.lit(False), "unreferenced_first": unseen, "low_confidence": low, "unreferenced_or_low": low | unseen}[strategy]
    return F.when(weak, 1).otherwise(3)


def second_prefix(ranking: Column, observed: Column, confidence: Column, variant: str) -> Column:
    """2, or 1 where the second key has no reference (and, in a variant, the confidence is low)."""
    unseen = _unseen(ranking, 1, observed)
    weak = {"baseline": F.lit(False), "second_unreferenced": unseen, "second_unreferenced_lowconf": unseen & (confidence < 0.5)}[variant]
    return F.when(weak, 1).otherwise(2)


def expanded_prefix(ranking: Column, observed: Column, variant: str) -> Column:
    unseen = _unseen(ranking, 0, observed)
    return {"baseline": F.lit(2), "expanded_prefix1": F.lit(1), "unsupported_first1": F.when(unseen, 1).otherwise(2), "unsupported_first0": F.when(unseen, 0).otherwise(2)}[variant]


def promotion_prefix(ranking: Column, generated: Column, scores: Column, prefix: int, margin: float | None) -> Column:
    """0 where the first novel key scores above the head by more than the margin; else the prefix.  ``scores`` maps keys to numbers."""
    if margin is None:
        return F.lit(prefix)
    head, new = F.try_element_at(scores, F.get(ranking, F.lit(0))), F.try_element_at(scores, F.get(novel(ranking, generated), F.lit(0)))
    return F.when(head.isNotNull() & new.isNotNull() & (new > head + margin), 0).otherwise(prefix)


def informative(proposed: Column, fragments: Column) -> Column:
    """Whether fragment scores (a map; missing: 0) separate the proposals: two at least, finite, not all equal, the first above 0."""
    v = F.transform(proposed, lambda k: F.coalesce(F.try_element_at(fragments, k), F.lit(0.0)))
    finite = ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 1) & finite & (F.array_max(v) > 0) & (F.array_max(v) > F.array_min(v)) & (F.get(v, F.lit(0)) > 0), F.lit(False))


def _of(scores: Column, key: Column, default: float | None = 0.0) -> Column:
    found = F.try_element_at(scores, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def critic_gate(candidates: Column, critic: Column, first: Column, margin: float) -> Column:
    """Whether any candidate's critic score exceeds the first's by more than a margin."""
    best = F.array_max(F.transform(candidates, lambda k: _of(critic, k, None)))
    return F.coalesce((F.size(candidates) > 0) & (best > _of(critic, first, None) + margin), F.lit(False))


def supported(proposed: Column, critic: Column, first: Column, fragments: Column, margin: float) -> Column:
    """Proposals with a fragment score above 0 and a critic score above the first's by more than a margin."""
    return F.filter(proposed, lambda k: (_of(fragments, k) > 0) & (_of(critic, k, None) > _of(critic, first, None) + margin))


def relatively_supported(proposed: Column, fragments: Column, first: Column) -> Column:
    """Proposals with a finite fragment score above the first's, or above 0."""
    level = F.greatest(F.lit(0.0), _of(fragments, first))
    return F.filter(proposed, lambda k: ~F.isnan(_of(fragments, k)) & (_of(fragments, k) < float("inf")) & (_of(fragments, k) > level))


def low_fragment(current: Column, proposed: Column, critic: Column, fragments: Column, fallback: Column, leader_first: bool = False) -> Column:
    """Struct (ranking, inserted, status) of the low-confidence branch; proposals come in the order of their fragment scores."""
    first, lead = F.get(current, F.lit(0)), F.get(proposed, F.lit(0))
    fine = (F.size(current) > 0) & ~fallback & informative(proposed, fragments) & (_of(fragments, lead) > _of(fragments, first)) & (_of(critic, lead, None) > _of(critic, first, None) + 0.05)
    fine = F.coalesce(fine, F.lit(False))
    new = inserted(current, proposed, 3, 3)
    result, status = (led(lead, new), "low_supported_leader_first") if leader_first else (new, "low_fragment_inserted")
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(fine, result).otherwise(current).alias("ranking"), F.when(fine, take(proposed, 3)).otherwise(none).alias("inserted"),
        F.when(fine, status).when(fallback, "fragment_budget_fallback").otherwise("fragment_evidence_fallback").alias("status"),
    )


def high_fragment(current: Column, tail: Column, proposed: Column, candidates: Column, critic: Column, fragments: Column, fallback: Column) -> Column:
    """Struct (ranking, inserted, status) of the high-confidence branch; ``proposed`` are the candidates reranked by fragments."""
    lead, first = F.get(proposed, F.lit(0)), F.get(current, F.lit(0))
    blind = ~informative(proposed, fragments)
    better = F.coalesce((_of(fragments, lead) > _of(fragments, first)) & (_of(critic, lead, None) > _of(critic, first, None) + 0.05), F.lit(False))
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(fallback | blind, tail).when(better, inserted(current, proposed, 3, 3)).otherwise(current).alias("ranking"),
        F.when(fallback | blind, take(candidates, 3)).when(better, take(proposed, 3)).otherwise(none).alias("inserted"),
        F.when(fallback, "high_fragment_budget_keep_tail").when(blind, "high_fragment_evidence_keep_tail").when(better, "high_fragment_inserted").otherwise("high_fragment_remove_tail").alias("status"),
    )


def strong_slots(original: Column, current: Column, proposed: Column, critic: Column, fragments: Column, original_fragments: Column, fallback: Column, observed: Column) -> Column:
    """Struct (ranking, inserted, status): proposals stronger than the first three originals, behind the deepest observed of those."""
    firsts = F.transform(take(original, 3), lambda k: _of(original_fragments, k, None))
    unknown = fallback | F.exists(firsts, lambda x: x.isNull())
    level = F.array_max(firsts)
    gate = F.coalesce(_of(fragments, F.get(proposed, F.lit(0))) <= level, F.lit(True))
    strong = F.filter(take(proposed, 3), lambda k: (_of(fragments, k) > level) & (_of(critic, k, None) > _of(critic, F.get(original, F.lit(0)), None) + 0.05))
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(unknown | gate, current).otherwise(inserted(original, strong, supported_prefix(original, observed), 3)).alias("ranking"),
        F.when(unknown | gate, none).otherwise(strong).alias("inserted"),
        F.when(unknown, "strong_original_evidence_fallback").when(gate, "strong_original_gate_fallback").otherwise("high_strong_slot_inserted").alias("status"),
    )


def keeps_prefix(prior: Column, result: Column, n: int = 10) -> Column:
    """Whether the first n keys are unchanged."""
    return take(prior, n) == take(result, n)


def never_worse(old: Column, new: Column) -> Column:
    """Whether every key of old is in new, at the same place or a better one."""
    old_, new_ = F.array_distinct(old), F.array_distinct(new)
    return F.forall(old_, lambda k: (F.array_position(new_, k) > 0) & (F.array_position(new_, k) <= F.array_position(old_, k)))


def reciprocal_rank(key: Column, ranking: Column, size: int | None = None) -> Column:
    """1 / place of the key, 0 if it isn't there (or beyond the size) or is null."""
    at = F.array_position(take(ranking, size) if size else ranking, key)
    return F.coalesce(F.when(at > 0, 1.0 / at), F.lit(0.0))


def overlap(a: Column, b: Column, k: int) -> Column:
    return F.size(F.array_intersect(take(a, k), take(b, k))) / F.lit(float(k))


def fused_arrays(lists: list[Column], weights: list[float | Column], offset: float = 60.0) -> Column:
    """Reciprocal-rank fusion of short lists within a row: keys by falling score, then by key.  Lists of weight 0 vanish with their keys."""
    gone = F.array().cast("array<string>")
    kept = [F.when(w != 0, x).otherwise(gone) if isinstance(w, Column) else x if w else gone for x, w in zip(lists, weights, strict=True)]
    keys = F.array_distinct(F.flatten(F.array(*kept)))

    def score(k: Column) -> Column:
        total = F.lit(0.0)
        for x, w in zip(kept, weights, strict=True):
            at = F.array_position(x, k)
            total = total + F.when(at > 0, (w if isinstance(w, Column) else F.lit(float(w))) / (offset + at)).otherwise(0.0)
        return total

    return F.transform(F.array_sort(F.transform(keys, lambda k: F.struct((-F.round(score(k), 12)).alias("s"), k.alias("k")))), lambda p: p["k"])


def route(kind: Column, baseline: Column, current: Column, neural: Column, confidence: Column, margin: Column, threshold: Column, least_margin: Column, weight: Column) -> Column:
    """The ranking a configuration chooses: kinds retrieval, current_guard, margin, protect_top1, free_top1."""
    guard = guarded(current, fused_arrays([current, neural], [0.25, 0.75]), confidence, 0.65)
    fused = fused_arrays([extended(baseline, current), neural], [1 - weight, weight])
    closed = (confidence >= threshold) | ((kind == "margin") & (margin >= least_margin))
    return (
        F.when(kind == "retrieval", baseline).when(kind == "current_guard", guard).when(closed, baseline)
        .when(kind == "protect_top1", F.concat(take(baseline, 1), F.array_except(fused, take(baseline, 1)))).otherwise(fused)
    )


def second_place(tokens: Column, engine: Column, identity, size: int = SIZE, placeholder: str = "CCO") -> Column:
    """Struct (ranking, status, moved_from): the first usable value of another engine put at place 2.

    identity is a function of a column; null marks an unusable value.  The
    row stays if it is empty or led by the placeholder (skipped), without
    other values (no_eng), if the first usable one has no identity or holds
    a separator (invalid_x2) or that of the head (same_as_rank1).  Where it
    holds place 2 already its later twins go (already_rank2); else all twins
    go, the value comes second, and the list is cut (inserted).
    """
    blank = lambda s: s.isNull() | F.trim(s).isin("", placeholder)
    head = F.get(tokens, F.lit(0))
    x2 = F.trim(F.get(F.filter(engine, lambda s: ~blank(s)), F.lit(0)))
    kx = F.when(~x2.rlike("[;\r\n]"), identity(x2))
    keys = F.transform(tokens, lambda t: identity(t))

    def placed(v: Column) -> Column:
        ks, k, x = v["ks"], v["k"], v["x"]
        at = F.array_position(ks, k)
        others = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), ks.alias("k")), lambda p: ~p["k"].eqNullSafe(k)), lambda p: p["t"])
        new = take(F.concat(take(others, 1), F.array(x), rest(others, 1)), size)
        twins = take(F.concat(take(others, 1), F.array(F.get(tokens, F.lit(1))), rest(others, 1)), size)
        status = (
            F.when((F.coalesce(F.size(tokens), F.lit(0)) == 0) | blank(head), "skipped").when(F.coalesce(F.size(engine), F.lit(0)) == 0, "no_eng").when(k.isNull(), "invalid_x2")
            .when(k.eqNullSafe(F.get(ks, F.lit(0))), "same_as_rank1").when(at == 2, "already_rank2").otherwise("inserted")
        )
        return let(status, lambda s: F.struct(
            F.when(s == "inserted", new).when(s == "already_rank2", twins).otherwise(tokens).alias("ranking"), s.alias("status"),
            F.when(s == "already_rank2", "2").when((s == "inserted") & (at > 0), at.cast("string")).when(s == "inserted", "absent").alias("moved_from"),
        ))

    return let(F.struct(keys.alias("ks"), kx.alias("k"), x2.alias("x")), placed)


def partly_promoted(base: Column, generated: Column, prefix: int, front: int, slots: int = 5) -> Column:
    """Of the first novel keys some lead, the others follow the prefix."""
    if not 1 <= front <= slots or prefix < 0:
        raise ValueError("between one and all slots lead, behind no negative prefix")
    new = take(novel(base, generated), slots)
    return F.concat(take(new, front), take(base, prefix), rest(new, front), rest(base, prefix))


def leader_promoted(original: Column, selected: Column) -> Column:
    """The first key inserted behind three moved to the head; null if that is not how the list came about."""
    new = novel(original, selected)
    lead = F.get(new, F.lit(0))
    fine = (F.size(new) > 0) & (inserted(original, new, 3, 3) == selected)
    return F.when(fine, led(lead, selected))


def supported_promoted(original: Column, current: Column, added: Column, critic: Column, fragments: Column, fallback: Column) -> Column:
    """Struct (ranking, supported): added keys above all of the first three originals by fragments and the head by the critic lead."""
    level = F.array_max(F.transform(take(original, 3), lambda k: _of(fragments, k)))
    strong = F.filter(added, lambda k: ~fallback & (_of(fragments, k) > F.greatest(level, F.lit(0.0))) & (_of(critic, k, None) > _of(critic, F.get(original, F.lit(0)), None) + 0.05))
    return let(strong, lambda s: F.struct(F.concat(s, F.array_except(current, s)).alias("ranking"), s.alias("supported")))


def individual_fragment(current: Column, tail: Column, proposed: Column, candidates: Column, critic: Column, fragments: Column, fallback: Column, slots: int = 3, prefix: int = 3) -> Column:
    """As high_fragment(), with the gate for each proposal on its own."""
    first = F.get(current, F.lit(0))
    blind = ~informative(proposed, fragments)
    none = F.array().cast("array<string>")
    strong = F.filter(proposed, lambda k: (_of(fragments, k) > _of(fragments, first)) & (_of(critic, k, None) > _of(critic, first, None) + 0.05))
    any_ = F.size(strong) > 0
    return F.struct(
        F.when(fallback | blind, tail).when(any_, inserted(current, strong, prefix, slots)).otherwise(current).alias("ranking"),
        F.when(fallback | blind, take(candidates, slots)).when(any_, take(strong, slots)).otherwise(none).alias("inserted"),
        F.when(fallback, "high_fragment_budget_keep_tail").when(blind, "high_fragment_evidence_keep_tail").when(any_, "high_fragment_inserted").otherwise("high_fragment_remove_tail").alias("status"),
    )


def gated_merge(base: Column, base_keys: Column, other: Column, other_keys: Column, library: Column, relative: Column, strength: Column, popularity: Column, size: int = SIZE) -> Column:
    """Struct (ranking, status): another catalog's values merged by how far they stand out.

    Nothing below a library score of 0.9 stays as it is.  Far outliers take
    the slots 2, 4, 6, 8, 10, others 4, 8, 12, 16, 20; strong and popular ones, and
    clear outliers, lead as well.
    """
    wide, narrow = [4, 8, 12, 16, 20], [2, 4, 6, 8, 10]
    none, sure = F.coalesce(F.size(other), F.lit(0)) == 0, library >= 0.9
    far = F.coalesce(relative > 600, F.lit(False))
    leads = F.coalesce((strength > 6) & (popularity >= 5), F.lit(False)) | F.coalesce(relative > 250, F.lit(False))
    merge = lambda slots: F.when(leads, promoted(base, base_keys, other, other_keys, slots, size)).otherwise(merged_at(base, base_keys, other, other_keys, slots, size))
    return F.struct(
        F.when(none | sure, take(base, size)).when(far, merge(narrow)).otherwise(merge(wide)).alias("ranking"),
        F.when(none, "no_other").when(sure, "untouched").when(far & leads, "aggressive_promoted").when(far, "aggressive").when(leads, "gentle_promoted").otherwise("gentle").alias("status"),
    )


def joint_slots(prior: Column, current: Column, proposed: Column, fragments: Column, original_fragments: Column, fallback: Column, prefix: Column | int = 1, critic: Column | None = None, slots: int = 3) -> Column:
    """Struct (ranking, promoted): proposals put into the prior ranking where the first of them beats its first three by fragments, all of which are known.

    Without a critic the first ``slots`` proposals go in, as they are; with
    one those that beat the three themselves, and the head by the critic.
    """
    firsts = F.transform(take(prior, 3), lambda k: _of(original_fragments, k, None))
    level = F.array_max(firsts)
    open_ = ~fallback & ~F.exists(firsts, lambda x: x.isNull()) & (_of(fragments, F.get(proposed, F.lit(0))) > level)
    strong = proposed if critic is None else F.filter(proposed, lambda k: (_of(fragments, k) > level) & (_of(critic, k, None) > _of(critic, F.get(prior, F.lit(0)), None) + 0.05))
    fine = F.coalesce(open_, F.lit(False))
    return F.struct(F.when(fine, inserted(prior, take(strong, slots), prefix, slots)).otherwise(current).alias("ranking"), fine.alias("promoted"))


def fused_tail(prior: Column, current: Column, native: Column, critic: Column, prefix: int = 10, slots: int = 3, margin: float = 0.05) -> Column:
    """Struct (ranking, promoted): proposals in the order of their own ranking and the critic's, fused with equal votes, behind a prefix; only if the first of them beats the prior's head by a margin."""
    by_critic = F.transform(F.array_sort(F.transform(native, lambda k: F.struct((-_of(critic, k, None)).alias("s"), k.alias("k")))), lambda p: p["k"])
    order = fused_arrays([by_critic, native], [0.5, 0.5])

    def placed(o: Column) -> Column:
        better = F.coalesce(_of(critic, F.get(o, F.lit(0)), None) > _of(critic, F.get(prior, F.lit(0)), None) + margin, F.lit(False))
        return F.struct(F.when(better, inserted(prior, o, prefix, slots)).otherwise(current).alias("ranking"), better.alias("promoted"))

    return let(order, placed)


def runner_up(tokens: Column, engine: Column, identity, size: int = SIZE, looked_at: int = 3) -> Column:
    """second_place(), and where its value is the head's own twin, the first of the engine's first three values with another identity instead."""
    usable = lambda s: F.when(~s.rlike("[;\r\n]"), identity(F.trim(s)))
    other = F.filter(take(engine, looked_at), lambda s: usable(s).isNotNull() & (usable(s) != identity(F.get(tokens, F.lit(0)))))
    first, second = second_place(tokens, engine, identity, size), second_place(tokens, take(other, 1), identity, size)
    return F.when((first["status"] == "same_as_rank1") & (F.size(other) > 0), second).otherwise(first)


def evidence_order(ordered: Column, existing: Column, scores: Column, weight: float) -> Column:
    """Generated keys that a ranking lacks, reranked among themselves by a score (a map; missing: 0)."""
    return reranked(novel(existing, ordered), scores, weight)
