"""List algebra against plain versions."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ionsift.functions import lists

KEYS = st.lists(st.sampled_from([f"k{i}" for i in range(40)]), unique=True, max_size=30)


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(KEYS, KEYS, st.sampled_from([0.5, 0.75, 0.9])), min_size=20, max_size=40))
def test_interleaved(spark, cases):
    """What the written rule says of any result: heads, no repeats, both orders, five analogs at most in a row, nothing left out that had room."""
    found = one(spark, cases, "l array<string>, a array<string>, t double", lists.interleaved(F.col("l"), F.col("a"), F.col("t")))
    for (library, analog, top), out in zip(cases, found, strict=True):
        heads = min(len(library), 2 if top >= 0.75 else 1)
        assert out[:heads] == library[:heads]
        assert len(out) == len(set(out)) == min(25, len({*library, *analog}))
        for own, other in ((library, analog), (analog, library)):
            only = [k for k in out if k not in other]
            assert only == [k for k in own if k not in other][: len(only)]
        gap = 0
        for n, k in enumerate(out[heads:], heads):
            gap = gap + 1 if k not in library else 0
            assert gap <= 5 or not set(library) - set(out[:n])


def test_interleaved_disjoint(spark):
    """Lists without a common key: heads, then blocks of five analogs and one library key."""
    library, analog = [f"l{i}" for i in range(20)], [f"a{i}" for i in range(30)]
    want = {t: [*library[:h], *[k for b in range(4) for k in (*analog[5 * b : 5 * b + 5], library[h + b])]][:25] for t, h in ((0.5, 1), (0.75, 2))}
    cases = [(library, analog, 0.5), (library, analog, 0.75), ([], analog, 0.9), (library, [], 0.1), ([], [], 0.9), (library[:1], analog, 0.9)]
    found = one(spark, cases, "l array<string>, a array<string>, t double", lists.interleaved(F.col("l"), F.col("a"), F.col("t")))
    assert found == [want[0.5], want[0.75], analog[:25], library, [], [library[0], *analog[:24]]]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(KEYS, KEYS), min_size=20, max_size=40))
def test_merged_at(spark, cases):
    """News stand at the slots in order while there are any, base values elsewhere in order, and the rest of the news where the base is used up."""
    a, b = F.col("a"), F.col("b")
    slots = [2, 4, 8]
    found = one(spark, cases, "a array<string>, b array<string>", lists.merged_at(a, a, b, b, slots))
    for (base, other), out in zip(cases, found, strict=True):
        news = [k for k in other if k not in base]
        assert len(out) == len(set(out)) == min(25, len(base) + len(news))
        places = [i for i, k in enumerate(out, 1) if k in news]
        assert [out[i - 1] for i in places] == news[: len(places)]
        old = [k for k in out if k in base]
        assert old == base[: len(old)]
        last = max((i for i, k in enumerate(out, 1) if k in base), default=0)
        early = [i for i in places if i < last]
        assert early == [s for s in slots[: len(news)] if s < last]


def test_slots_and_guards(spark):
    """Two shelves of books: what goes between, what goes first, and who decides."""
    row = [(["atlas", "bible", "codex", "diary"], ["essay", "bible", "fable"], ["fable", "diary", "codex"])]
    schema = "shelf array<string>, cart array<string>, wish array<string>"
    shelf, cart, wish = (F.col(c) for c in ("shelf", "cart", "wish"))
    assert one(spark, row, schema, lists.merged_at(shelf, shelf, cart, cart, [1, 4])) == [["essay", "atlas", "bible", "fable", "codex", "diary"]]
    assert one(spark, row, schema, lists.inserted(shelf, cart, 3, 1)) == [["atlas", "bible", "codex", "essay", "diary"]]
    assert one(spark, row, schema, lists.inserted(shelf, cart, 0, 9)) == [["essay", "fable", "atlas", "bible", "codex", "diary"]]
    sure = one(spark, row, schema, lists.guarded(shelf, wish, F.lit(0.71), 0.7))[0]
    assert sure == ["atlas", "bible", "codex", "diary"]
    assert one(spark, row, schema, lists.fused_arrays([shelf, wish], [1.0, 0.0])) == [["atlas", "bible", "codex", "diary"]]
    assert one(spark, row, schema, lists.fused_arrays([F.reverse(wish), wish], [0.5, 0.5])) == [["codex", "fable", "diary"]]
    assert one(spark, row, schema, lists.never_worse(F.slice(shelf, 1, 2), shelf)) == [True]
    assert one(spark, row, schema, lists.never_worse(F.slice(shelf, 2, 2), shelf)) == [False]
    assert one(spark, row, schema, lists.keeps_prefix(shelf, F.concat(F.slice(shelf, 1, 2), cart), 2)) == [True]
    assert one(spark, row, schema, lists.keeps_prefix(shelf, wish, 1)) == [False]


def test_branches(spark):
    row = [(["a", "b", "c"], ["x", "y", "z"], {"a": 0.1, "x": 0.5, "y": 0.2, "z": 0.1}, {"a": 0.2, "x": 0.9, "y": 0.4})]
    schema = "cur array<string>, pro array<string>, fr map<string,double>, cr map<string,double>"
    cur, pro, fr, cr = (F.col(c) for c in ("cur", "pro", "fr", "cr"))
    low = one(spark, row, schema, lists.low_fragment(cur, pro, cr, fr, F.lit(False), True))[0]
    assert (low["ranking"], low["status"]) == (["x", "a", "b", "c", "y", "z"], "low_supported_leader_first")
    assert one(spark, row, schema, lists.low_fragment(cur, pro, cr, fr, F.lit(True)))[0]["status"] == "fragment_budget_fallback"
    high = one(spark, row, schema, lists.high_fragment(cur, pro, pro, pro, cr, fr, F.lit(False)))[0]
    assert (high["ranking"], high["status"]) == (["a", "b", "c", "x", "y", "z"], "high_fragment_inserted")
    assert one(spark, row, schema, lists.supported(pro, cr, F.lit("a"), fr, 0.05)) == [["x", "y"]]
    assert one(spark, row, schema, lists.relatively_supported(pro, fr, F.lit("a"))) == [["x", "y"]]
    assert one(spark, row, schema, lists.informative(pro, fr)) == [True]
    assert one(spark, row, schema, lists.promotion_prefix(cur, pro, cr, 2, 0.1)) == [0]


def test_signed_zeros_tie(spark):
    from ionsift.operators.ranking import ranked

    rows = [("g", k, v) for k, v in (("pear", -0.0), ("fig", 0.0), ("lime", -2.5), ("kiwi", 1e-300), ("date", -0.0))]
    df = spark.createDataFrame(rows, "grp string, key string, score double")
    assert [r["key"] for r in ranked(df, ["grp"]).orderBy("rank").collect()] == ["kiwi", "date", "fig", "pear", "lime"]
