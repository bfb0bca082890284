"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target number of words.  Whole epochs come first: each
document as often as the target holds the source's size.  The rest is filled
from one more pass in the order of exponential keys -ln(u) / w, where u comes
from a hash of the document and w is its quality weight, up to the budget; the
document at the budget gives only the words still needed.

No source is sorted as a whole.  A monotone function of the key assigns
128 x 128 x 128 bins; sums by coarse bin show which one holds the budget's
end, sums by finer bins within that one narrow it twice, and only the rows of
the last bin are sorted.  What comes back is a cut key for each source, and
the taken words follow from it row by row, without a shuffle of texts.

Defined results: null and empty texts have size 0 and take nothing; null is a
source of its own, the last; rows that repeat in id, source and text share
what their key takes evenly, some of them a word more, so that nothing of the
budget is lost; texts are taken whole, however long; an empty table or one
without words gives targets of 0; computed columns replace input columns of
their name in mixed(), and in mixture(), which gives the documents' columns,
input columns of those names go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, SPACE, SPACE_CHARS, cut, packed, unpacked, unsigned, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: A broadcast plan has so many sources at most; above, the join is shuffled.
BROADCAST_SOURCES = 20_000
BINS = 128


def quality_weight(text: Column) -> Column:
    """From 0.5 to 1: half, plus half the share of characters other than digits and symbols."""
    odd = F.length(text) - F.length(F.translate(text, "0123456789#*$%&|<>{}[]_=+~^\\", ""))
    return 0.5 + 0.5 * (1 - F.coalesce(odd / F.greatest(F.length(text), F.lit(1)), F.lit(0.0)))


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: str = "mix") -> DataFrame:
    """The packed row, __source, __size and __key, smaller first."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    u = (unsigned(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.md5(t))) + 0.5) / 2.0**52
    return packed(docs, F.col(f"`{source}`").cast("string").alias("__source"), F.size(words(t)).cast("long").alias("__size"), (-F.log(u) / quality_weight(t)).alias("__key"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """__source, source_size, target, from one row per source.

    Sources that reach ``most`` times their size are those with the smallest
    limit for their weight: in that order, a source is limited when its limit
    is below its part of what the limited ones before it leave.  Sizes of
    0 have a target of 0.  Windows over one row per source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sizes.withColumn("w", w).withColumn("limit", (most * F.col("source_size")).cast("double"))
    order = [F.col("limit") / F.col("w"), F.col("__source").asc_nulls_last()]
    earlier, all_ = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    df = df.withColumn("budget", share * F.sum("source_size").over(all_))
    df = df.withColumn("left", F.col("budget") - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0)))
    df = df.withColumn("open", F.sum("w").over(all_) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0)))
    df = df.withColumn("limited", F.col("limit") < F.col("left") * F.col("w") / F.col("open"))
    # the first that is not limited sets the level for itself and all after it
    df = df.withColumn("at", F.row_number().over(Window.orderBy(*order)))
    level = F.min(F.when(~F.col("limited"), F.struct("at", (F.col("left") / F.col("open")).alias("level")))).over(all_)["level"]
    return df.select("__source", "source_size", F.least("limit", F.coalesce(level, F.lit(float("inf"))) * F.col("w")).alias("target"))


def _bin(step: int) -> Column:
    """The key's bin at a step, 0 to BINS - 1: digits of a number that rises with the key."""
    share = 1 - F.exp(-0.75 * F.col("__key"))
    whole = F.floor(share * BINS**3).cast("long")
    return F.least(F.greatest(F.floor(whole / BINS ** (2 - step)).cast("long") % BINS, F.lit(0)), F.lit(BINS - 1))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: __source, source_size, target, __epochs, __cut (the key at the budget, null: none), __rest (words it gives), __ties (rows with that key).

    ``rows`` has __source, __size and __key, and is read once a step.
    """
    sizes = cut(rows.groupBy("__source").agg(F.sum("__size").alias("source_size")))
    goal = targets(sizes, weights, share, most).withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = cut(goal.withColumn("__budget", F.floor(F.col("target")).cast("long") - F.col("__epochs") * F.col("source_size")))
    few = goal.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    # null sources meet by a flag and a name, which joins as a key does
    name = lambda df: df.withColumn("__none", F.col("__source").isNull()).withColumn("__source", F.coalesce("__source", F.lit("")))
    here, now = name(rows.where("__size > 0")), name(goal.select("__source", F.col("__budget").alias("__need")).where("__need > 0"))
    ends = Window.partitionBy("__none", "__source").orderBy("__bin")
    for step in range(3):
        # rows of the bin that holds the budget's end, sum by bins within it
        chosen = here.withColumn("__bin", _bin(step)).join(F.broadcast(now) if few else now.hint("merge"), ["__none", "__source"])
        if step:
            chosen = chosen.where(F.col("__at") == _path(step))
        sums = chosen.groupBy("__none", "__source", "__bin", "__need", *(["__at"] if step else [])).agg(F.sum("__size").alias("s"))
        sums = sums.withColumn("to", F.sum("s").over(ends)).where((F.col("to") >= F.col("__need")) & (F.col("to") - F.col("s") < F.col("__need")))
        at = F.col("__at") * BINS + F.col("__bin") if step else F.col("__bin")
        now = cut(sums.select("__none", "__source", (F.col("__need") - (F.col("to") - F.col("s"))).alias("__need"), at.alias("__at")))
    last = here.join(F.broadcast(now) if few else now.hint("merge"), ["__none", "__source"]).where(F.col("__at") == _path(3))
    ties = last.groupBy("__none", "__source", "__key", "__need").agg(F.sum("__size").alias("s"), F.count("*").alias("__ties"))
    ties = ties.withColumn("to", F.sum("s").over(Window.partitionBy("__none", "__source").orderBy("__key"))).where((F.col("to") >= F.col("__need")) & (F.col("to") - F.col("s") < F.col("__need")))
    ties = ties.select("__none", "__source", F.col("__key").alias("__cut"), (F.col("__need") - (F.col("to") - F.col("s"))).alias("__rest"), "__ties")
    return cut(name(goal).join(ties, ["__none", "__source"], "left"))


def _path(steps: int) -> Column:
    at = _bin(0)
    for step in range(1, steps):
        at = at * BINS + _bin(step)
    return at


def apply_plan(rows: DataFrame, of: DataFrame) -> DataFrame:
    """The rows with source_size, target, taken.

    Rows that share the key at the budget are copies, and give as many words
    each, the first of them one more where that doesn't come out even.  Only
    then they are numbered, each partition by itself, from what the
    partitions before it hold.
    """
    few = of.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    df = rows.withColumn("__none", F.col("__source").isNull()).withColumn("__source", F.coalesce("__source", F.lit("")))
    df = df.join(F.broadcast(of) if few else of.hint("merge"), ["__none", "__source"])
    at = F.coalesce((F.col("__key") == F.col("__cut")) & (F.col("__size") > 0), F.lit(False))
    each, over = F.floor(F.col("__rest") / F.col("__ties")).cast("long"), F.col("__rest") % F.col("__ties")
    more = F.when(F.col("__key") < F.col("__cut"), F.col("__size")).when(at, each).otherwise(0)
    taken = (F.col("__epochs") * F.col("__size") + more).cast("long")
    if not of.where(over > 0).limit(1).count():
        return df.withColumn("taken", taken)
    uneven = at & (over > 0)
    tied = cut(df.where(uneven)).withColumn("__part", F.spark_partition_id())
    by = ["__none", "__source"]
    held = tied.groupBy("__part", *by).agg(F.count("*").alias("__n"))
    before = held.select("__part", *by, (F.sum("__n").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part", *by).orderBy("__key"))
    numbered = tied.withColumn("__place", place).join(before, ["__part", *by])
    extra = F.when(F.col("__before") + F.col("__place") <= over, 1).otherwise(0)
    numbered = numbered.withColumn("taken", (taken + extra).cast("long")).drop("__part", "__place", "__before")
    return df.where(~uneven).withColumn("taken", taken).unionByName(numbered)


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """All input rows with size, source_size, target, taken."""
    rows = keyed(docs, text, doc_id, source)
    of = plan(cut(rows.select("__source", "__size", "__key")))
    df = apply_plan(rows, of).withColumn("size", F.col("__size"))
    return unpacked(df, docs.columns, "size", "source_size", "target", "taken")


def mixture(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", chars: str | None = "n_chars") -> DataFrame:
    """The mix itself: a row for every time a document is taken, in the columns of docs.

    A document taken in part gives the beginning of its text, up to the last
    word taken; its length column, if there is one, is set anew.
    """
    own = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")]
    df = mixed(docs.select(*[f"`{c}`" for c in own]), text, doc_id, source)
    copies = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")).cast("long")), lambda i: F.least(F.col("taken") - i * F.col("size"), F.col("size")))
    df = packed(df.where("taken > 0"), F.col("size").alias("__size"), F.explode(copies).alias("__words"))
    whole = F.col(f"{ROW}.`{text}`")
    # what is left after the words taken, with the white space before it
    trimmed = F.regexp_replace(whole, f"^{SPACE}", "")
    rest = F.element_at(F.split(trimmed, SPACE, F.col("__words").cast("int") + 1), -1)
    part = F.rtrim(F.substring(trimmed, F.lit(1), (F.length(trimmed) - F.length(rest)).cast("int")), F.lit(SPACE_CHARS))
    df = df.withColumn("__new", F.when(F.col("__words") < F.col("__size"), part).otherwise(whole))
    cols = []
    for c in own:
        if c == text:
            cols.append(F.col("__new").alias(c))
        elif c == chars:
            kind = docs.schema[c].dataType
            cols.append(F.when(F.col("__words") < F.col("__size"), F.length("__new").cast(kind)).otherwise(F.col(f"{ROW}.`{c}`")).alias(c))
        else:
            cols.append(F.col(f"{ROW}.`{c}`").alias(c))
    return df.select(*cols)
