"""Quality rules decided per host, with rates shrunk by an empirical beta prior.

Each document is tested alone first.  The failures are then summed by host
(one partial aggregate per task, so a host with a third of all rows costs no
more than another), the hosts' rates give a beta prior by the method of
moments, and a host whose failure rate lies above a limit with confidence
rejects its remaining documents as well.

Defined results: a null text has no words and fails; a null host gets no
verdict of its own; repeated rows are separate documents; an empty table
gives an empty result; computed columns replace input columns of their name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, cut, packed, unpacked, words, written

SYMBOLS = "#*$%&|<>"
RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
VERDICT = ["host_docs", "host_failed_docs", "host_rate", "host_rejected"]
#: A broadcast verdict table has so many rows at most (a name and three numbers each); above, the join is shuffled.
BROADCAST_HOSTS = 20_000


def rule_columns(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """Every input row packed, its host, and the columns of RULES.

    A three-word window counts as found again when the 64-bit hash of its
    words is; within a text of 20,000 words the chance of a wrong match is
    about 1e-11.  The sorted windows' neighbours tell which are repeated, and
    the gaps between repeated windows how many words those cover.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    df = packed(docs, F.col(f"`{host}`").cast("string").alias("__host"), t.alias("__text"), words(t).alias("__w"))
    n, after = F.size("__w"), 2**30  # not more: start and length are added as 32-bit integers
    windows = F.transform(
        F.slice(F.arrays_zip(F.col("__w").alias("a"), F.slice("__w", 2, after).alias("b"), F.slice("__w", 3, after).alias("c")), F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda x: F.xxhash64(x["a"], x["b"], x["c"]),
    )
    lines = F.filter(F.split("__text", "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    df = df.select(
        "__row", "__host", n.alias("n_words"),
        F.length(F.translate("__text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"), windows.alias("__h"),
    )
    # only texts with a repeated window go through the sort
    again = F.size("__h") > F.size(F.array_distinct("__h"))
    df = df.withColumn("__s", F.when(again, F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn(
        "__z", F.arrays_zip(F.col("__s").alias("own"), F.slice("__s", 2, after).alias("next"), F.concat(F.slice("__s", 1, 1), F.col("__s")).alias("before"))
    )
    at = F.transform(
        F.filter("__z", lambda z, j: z["own"].isNotNull() & (z["own"]["h"].eqNullSafe(z["next"]["h"]) | ((j > 0) & z["own"]["h"].eqNullSafe(z["before"]["h"])))),
        lambda z: z["own"]["i"],
    )
    df = df.withColumn("__at", F.array_sort(at))
    gaps = F.zip_with(F.col("__at"), F.slice("__at", 2, after), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    covered = F.when(F.size("__at") > 0, F.aggregate(gaps, F.lit(0), lambda s, x: s + x)).otherwise(0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = df.withColumn("n_words", F.col("n_words").cast("long")).withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    dup = (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")
    # generated rather than projected: a filter on a rule would else be pushed down with its whole expression, into the lambdas as well
    one = F.struct("n_words", "word_chars", "n_symbols", dup.alias("n_dup_lines"), "n_repeat_words", failed.alias("base_failed"))
    return df.select("__row", "__host", F.inline(F.array(one)))


def host_verdicts(rules: DataFrame, limit: float = 0.5, confidence: float = 1.645) -> DataFrame:
    """One row per host: documents, failures, shrunk rate, verdict.

    The prior Beta(m*M, (1-m)*M) has the mean m of all documents; M comes from
    the variance between hosts beyond what chance explains (method of
    moments, within 1 and 1e6).  A host is rejected when the posterior mean
    less ``confidence`` standard deviations is at least ``limit``.
    """
    hosts = cut(
        rules.where(F.col("__host").isNotNull())
        .groupBy("__host")
        .agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed_docs"))
    )
    k, n = F.col("host_failed_docs"), F.col("host_docs")
    total = hosts.agg(F.count("*").alias("h"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(n.cast("double") * n).alias("nn"), F.sum(k.cast("double") * k / n).alias("kk")).first()
    mean, strength = 0.0, 1.0
    if total["n"]:
        mean = total["k"] / total["n"]
        spread = total["kk"] - total["k"] * mean
        room = total["n"] - total["nn"] / total["n"] - (total["h"] - 1)
        between = (spread - (total["h"] - 1) * mean * (1 - mean)) / room if room > 0 else 0.0
        strength = min(1e6, max(1.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e6
    a, b = mean * strength, (1 - mean) * strength
    rate = (k + F.lit(a)) / (n + F.lit(a + b))
    low = rate - confidence * F.sqrt(rate * (1 - rate) / (n + F.lit(a + b + 1)))
    return hosts.select("__host", "host_docs", "host_failed_docs", F.round(rate, 6).alias("host_rate"), (low >= limit).alias("host_rejected"))


def join_verdicts(rules: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rules and verdicts by host.  Few hosts are broadcast, which is checked; for more the join is shuffled, with a hot host split by AQE."""
    few = verdicts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    df = rules.join(F.broadcast(verdicts) if few else verdicts.hint("merge"), "__host", "left")
    return df.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False))).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def host_quality(docs: DataFrame, text: str = "text", host: str = "source", limit: float = 0.5) -> DataFrame:
    """All input rows with RULES, VERDICT and ``kept``.

    Rows and rules are written once to a table in the shared folder, whose
    narrow columns give the sums by host; the texts are never shuffled unless
    there are more hosts than BROADCAST_HOSTS.
    """
    rules = written(rule_columns(docs, text, host), "rules")
    df = join_verdicts(rules, host_verdicts(rules, limit))
    return unpacked(df, docs.columns, *RULES, *VERDICT, "kept")


def kept_documents(docs: DataFrame, text: str = "text", host: str = "source", limit: float = 0.5) -> DataFrame:
    """The input rows that are kept, in the columns of docs.

    As host_quality(), but a row that fails the rules alone leaves only its
    host and its failure in the table.
    """
    rules = rule_columns(docs, text, host)
    narrow = written(rules.select(F.when(~F.col("base_failed"), F.col("__row")).alias("__row"), "__host", "base_failed"), "kept")
    df = join_verdicts(narrow, host_verdicts(narrow.select("__host", "base_failed"), limit))
    return df.where("kept").select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
