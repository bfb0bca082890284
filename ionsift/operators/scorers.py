"""Plug-in points for what needs a chemistry or neural runtime.

A scorer is a function of Arrow columns to a column.  None is built in for
structures, neural encoders, generators or fragment engines: those runtimes
are not part of this package, and asking for one that isn't registered raises
an error instead of giving made-up numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = (
    "fingerprint", "structure_key", "metric_identity", "support_flags", "fragment_masses", "molecular_graph", "spectrum_encoder", "direct_ranker", "query_critic", "formula_predictor",
    "structure_generator", "fragment_engine", "gradient_ranker", "catalog_normalizer",
)


class MissingRuntime(RuntimeError):
    """A plug-in was asked for that nobody registered."""


class Registry:
    """Plug-ins by kind and name."""

    def __init__(self) -> None:
        self._all: dict[tuple[str, str], tuple[Callable[..., pa.Array], T.DataType]] = {}

    def register(self, kind: str, name: str, function: Callable[..., pa.Array], returns: T.DataType) -> None:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}; kinds: {', '.join(KINDS)}")
        self._all[kind, name] = function, returns

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._all if k == kind)

    def column(self, kind: str, name: str, *inputs: Column) -> Column:
        """The plug-in over Arrow batches of the inputs."""
        if (kind, name) not in self._all:
            raise MissingRuntime(f"no {kind} named {name!r} is registered")
        function, returns = self._all[kind, name]

        if len(inputs) == 1:

            def run(batches):
                for b in batches:
                    yield function(b)

            run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        else:

            def run(batches):
                for b in batches:
                    yield function(*b)

            run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, returns)(*inputs)

    def on_distinct(self, df: DataFrame, kind: str, name: str, column: str, out: str) -> DataFrame:
        """The plug-in once for each distinct value, joined back: for runtimes that cost more than a shuffle."""
        values = df.select(column).distinct().withColumn(out, self.column(kind, name, F.col(column)))
        return df.join(values, column, "left")


def reused(requests: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Requests that a table of earlier scores answers, and those it doesn't."""
    return requests.join(cache, keys), requests.join(cache.select(*keys).distinct(), keys, "left_anti")


def context_identity(**settings: Column) -> Column:
    """The digest of all settings that a score depends on, by their names' order: equal for equal settings, nulls included."""
    named = F.struct(*[settings[name].alias(name) for name in sorted(settings)])
    return F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256)


def candidate_identity(key: Column, structure: Column) -> Column:
    """The digest of a candidate's key and structure."""
    return F.sha2(F.to_json(F.array(key.cast("string"), structure.cast("string")), {"ignoreNullFields": "false"}), 256)


def admitted(results: DataFrame, scores: DataFrame, candidates: DataFrame, context: str = "context", key: str = "key", score: str = "score") -> tuple[DataFrame, DataFrame]:
    """The scores that may be reused, and each result's outcome (context, outcome).

    A result (context, status) is admitted whole or not at all: it is complete,
    and all its scores are finite and of its candidates (context, key).  Of
    several reasons the first holds: ``incomplete``, ``unknown_candidate``,
    ``invalid_score``.  A context with several results is complete if all of
    them are; scores without a result are nobody's and not admitted.
    """
    known = candidates.select(context, key).distinct().withColumn("__known", F.lit(True))
    value = F.col(score).cast("double")
    finite = F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))
    flags = scores.join(known, [context, key], "left").groupBy(context).agg(F.bool_or(F.col("__known").isNull()).alias("__foreign"), F.bool_or(~finite).alias("__odd"))
    done = results.groupBy(context).agg(F.bool_and(F.coalesce(F.col("status") == "complete", F.lit(False))).alias("__done"))
    outcome = F.when(~F.col("__done"), "incomplete").when(F.col("__foreign"), "unknown_candidate").when(F.col("__odd"), "invalid_score").otherwise("admitted")
    outcomes = done.join(flags, context, "left").select(context, outcome.alias("outcome"))
    return scores.join(outcomes.where("outcome = 'admitted'").select(context), context, "left_semi"), outcomes
