"""Generators of rows as table functions, for SQL and for DataFrames: partitioned input, a schema found when the query is analysed."""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from . import evidence

#: What a row of the input must have: a peak, and its spectrum's precursor and rules (the names that evidence.rules_for() leaves it).
PEAK = ("spectrum", "at", "mz", "intensity", "precursor_mz", "rules")
MATCH = [("rule", T.StringType()), ("kind", T.StringType()), ("mz", T.DoubleType()), ("error_da", T.DoubleType()), ("strength", T.DoubleType()), ("from_at", T.IntegerType()), ("to_at", T.IntegerType())]


@dataclass
class Analyzed(AnalyzeResult):
    """The rules by name, read once for all partitions."""

    rules: dict = field(default_factory=dict)
    ppm: float = 10.0
    absolute: float = 0.002


class EvidenceMatches:
    """evidence_matches(TABLE(peaks), rules, ppm, absolute): evidence.matches() of each spectrum.

    The input is dealt by spectrum and ordered by m/z, so that pairs of peaks
    are found by bisection; one spectrum's peaks are held at a time.  ``rules``
    is a JSON object from a rule's name to its kind ('ion' or 'loss') and mass.
    """

    @staticmethod
    def analyze(peaks: AnalyzeArgument, rules: AnalyzeArgument, ppm: AnalyzeArgument, absolute: AnalyzeArgument) -> Analyzed:
        if not peaks.isTable:
            raise ValueError("the first argument is a table of peaks")
        missing = [c for c in PEAK if c not in peaks.dataType.names]
        if missing:
            raise ValueError(f"the peaks lack {', '.join(missing)}")
        if not rules.isConstantExpression or rules.value is None:
            raise ValueError("the rules are a constant JSON object")
        schema = T.StructType([T.StructField("spectrum", peaks.dataType["spectrum"].dataType)])
        for name, kind in MATCH:
            schema.add(name, kind)
        return Analyzed(schema=schema, partitionBy=[PartitioningColumn("spectrum")], orderBy=[OrderingColumn("mz"), OrderingColumn("at")], rules=json.loads(rules.value), ppm=float(ppm.value), absolute=float(absolute.value))

    def __init__(self, analyzed: Analyzed):
        self.of = analyzed
        self.peaks: list[tuple[float, int, float]] = []
        self.spectrum, self.precursor, self.use = None, 0.0, []

    def eval(self, peak: Row, *_: object) -> None:
        self.spectrum, self.precursor, self.use = peak["spectrum"], peak["precursor_mz"], peak["rules"] or []
        self.peaks.append((peak["mz"], peak["at"], peak["intensity"]))

    def _room(self, x: float) -> float:
        return max(self.of.absolute, abs(x) * self.of.ppm * 1e-6)

    def terminate(self) -> Iterator[tuple]:
        masses = [m for m, *_ in self.peaks]
        for rule in self.use:
            kind, shift = self.of.rules[rule]["kind"], self.of.rules[rule]["mass"]
            for m, at, i in self.peaks:
                if kind == "ion":
                    if abs(m - shift) <= self._room(shift):
                        yield self.spectrum, rule, "ion", m, m - shift, i**0.5, -2, at
                    continue
                error = self.precursor - m - shift
                if self.precursor > m and abs(error) <= self._room(self.precursor) + self._room(m):
                    yield self.spectrum, rule, "precursor_loss", m, error, i**0.5, -1, at
                target = m + shift
                room = self._room(m) + self._room(target)
                for k in range(bisect_left(masses, target - room - 1e-9), bisect_right(masses, target + room + 1e-9)):
                    other, at2, i2 = self.peaks[k]
                    if at2 > at and abs(other - target) <= room:
                        yield self.spectrum, rule, "peak_loss", m, other - m - shift, min(i, i2) ** 0.5, at2, at


def register(spark: SparkSession) -> None:
    """evidence_matches for SQL: in FROM, also with LATERAL."""
    spark.udtf.register("evidence_matches", F.udtf(EvidenceMatches))


def rules_json(rules: DataFrame) -> str:
    """A table of rules, a few rows, as the function takes it."""
    return json.dumps({r["rule"]: {"kind": r["kind"], "mass": r["mass"]} for r in rules.select("rule", "kind", "mass").collect()}, sort_keys=True)


def peaks_with_rules(spectra: DataFrame, peaks: DataFrame, rules: DataFrame) -> DataFrame:
    """The peaks of spectra that may use any rule, each with its precursor and the names of the rules."""
    use = evidence.rules_for(spectra, rules).groupBy("spectrum", "precursor_mz").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    return peaks.select("spectrum", "at", "mz", "intensity").join(use, "spectrum").select(*PEAK)


def evidence_matches(spectra: DataFrame, peaks: DataFrame, rules: DataFrame, ppm: float = 10.0, absolute: float = 0.002) -> DataFrame:
    """evidence.matches() through the table function."""
    register(spectra.sparkSession)
    table = peaks_with_rules(spectra, peaks, rules)
    return F.udtf(EvidenceMatches)(table.asTable(), F.lit(rules_json(rules)), F.lit(ppm), F.lit(absolute))
