"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are runs of letters in lower case.  Each token gets a log-odds score,
how much likelier toxic documents hold it than clean ones, under a Dirichlet
prior centred on its prefix of six letters, whose own prior is its prefix of
five, then four, then even odds; a token never seen takes its longest known
prefix's score.  Every token and prefix of the documents learnt from is kept.
The k-th time in a text a token that speaks for toxicity counts 1 / k**2, for
repetition is no new evidence.  A drift is taken off so that the score of
clean text falls.

The linear-time scan for all maximal scoring segments then finds every toxic
passage of a text.  Under the extreme-value law of such segments, with the
rate solved from the scores of clean tokens and the constant fitted to clean
documents, the number of segments that reach a score by chance is a Poisson
number.  A document's evidence is minus the log of the chance that as many
segments reach the r-th best one's score, at the r for which it is least; all
of its significant segments take part.  A logistic curve turns it into a
probability.

A bounded sample of labelled documents (SAMPLE, a parameter) is split by a
hash of their ids: two thirds give the token scores, and the law and the
curve are fitted to the other third, whose texts the scores have not seen.

Defined results: texts are taken whole, however long; null and empty ones have no evidence and the score that no
evidence gives; repeated label rows count once, as toxic if any is, and of rows with
one id the text with the smallest hash is learnt from; labels that are null
or have no document are ignored; where either part of the sample lacks a
class both steps take all of it; with one class only, or without labels, the
score is the clamped share of toxic labels (0.5 without any); an empty table
gives no rows; computed columns replace input columns of their name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, packed, release, unpacked

TOKEN = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
#: Labelled documents used at most, those with the smallest hash of their id.
SAMPLE = 30_000
#: One in so many of them calibrates, the others are learnt from.
PARTS = 3
#: Weight of the prior, in documents.
PRIOR = 4.0
DRIFT = 0.5
#: The number expected by chance up to which a passage is significant: reported, and evidence.
SIGNIFICANT = 0.05
LEAST = -math.log(SIGNIFICANT)
#: Scores of tokens held by a process at most.
ENTRIES = 300_000
THRESHOLD = 0.7


def unit_hash(unit: str) -> int:
    """A token's, or a prefix's under "4:abcd", as a signed 64-bit number."""
    h = xxhash.xxh64_intdigest(unit.encode("utf-8"), 42)
    return h - (1 << 64) if h >> 63 else h


def parent_of(unit: str) -> str:
    """The prefix that a token's or prefix's prior comes from; "" for none."""
    level, _, stem = unit.rpartition(":")
    longest = int(level) - 1 if level else len(stem)
    n = next((n for n in reversed(PREFIXES) if n <= longest), 0)
    return f"{n}:{stem[:n]}" if n else ""


@dataclass
class Model:
    units: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # hashes of tokens and prefixes, rising
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))  # their log-odds
    rate: float = 1.0
    constant: float = 0.1
    weights: tuple[float, float] = (0.0, 0.0)
    store: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"store": {}}

    def lookup(self, units: list[str]) -> np.ndarray:
        """The units' scores, NaN where they are unknown."""
        keys = np.fromiter(map(unit_hash, units), dtype=np.int64, count=len(units))
        at = np.minimum(np.searchsorted(self.units, keys), max(len(self.units) - 1, 0))
        known = self.units[at] == keys if len(self.units) else np.zeros(len(keys), bool)
        return np.where(known, self.scores[at] if len(self.units) else 0.0, np.nan)

    def fresh_scores(self, tokens: list[str]) -> np.ndarray:
        """Of the token, else of its longest known prefix, else 0; less the drift."""
        found = self.lookup(tokens)
        for n in reversed(PREFIXES):
            open_ = [i for i in np.flatnonzero(np.isnan(found)).tolist() if len(tokens[i]) >= n]
            found[open_] = self.lookup([f"{n}:{tokens[i][:n]}" for i in open_])
        return np.nan_to_num(found) - DRIFT

    def token_scores(self, tokens: list[str]) -> np.ndarray:
        new = set(tokens).difference(self.store)
        if new:
            if len(self.store) + len(new) > ENTRIES:
                self.store.clear()
                new = set(tokens)
            own = list(new)
            self.store.update(zip(own, self.fresh_scores(own).tolist(), strict=True))
        scores = np.fromiter(map(self.store.__getitem__, tokens), dtype=np.float64, count=len(tokens))
        times: Counter = Counter()
        for i in np.flatnonzero(scores > 0).tolist():
            times[tokens[i]] += 1
            if (k := times[tokens[i]]) > 1:
                scores[i] = (scores[i] + DRIFT) / (k * k) - DRIFT
        return scores

    def normalized(self, score: float, n: int) -> float:
        """Minus the log of the number of such segments expected in n tokens by chance."""
        return self.rate * score - math.log(self.constant * max(n, 1))

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Minus the log of the chance of so many segments as good as the r-th best, at the r for which it is least.

        All significant segments take part, however many.  The law is one of extremes: it does not count weaker ones well, and a
        long clean text has many of them.
        """
        ranked = sorted((x for _, _, s in segments if (x := self.normalized(s, n)) >= LEAST), reverse=True)
        return max((surprise(r, x) for r, x in enumerate(ranked, start=1)), default=0.0)

    def probability(self, evidence: float) -> float:
        a, b = self.weights
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * evidence))))


def surprise(r: int, x: float) -> float:
    """-ln P(N >= r) of a Poisson number N with mean exp(-x), below one."""
    mean, term, total, k = math.exp(-min(x, 700.0)), 1.0, 1.0, r
    while term > 1e-17 * total:
        k += 1
        term *= mean / k
        total += term
    return max(mean + r * x + math.lgamma(r + 1) - math.log(total), 0.0)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order, in linear time.

    A candidate has the running sums before and after it, and a link to the
    nearest candidate before it with a smaller sum before; following links
    skips those that can't be it.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # start, end, sum before, sum after, link
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, low, high = i, i + 1, float(sums[i]), float(sums[i + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append([start, end, low, high, j])
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


# --- fitting


def sample(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, most: int) -> DataFrame:
    """toxic (0 or 1), text and part (0 calibrates) of the sampled labelled documents, kept in the shared folder.  The sample, of a fixed size at most, is broadcast."""
    own = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("__id")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("toxic"))
    few = own.orderBy(F.xxhash64("__id"), "__id").limit(most)
    part = F.pmod(F.xxhash64("__id", F.lit("part")), F.lit(PARTS)).cast("int")
    rows = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(few), "__id")
    once = rows.groupBy("__id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # an id may have any number of rows
    return cut(once.select("toxic", "text", part.alias("part")))


def _unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each unit, how many clean and toxic documents hold it, summed over a batch; the documents themselves under the empty unit."""
    for batch in batches:
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = set(tokens_of(text.as_py()))
            sums[toxic > 0].update(own | {f"{n}:{t[:n]}" for t in own for n in PREFIXES if len(t) >= n} | {""})
        units = list(sums[0] | sums[1])
        hashes = lambda names: pa.array(map(unit_hash, names), pa.int64())
        cols = [hashes(units), hashes(map(parent_of, units)), *[pa.array([s[u] for u in units], pa.int64()) for s in sums]]
        yield pa.RecordBatch.from_arrays(cols, names=["unit", "parent", "c", "t"])
    release()


def unit_scores(learnt: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Hashes and scores of all units of a sample, and its numbers of toxic and clean documents.

    What reaches the driver is four numbers a unit, bounded by the sample.
    """
    counts = learnt.select("toxic", "text").mapInArrow(_unit_counts, "unit long, parent long, c long, t long").groupBy("unit").agg(F.min("parent").alias("parent"), F.sum("c").alias("c"), F.sum("t").alias("t"))
    cols = counts.toArrow().sort_by("unit")
    unit, parent, c, t = (cols.column(n).to_numpy() for n in ("unit", "parent", "c", "t"))
    whole = unit == unit_hash("")
    toxic, clean = int(t[whole].sum()), int(c[whole].sum())
    if not toxic or not clean:
        return np.zeros(0, np.int64), np.zeros(0), toxic, clean
    unit, parent, c, t = unit[~whole], parent[~whole], c[~whole] * (toxic / clean), t[~whole]
    share, prior = np.full(len(unit), np.nan), np.full(len(unit), 0.5)
    at = np.minimum(np.searchsorted(unit, parent), len(unit) - 1)
    rooted = unit[at] == parent
    due = ~rooted  # those whose prior is even odds, then those below them, and so on
    while due.any():
        share[due] = (t[due] + PRIOR * prior[due]) / (t[due] + c[due] + PRIOR)
        due = np.isnan(share) & ~np.isnan(share[at])
        prior[due] = share[at[due]]
    return unit, np.log(share / (1 - share)), toxic, clean


def _token_bins(model: Model):
    """Of clean documents: tokens and best segment of each, and their token scores by hundredths."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            bins: Counter = Counter()
            for text in batch.column(0):
                scores = model.token_scores(tokens_of(text.as_py()))
                rows.append((len(scores), max((s for _, _, s in maximal_segments(scores)), default=0.0), None, None))
                bins.update(np.rint(scores * 100).astype(int).tolist())
            rows += [(None, None, k, v) for k, v in bins.items()]
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["n", "best", "bin", "times"])
        model.store.clear()
        release()

    return scan


def solve_rate(bins: dict[int, int]) -> float:
    """The positive root of sum p(s) exp(rate s) = 1 over scores in hundredths, within 0.05 and 64; 1 where there is none."""
    total = sum(bins.values())
    s, p = np.array(sorted(bins), dtype=float) / 100, np.array([bins[k] for k in sorted(bins)], dtype=float)
    if not total or (s * p).sum() >= 0 or s.max() <= 0:
        return 1.0
    low, high = 0.0, 1.0
    value = lambda x: float((p / total * np.exp(np.minimum(x * s, 700))).sum())
    while value(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 1 else (low, mid)
    return max(high, 0.05)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope by Newton steps, the slope not below zero; the two classes weigh as they come."""
    w = np.zeros(2)
    X = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -40, 40)))
        grad = X.T @ (p - y) + ridge * w
        hess = (X * (p * (1 - p))[:, None]).T @ X + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(float(w[1]), 0.0)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", most: int = SAMPLE) -> Model:
    """The model of a bounded sample of the labelled documents; what reaches the driver is bounded by it."""
    train = sample(docs, labels, text, doc_id, label, most)
    sizes = {(r["fits"], r["toxic"] > 0): r["n"] for r in train.groupBy((F.col("part") == 0).alias("fits"), "toxic").agg(F.count("*").alias("n")).collect()}
    apart = all(sizes.get((fits, kind), 0) for fits in (True, False) for kind in (True, False))
    learnt, held = (train.where("part <> 0"), train.where("part = 0")) if apart else (train, train)
    units, scores, toxic, clean = unit_scores(learnt)
    if not toxic or not clean:
        share = min(max((toxic + 0.5) / (toxic + clean + 1), 0.02), 0.98)
        return Model(weights=(math.log(share / (1 - share)), 0.0))
    model = Model(units, scores)
    rows = held.where("toxic <= 0").select("text").mapInArrow(_token_bins(model), "n long, best double, bin long, times long").collect()
    bins: Counter = Counter()
    for r in rows:
        if r["bin"] is not None:
            bins[r["bin"]] += r["times"]
    model.rate = solve_rate(bins)
    alone = sorted((r["n"], r["best"]) for r in rows if r["bin"] is None)
    chance = sum(max(n, 1) * math.exp(-min(model.rate * best, 700.0)) for n, best in alone)
    model.constant = min(max(len(alone) / max(chance, 1e-9), 1e-6), 10.0)
    pairs = sorted((float(r["toxic"] > 0), r["evidence"]) for r in held.select("toxic", scored(F.col("text"), model)["evidence"].alias("evidence")).collect())
    model.weights = logistic(np.array([e for _, e in pairs]), np.array([y for y, _ in pairs]))
    return model


# --- scoring

PASSAGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())]))
RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType()), T.StructField("passages", PASSAGES)])


def scored(text: Column, model: Model) -> Column:
    """score, evidence, and the significant passages in characters of the text with the number expected by chance."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            score, evidence, ends, cols = [], [], [0], ([], [], [], [])
            for t in batch:
                own = t.as_py() or ""
                lower = own.lower()
                tokens = TOKEN.findall(lower)
                values = model.token_scores(tokens)
                segments, n = maximal_segments(values), len(tokens)
                e = model.evidence(segments, n)
                evidence.append(e)
                score.append(model.probability(e))
                strong = [(a, b, s, math.exp(-x)) for a, b, s in segments if (x := model.normalized(s, n)) >= LEAST]
                if strong:
                    spans = [m.span() for m in TOKEN.finditer(own)]
                    exact = len(spans) == n  # a letter whose lower case has a mark moves the tokens; then the passage is the text
                    for a, b, s, x in strong:
                        for c, v in zip(cols, (spans[a][0] if exact else 0, spans[b - 1][1] if exact else len(own), s, x), strict=True):
                            c.append(v)
                ends.append(len(cols[0]))
            inner = pa.StructArray.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())], names=["start", "end", "score", "expected"])
            yield pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array(evidence, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)], names=RESULT.names)
        model.store.clear()
        release()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, RESULT)(F.coalesce(text.cast("string"), F.lit("")))


def toxicity(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All input rows with score, evidence, passages and predicted.  A map: nothing is shuffled."""
    df = packed(docs, scored(F.col(f"`{text}`"), model).alias("__r"))
    df = df.select("__row", *[F.col(f"__r.{c}").alias(c) for c in RESULT.names]).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return unpacked(df, docs.columns, *RESULT.names, "predicted")


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels are kept from fitting."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
