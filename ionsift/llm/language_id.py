"""Language by hyperdimensional profiles of letter n-grams.

Every letter has a random vector of +1 and -1, drawn from a generator seeded
by its code point.  An n-gram's vector binds (multiplies) its letters' vectors,
each permuted (rotated) by its place; a text's vector bundles (adds) those of
its n-grams; a language's prototype bundles the texts that are labelled with
it, each scaled to unit length.  Prototypes are centred on their mean, which
holds what all languages share, and a document goes to the prototype with the
highest cosine.

Texts are lower-cased, all that is not a letter becomes one space, and n-grams
span the spaces.  Prototypes are sums of whole numbers, added up in each task
and then by language, so that the order of rows doesn't change them; they are
broadcast in blocks of BLOCK at most, a pass over the documents for each.

Defined results: a null text, or one without a letter, is ``und`` with score 0,
and so is every text when nothing was learnt; a null language teaches nothing;
of equal cosines the language first in code-point order wins; rows that repeat
teach and are judged each; texts of any length are taken whole; an empty table
gives an empty result.  Other columns are carried along; computed ones replace
those of their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, cut, packed, release, unpacked

UNKNOWN = "und"
#: Dimensions of all vectors, letters of an n-gram, the generator's seed.
DIMENSIONS = 1024
GRAM = 3
SEED = 42
#: Prototypes that are broadcast together (4 KB each): more languages take more passes.
BLOCK = 4096
#: N-grams whose vectors a process holds (1 KB each), and n-grams that a task adds up for a language before they become a vector.
ENTRIES = 40_000
#: A text's n-gram weights are whole numbers of this part of its length.
UNIT = 1 << 16


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its letter in lower case, or a space."""
    table = np.full(sys.maxunicode + 1, 32, dtype=np.int64)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's distinct n-grams, as numbers of 21 bits a letter, and how often each comes; none for a text without a letter."""
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    letter = points != 32
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of what follows a letter, one space
    own = points[keep]
    own = np.concatenate([[32], own, [32]] if own[-1] != 32 else [[32], own])
    code = np.zeros(len(own) - GRAM + 1, dtype=np.int64)
    for k in range(GRAM):
        code = code << 21 | own[k : len(code) + k]
    return np.unique(code, return_counts=True)


class Vectors:
    """Vectors of n-grams, made when they are asked for; the letters' vectors stay, n-grams' are dropped when there are too many."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.letters: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.rows = np.zeros((0, dimensions), dtype=np.int8)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) >= ENTRIES:
                self.letters.clear()
            bits = np.random.Generator(np.random.Philox(key=[SEED, point])).integers(0, 2, self.dimensions, dtype=np.int8)
            self.letters[point] = bits * np.int8(2) - np.int8(1)
        return self.letters[point]

    def bound(self, code: int) -> np.ndarray:
        """The n-gram's vector: its letters', each rotated by the letters that follow it, multiplied."""
        out = np.ones(self.dimensions, dtype=np.int8)
        for k in range(GRAM):
            out *= np.roll(self.letter(code >> 21 * k & 0x1FFFFF), k)
        return out

    def bundle(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The weighted sum of the n-grams' vectors, in doubles (whole numbers stay exact)."""
        total = np.zeros(self.dimensions)
        for a in range(0, len(codes), 4096):
            own = codes[a : a + 4096].tolist()
            new = [c for c in own if c not in self.place]
            if len(self.place) + len(new) > ENTRIES:
                self.place, new = {}, own
            if new:
                if len(self.place) + len(new) > len(self.rows):
                    grown = np.zeros((min(ENTRIES, max(4096, 2 * len(self.rows), len(self.place) + len(new))), self.dimensions), dtype=np.int8)
                    grown[: len(self.rows)] = self.rows
                    self.rows = grown
                for c in new:
                    self.rows[len(self.place)] = self.bound(c)
                    self.place[c] = len(self.place)
            at = [self.place[c] for c in own]
            # whole numbers below 2**24 are exact in 32 bits; larger ones are added in doubles
            few = weights[a : a + 4096]
            kind = np.float32 if float(np.abs(few).sum()) < 1 << 24 else np.float64
            total += few.astype(kind) @ self.rows[at].astype(kind)
        return total


def unit_weights(counts: np.ndarray) -> np.ndarray:
    """Counts over their length (n-gram vectors are nearly at right angles), in whole UNITs."""
    return np.rint(counts * (UNIT / np.sqrt(float((counts * counts).sum())))).astype(np.int64)


@dataclass
class Model:
    """Prototypes: (lang, texts, vector of 64-bit whole numbers as bytes), a row per language."""

    prototypes: DataFrame
    dimensions: int = DIMENSIONS


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> Model:
    """Learns from all rows that have a language and letters."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vectors(dimensions)
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def settle(name: str) -> None:
            codes, at = np.unique(np.concatenate([c for c, _ in held[name]]), return_inverse=True)
            weights = np.zeros(len(codes), dtype=np.int64)
            np.add.at(weights, at, np.concatenate([w for _, w in held[name]]))
            sums[name] = sums.get(name, 0) + own.bundle(codes, weights).astype(np.int64)
            held[name], sizes[name] = [], 0

        def out() -> pa.RecordBatch:
            for name in held:
                if held[name]:
                    settle(name)
            names = list(sums)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([texts[k] for k in names], pa.int64()), pa.array([sums[k].astype("<i8").tobytes() for k in names], pa.binary())], names=["lang", "texts", "vector"])

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes, counts = grams(t.as_py() or "")
                if not len(codes):
                    continue
                held.setdefault(name, []).append((codes, unit_weights(counts)))
                texts[name] = texts.get(name, 0) + 1
                sizes[name] = sizes.get(name, 0) + len(codes)
                if sizes[name] >= 25 * ENTRIES or sum(sizes.values()) >= 50 * ENTRIES:
                    for k in [name] if sizes[name] >= 25 * ENTRIES else [k for k in held if held[k]]:
                        settle(k)
                if len(sums) + len(held) > BLOCK:
                    yield out()
                    sums, texts, held, sizes = {}, {}, {}, {}
        if texts:
            yield out()
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, texts, total = None, 0, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([texts], pa.int64()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["lang", "texts", "vector"])

        for batch in batches:
            for k, n, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != name:
                    if name is not None:
                        yield out()
                    name, texts, total = k, 0, np.zeros(dimensions, dtype=np.int64)
                texts += n
                total = total + np.frombuffer(v, dtype="<i8")
        if name is not None:
            yield out()

    schema = "lang string, texts long, vector binary"
    known = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("lang is not null and text is not null")
    parts = known.mapInArrow(bundle, schema)  # a row per task and language
    return Model(cut(parts.repartition("lang").sortWithinPartitions("lang").mapInArrow(add, schema)), dimensions)


def _judged(df: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """Rows of (__row, __text, __lang, __score): the best of what they have and these prototypes."""
    sent = df.sparkSession.sparkContext.broadcast((names, prototypes))

    def judge(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        names, prototypes = sent.value
        own = Vectors(prototypes.shape[1])
        for texts, lang, score in batches:
            best, top = lang.to_pylist(), score.to_pylist()
            for i, t in enumerate(texts):
                codes, counts = grams(t.as_py() or "")
                v = own.bundle(codes, counts)
                size = float(np.sqrt(v @ v))
                if size:
                    cosines = prototypes @ (v / size)
                    k = int(np.argmax(cosines))  # the first of equal ones
                    if best[i] is None or cosines[k] > top[i]:
                        best[i], top[i] = names[k], float(cosines[k])
            yield pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(top, pa.float64())], names=["lang", "score"])
        release()

    udf = F.arrow_udf(judge, "lang string, score double")
    found = df.withColumn("__found", udf("__text", "__lang", "__score"))
    return found.select(ROW, "__text", F.col("__found.lang").alias("__lang"), F.col("__found.score").alias("__score"))


def blocks(model: Model, most: int = BLOCK) -> Iterator[tuple[list[str], np.ndarray]]:
    """Names in order, and their prototypes at unit length, so many at a time."""
    last = None
    while True:
        more = model.prototypes.where(F.col("lang") > last) if last is not None else model.prototypes
        rows = more.orderBy("lang").limit(most).collect()
        if not rows:
            return
        yield [r["lang"] for r in rows], _unit(np.array([np.frombuffer(r["vector"], dtype="<i8") for r in rows], dtype=float))
        if len(rows) < most:
            return
        last = rows[-1]["lang"]


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def identified(docs: DataFrame, model: Model, text: str = "text", most: int = BLOCK) -> DataFrame:
    """All input rows with ``lang_pred`` and ``score``: the cosine with the language's centred prototype, 0 where it is below."""
    df = packed(docs, F.col(f"`{text}`").cast("string").alias("__text"), F.lit(None).cast("string").alias("__lang"), F.lit(None).cast("double").alias("__score"))
    n, total = 0, np.zeros(model.dimensions)
    for names, own in blocks(model, most):
        n, total = n + len(names), total + own.sum(axis=0)
    for names, own in blocks(model, most):
        df = _judged(df, names, _unit(own - total / n) if n > 1 else own)  # one language alone has nothing to be centred on
    df = df.select(ROW, F.coalesce("__lang", F.lit(UNKNOWN)).alias("lang_pred"), F.when(F.col("__score") > 0, F.least(F.lit(1.0), F.col("__score"))).otherwise(0.0).alias("score"))
    return unpacked(df, docs.columns, "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents from which nothing is learnt; a null id is one of them."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0
