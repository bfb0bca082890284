"""Near-duplicates by SimHash, with candidate keys from the binary Golay code.

A fingerprint of 64 bits is split into segments of 22, 21 and 21 bits.  Two
fingerprints that differ in two bits at most agree wholly in one segment
(pigeonhole), and differ in two bits at most in the segment after it.  There
the perfect [23, 12] Golay code gives every word one index, or six when it
lies at the code's covering radius, such that any two words at a distance of
two share an index: both reach the codeword near the word midway.  So the
keys (segment, its bits, an index of the next segment) lose no pair, and there
are 18 at most for a distinct fingerprint.

Copies meet once, as one distinct fingerprint.  Keys of few fingerprints are
joined and verified pair by pair.  Fingerprints under a crowded key are
linked through the words at distance one instead: two fingerprints differ in
two bits at most exactly if they share such a word (or are one), and a word
has 65 such fingerprints at most, so that this costs 65 rows a fingerprint
and no pairs.  Components come from alternating large-star and small-star
steps on distributed edge tables, with checkpoints.

Defined results: texts are taken whole, however long; null and empty ones have fingerprint zero and link like
others; null ids are never a component's id unless it has no other; repeated
rows fall into one component; an empty table gives an empty result; computed
columns replace input columns of their name, and all others are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW, cut, packed, release, unpacked

#: (first bit, width) of the segments, and the code's generator polynomial (a fixed value).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b101011100011
#: Fingerprints under a key up to which they are paired; above, they are linked through the words at distance one.
CROWD = 64
#: A broadcast table of keys has so many rows at most (about 40 bytes each); above, the join is shuffled.
BROADCAST_KEYS = 50_000
SEED = 42


def text_hashes(text: str, shingle: int = 3) -> np.ndarray:
    """XXH64 of every shingle; the whole sequence if it is shorter; none for a text without words."""
    own = text.encode("utf-8").lower().split()
    if len(own) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(own), SEED)] if own else [], dtype=np.uint64)
    joined, ends, at = b" ".join(own), [], -1
    for w in own:
        at += len(w) + 1
        ends.append(at)
    starts = [0] + [x + 1 for x in ends[: -shingle]]
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])), dtype=np.uint64, count=len(starts))


def majority(hashes: np.ndarray, step: int = 1 << 16) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), step):
        ones += np.unpackbits(hashes[i : i + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([majority(text_hashes(t.as_py() or "")) for t in batch], pa.int64())
    release()


def fingerprint(text: Column) -> Column:
    """The text's fingerprint as a bigint."""
    return _fingerprints(F.coalesce(text.cast("string"), F.lit("")))


def hexadecimal(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of each of 23 bits; for each syndrome the words that, added to a word, give the codewords it is indexed by (-1: none)."""
    syndromes = np.zeros(23, dtype=np.int64)
    for bit in range(23):
        x = 1 << bit
        for high in range(22, 10, -1):
            if x >> high & 1:
                x ^= GENERATOR << (high - 11)
        syndromes[bit] = x
    leader = np.zeros(2048, dtype=np.int64)
    ones = [(0, 0)]
    for weight in range(3):  # all errors of weight one to three have their own syndrome: the code is perfect
        ones = [(e | 1 << b, s ^ int(syndromes[b])) for e, s in ones for b in range(23) if e >> b == 0]
        for e, s in ones:
            leader[s] = e
    table = np.full((2048, 6), -1, dtype=np.int64)
    for s in range(2048):
        near = {int(leader[s])} | {1 << b ^ int(leader[s ^ int(syndromes[b])]) for b in range(23)}
        table[s, : len(near)] = sorted(near)
    return syndromes, table


def golay_indices(value: np.ndarray) -> np.ndarray:
    """For words of 23 bits: six columns of 12-bit indices, -1 where a word has only one."""
    syndromes, table = golay_tables()
    s = np.zeros_like(value)
    for bit in range(23):
        s ^= (value >> bit & 1) * syndromes[bit]
    add = table[s]
    return np.where(add >= 0, (value[:, None] ^ add) >> 11, -1)


def candidate_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all fingerprints, and where those of each begin and end."""
    u = fingerprints.astype(np.int64).view(np.uint64)
    parts = [(u >> np.uint64(a) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in SEGMENTS]
    keys = []
    for i, own in enumerate(parts):
        index = golay_indices(parts[(i + 1) % 3])
        keys.append(np.where(index >= 0, (i << 34) | (own[:, None] << 12) | index, -1))
    both = np.concatenate(keys, axis=1) if len(u) else np.zeros((0, 18), dtype=np.int64)
    return both[both >= 0], np.concatenate([[0], np.cumsum((both >= 0).sum(axis=1))])


@F.arrow_udf(T.ArrayType(T.LongType()))
def _keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        keys, ends = candidate_keys(batch.to_numpy(zero_copy_only=False))
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.int64()))


def links(fingerprints: DataFrame, most: int = 2) -> DataFrame:
    """Edges (a, b), a < b, that connect the distinct fingerprints ``fp`` as those at ``most`` (one or two) differing bits do."""
    if most not in (1, 2):
        raise ValueError("the keys hold for one or two differing bits")
    keyed = fingerprints.select("fp", F.explode(_keys("fp")).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(keyed.join(shared, "key"))
    a, b = met.where(F.col("n") <= CROWD), met.where(F.col("n") <= CROWD)
    pairs = (
        a.select("key", F.col("fp").alias("a"))
        .join(b.select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most))
        .select("a", "b")
    )
    crowd = met.where(F.col("n") > CROWD).select("fp").distinct()
    flips = [F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)]
    if most == 1:  # an edge of the cube: named by its lower end's bit and the word without it
        around = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(F.element_at(F.array(*flips), i + 1).alias("w"), i.alias("i")))
        around = F.transform(around, lambda x: F.struct(F.least(x["w"], F.col("fp")).alias("w"), x["i"]))
    else:
        around = F.array(F.col("fp"), *flips)
    middle = crowd.select("fp", F.explode(around).alias("word")).groupBy("word").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
    starred = middle.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 65)).alias("b"))
    return pairs.union(starred).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): its component's smallest node, by large-star and small-star steps until nothing changes."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long"))).first())

    was = state(e)
    for _ in range(rounds):
        if not was[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        e = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        now = state(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes(ids: DataFrame, most: int = 2) -> DataFrame:
    """(fp, component_id) for every distinct fingerprint of the table (id, fp)."""
    distinct = cut(ids.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(distinct.select("fp"), most))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    return linked.join(lowest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = 2) -> DataFrame:
    """All input rows with ``fingerprint`` (16 hex digits) and ``component_id``."""
    marked = packed(docs, F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("__text"))
    ids = cut(marked.select("id", fingerprint(F.col("__text")).alias("fp")))
    rows = marked.select(ROW, fingerprint(F.col("__text")).alias("fp"))
    df = rows.join(classes(ids, most), "fp", "left")
    return unpacked(df.withColumn("fingerprint", hexadecimal(F.col("fp"))), docs.columns, "fingerprint", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = 2) -> DataFrame:
    """The rows that stay: of each component the one with the smallest id (null last); of rows with that id, the one whose text has the smallest hash; of rows equal in both, the first by the other columns as text.

    Chosen by ids and text hashes; only then the texts are read again and
    exchanged once, to meet their key.  Keys of several rows, which are ids
    that come back with the same text, take another way: their rows meet the
    keys (broadcast where these are few), are reduced to one in each task, and
    only then exchanged, so that one key may hold any share of the rows.
    """
    none, hashed = F.col(f"`{doc_id}`").isNull(), F.xxhash64(f"`{text}`")
    key = F.struct(none.alias("none"), F.col(f"`{doc_id}`").alias("id"), hashed.alias("hash"))
    ids = cut(docs.select(key.alias("id"), fingerprint(F.col(f"`{text}`")).alias("fp")))
    stay = classes(ids, most).groupBy("component_id").agg(F.count("*").alias("fingerprints")).select("component_id.*")
    again = ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id.*")
    on = ["none", "id", "hash"]  # a null id meets others by its flag
    named = lambda df: df.withColumn("id", F.coalesce(F.col("id").cast("string"), F.lit("")))
    stay, again = named(stay), cut(named(again))
    n = again.limit(BROADCAST_KEYS + 1).count()
    marked = named(packed(docs, none.alias("none"), F.col(f"`{doc_id}`").alias("id"), hashed.alias("hash")))
    once = marked.join((stay.join(again, on, "left_anti") if n else stay).hint("merge"), on, "left_semi").select(f"{ROW}.*")
    if not n:
        return once
    several = stay.join(again, on)
    found = marked.join(F.broadcast(several) if n <= BROADCAST_KEYS else several.hint("merge"), on, "left_semi")
    order = F.struct(*[F.col(f"{ROW}.`{c}`").cast("string") for c in docs.columns if c != text])
    return once.unionByName(found.groupBy(*on).agg(F.min_by(ROW, order).alias(ROW)).select(f"{ROW}.*"))
