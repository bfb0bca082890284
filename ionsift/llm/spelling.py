"""Spelling variants: the words one edit apart, and the form that each belongs to.

Words and their counts come from whole texts, added up in each task before
they are exchanged.  The words are then range-partitioned in order and built
into shards: compact tries (chains are one edge) of SHARD_WORDS words at most,
as flat arrays.  Shards are broadcast in groups of GROUP_BYTES at most, so that
neither the driver nor a task ever holds more, however many words there are;
a vocabulary that one group holds is one pass.  In a pass each word's automaton
of distance one runs depth-first through every shard of the group.  A shard
whose words begin unlike the word ends it within a few nodes.  What the
accepting neighbours add up to (their number, the best of them) goes along
with the word from pass to pass; pairs are never rows.

A word's form is its most frequent neighbour, if that is ``ratio`` times as
frequent; so counts grow along forms and a chain of them is short.  Roots are
found by following forms, twice as far in each round.

Defined results: null and empty texts have no words; a null id counts as an
empty one where letters are dropped; repeated rows count each; of neighbours
with equal counts the first in code-point order is the form; texts of any
length are taken whole; an empty table gives an empty result.  Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release

#: Words of a shard at most, and bytes of the shards that are broadcast together (one shard of the longest words may be more).
SHARD_WORDS = 50_000
GROUP_BYTES = 32_000_000
#: Bytes of a shard's words at most: longer words make smaller shards.
SHARD_BYTES = 8_000_000
#: Distinct words that a task adds up before it passes them on.
ENTRIES = 300_000

#: Letters in Latin-1, A to Z in lower case; all others become spaces.  (Latin-1 holds all letters of words, one byte each.)
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def text_words(text: str) -> list[bytes]:
    """The runs of letters A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def dropped(word: bytes, start: int, every: int) -> bytes:
    """The word without one letter if its hash, continued from ``start``, is a multiple of ``every``."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode("utf-8"), start)
    return word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = 6, least_count: int = 5, drop_every: int = 0) -> DataFrame:
    """(word, n) of the words with so many letters and occurrences.

    ``drop_every`` puts known misspellings in: a word of a document loses a
    letter where the CRC-32 of "<doc_id>:<word>" is a multiple of it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in total]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        total: Counter[bytes] = Counter()
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                start = zlib.crc32(f"{i.as_py() or ''}:".encode())
                for w, k in Counter(text_words(t.as_py() or "")).items():
                    if len(w) >= least_length:
                        w = dropped(w, start, drop_every) if drop_every else w
                        if len(w) >= least_length:
                            total[w] += k
                if len(total) >= ENTRIES:
                    yield out()
                    total.clear()
        if total:
            yield out()
        total.clear()
        release()

    rows = docs.select(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`").cast("string")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Trie:
    """A compact trie of words in order, as flat arrays; nodes are numbered by levels, so that a node's children are neighbours.

    ``labels`` has the first letter of the edge into each node, ``edges`` the
    rest of it, ``first`` where its children begin, ``counts`` the count of
    the word that ends there, or 0.
    """

    def __init__(self, labels: bytes, edges: bytes, ends: Sequence[int], first: Sequence[int], counts: Sequence[int]):
        self.labels, self.edges, self.ends, self.first, self.counts = labels, edges, ends, first, counts

    @classmethod
    def of(cls, words: list[bytes], n: list[int]) -> Trie:
        labels, edges, ends, first, counts = bytearray(), bytearray(), array("I", [0]), array("I"), array("q")
        level = [(0, len(words), 0)]  # from, to, letters read
        while level:
            below, made = [], len(labels) + len(level)
            for lo, hi, depth in level:
                a, b = words[lo], words[hi - 1]
                labels.append(a[depth - 1] if depth else 0)
                end = depth
                while end < len(a) and end < len(b) and a[end] == b[end]:  # in order, what the first and last share all share
                    end += 1
                edges += a[depth:end]
                ends.append(len(edges))
                counts.append(n[lo] if len(a) == end else 0)
                first.append(made + len(below))
                at = lo + (len(a) == end)
                for _, own in groupby(range(at, hi), lambda k: words[k][end]):
                    size = len(list(own))
                    below.append((at, at + size, end + 1))
                    at += size
            level = below
        first.append(len(labels))
        return cls(bytes(labels), bytes(edges), ends, first, counts)

    def packed(self) -> bytes:
        head = array("I", [len(self.labels), len(self.edges)]).tobytes()
        return head + self.counts.tobytes() + self.ends.tobytes() + self.first.tobytes() + self.labels + self.edges

    @classmethod
    def unpacked(cls, data: bytes) -> Trie:
        view = memoryview(data)
        nodes, letters = view[:8].cast("I")
        at = [8, 8 + 8 * nodes, 12 + 12 * nodes, 16 + 16 * nodes, 16 + 17 * nodes]
        return cls(data[at[3] : at[4]], data[at[4] : at[4] + letters], view[at[1] : at[2]].cast("I"), view[at[2] : at[3]].cast("I"), view[at[0] : at[1]].cast("q"))

    def near(self, word: bytes) -> Iterator[tuple[bytes, int]]:
        """The words one edit away, with their counts: the word's automaton of distance one, depth-first.

        Without an edit the automaton is at one place of the word, where the
        way through the trie is the word's own beginning.  A letter that is
        not the word's next one spends the edit: as another letter, as one
        more, or as the one after next, and from there on (places ``at``,
        ``at + 1`` and ``at + 2``) the rest of the word must follow.
        """
        labels, edges, ends, first = self.labels, self.edges, self.ends, self.first
        size = len(word)
        node, at = 0, 0
        edge = edges[: ends[1]]  # the root's, which has no label
        while True:
            # the edge into this node, from ``at`` on
            k = 0
            if not word.startswith(edge, at):
                while at + k < size and word[at + k] == edge[k]:
                    k += 1
                yield from self._spent(node, word, at + k, edge[k], edge[k + 1 :])
                return
            at += len(edge)
            if at == size - 1 and self.counts[node]:
                yield word[:at], self.counts[node]
            a, b = first[node], first[node + 1]
            c = word[at] if at < size else -1
            after = word[at + 1] if at + 1 < size else -1
            on = -1
            for child in range(a, b):
                x = labels[child]
                if x == c:
                    on = child
                else:
                    edge = edges[ends[child] : ends[child + 1]]
                    # the same tests as in _spent(), before the call: most children end here
                    if word.startswith(edge, at) or word.startswith(edge, at + 1) or x == after and word.startswith(edge, at + 2):
                        yield from self._spent(child, word, at, x, edge)
            if on < 0:
                return
            node, edge = on, edges[ends[on] : ends[on + 1]]
            at += 1

    def _spent(self, node: int, word: bytes, at: int, letter: int, edge: bytes) -> Iterator[tuple[bytes, int]]:
        """Words through this node that begin as the word up to ``at``, go on with another ``letter`` and the edge's rest, and end as the word does."""
        for p in (at, at + 1, at + 2):
            if p > len(word) or p == at + 2 and word[at + 1] != letter or not word.startswith(edge, p):
                continue
            end = self._rest(node, word, p + len(edge))
            if end >= 0:
                yield (word[:at] + word[at + 1 :] if p == at + 2 else word[:at] + bytes([letter]) + word[p:]), self.counts[end]

    def _rest(self, node: int, word: bytes, at: int) -> int:
        """The node where the rest of the word, from ``at`` on, leads to a word's end; -1 if nowhere."""
        labels, edges, ends, first, size = self.labels, self.edges, self.ends, self.first, len(word)
        while at < size:
            node = labels.find(word[at], first[node], first[node + 1])
            if node < 0 or not word.startswith(edges[ends[node] : ends[node + 1]], at + 1):
                return -1
            at += 1 + ends[node + 1] - ends[node]
        return node if at == size and self.counts[node] else -1


def shards(words: DataFrame) -> DataFrame:
    """(size, trie) of consecutive words in order, kept in the shared folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            data = Trie.of(own, n).packed()
            return pa.RecordBatch.from_arrays([pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], names=["size", "trie"])

        own, n, held = [], [], 0
        for batch in batches:
            for w, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own.append(w.encode("latin-1"))
                n.append(k)
                held += len(w)
                if len(own) >= SHARD_WORDS or held >= SHARD_BYTES:
                    yield out()
                    own, n, held = [], [], 0
        if own:
            yield out()
        release()

    parts = -(-words.count() // SHARD_WORDS)
    ordered = words.select("word", "n").repartitionByRange(max(1, parts), "word").sortWithinPartitions("word")
    return cut(ordered.mapInArrow(build, "size long, trie binary").withColumn("shard", F.monotonically_increasing_id()))


def groups(sizes: list[tuple[int, int]], most: int = GROUP_BYTES) -> list[list[int]]:
    """Shards (number, bytes) as lists of numbers whose bytes are ``most`` together, or one shard."""
    out, held = [], 0
    for shard, size in sizes:
        if not out or held + size > most:
            out.append([])
            held = 0
        out[-1].append(shard)
        held += size
    return out


def _with_near(words: DataFrame, tries: list[bytes]) -> DataFrame:
    """One pass: every word against these shards; n_near, form and form_n go on from what they are."""
    sent = words.sparkSession.sparkContext.broadcast(tries)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Trie.unpacked(t) for t in sent.value]
        for batch in batches:
            n_near, form, form_n = [], [], []
            for w, near, f, k in zip(*[batch.column(c).to_pylist() for c in ("word", "n_near", "form", "form_n")], strict=True):
                best = (-k, f.encode("latin-1")) if f is not None else (1, b"")
                word = w.encode("latin-1")
                for trie in own:
                    for other, count in trie.near(word):
                        near += 1
                        best = min(best, (-count, other))
                n_near.append(near)
                form.append(best[1].decode("latin-1") if best[0] < 0 else None)
                form_n.append(-best[0] if best[0] < 0 else None)
            columns = [batch.column("word"), batch.column("n"), pa.array(n_near, pa.int64()), pa.array(form, pa.string()), pa.array(form_n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "n_near", "form", "form_n"])
        release()

    done = cut(words.mapInArrow(match, "word string, n long, n_near long, form string, form_n long"))
    sent.unpersist()
    return done


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of a table (word, n) of distinct words: how many are one edit away, and the most frequent of them."""
    spark = words.sparkSession
    words = cut(words)
    tries = shards(words)
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words.count() // 500)))
    df = words.repartition(n, "word").select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"))
    sizes = [(r["shard"], r["size"]) for r in tries.select("shard", "size").collect()]  # a row per shard
    for own in groups(sorted(sizes)):
        df = _with_near(df, [bytes(r["trie"]) for r in tries.where(F.col("shard").isin(own)).select("trie").collect()])
    return df


def with_roots(words: DataFrame, rounds: int = 8) -> DataFrame:
    """The rows (word, form, ...) with ``root``: where the forms lead, the word itself where it has none."""
    df = cut(words.withColumn("root", F.coalesce("form", "word")))
    for _ in range(rounds):
        further = df.where("root <> word").select(F.col("word").alias("__at"), F.col("root").alias("__next"))
        df = cut(df.join(further, F.col("root") == F.col("__at"), "left").drop("__at"))
        moved = df.where("__next is not null").limit(1).count()
        df = df.withColumn("root", F.coalesce("__next", "root")).drop("__next")
        if not moved:
            return df
    raise RuntimeError("forms did not end")


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a table (word, n): a form is ``ratio`` times as frequent at least."""
    found = near_words(words)
    good = F.col("form_n") >= ratio * F.col("n")
    return with_roots(found.select("word", "n", "n_near", F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")))
