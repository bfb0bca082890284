"""Token counts by byte-pair merging with a heap and a linked list.

Each pre-token starts as a list of byte symbols, linked both ways.  A heap
holds the adjacent pairs that have a rank; the lowest, the leftmost on a tie,
is popped and merged, and its new neighbours are pushed, until no pair is
left.  The count is the initial symbols less the merges; no ids are made.
Counts of parts of texts already met are held, up to a bound.

Defined results: texts are taken whole, however long; null is empty, with no tokens; texts that hold an added
token's string count it as one, as the library does; repeated rows count
alike; an empty table gives no rows; computed columns replace input columns of
their name, and all others are carried along.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, release, unpacked
from .encoders import BYTE_PARTS, WHITE, byte_symbols, default_path

#: Counts of parts held at most, about 120 bytes each; emptied when full.
ENTRIES = 1_000_000
#: The byte-level pre-token pattern (a fixed value), with the tokenizer's white space written out.
PRE_TOKENS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left after all merges.  The list is used up."""
    n = len(symbols)
    shift = n.bit_length()
    mask = (1 << shift) - 1
    heap = [r << shift | i for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
    gone = ""
    while heap:
        top = heapq.heappop(heap)
        i = top & mask
        j = after[i]
        if j >= n or not symbols[i] or ranks.get((symbols[i], symbols[j])) != top >> shift:
            continue  # a merge took one of the two
        both = symbols[i] = symbols[i] + symbols[j]
        symbols[j] = gone
        left -= 1
        k, h = after[j], before[i]
        after[i] = k
        if k < n:
            before[k] = i
            if (r := ranks.get((both, symbols[k]))) is not None:
                heapq.heappush(heap, r << shift | i)
        if h >= 0 and (r := ranks.get((symbols[h], both))) is not None:
            heapq.heappush(heap, r << shift | h)
    return left


class Counter:
    """The token count of a text under a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path} is not a byte-level BPE file without normaliser")
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(spec["model"]["merges"])}
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.symbols, self.store = byte_symbols(), {}

    def part(self, text: str) -> int:
        return sum(merged_length([self.symbols[b] for b in word.encode("utf-8")], self.ranks) for word in PRE_TOKENS.findall(text))

    def plain(self, text: str) -> int:
        parts, store = BYTE_PARTS.findall(text), self.store
        new = set(parts).difference(store)
        if new:
            if len(store) + len(new) > ENTRIES:
                store.clear()
                new = set(parts)
            for p in new:
                store[p] = self.part(p)
        return sum(map(store.__getitem__, parts))

    def count(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return self.plain(text)
        between = self.added.split(text)
        return sum(map(self.plain, between)) + len(between) - 1


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per process and file."""
    return Counter(path)


def n_tokens(text: Column, path: str) -> Column:
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(path)
        for batch in batches:
            yield pa.array([own.count(t.as_py()) for t in batch], pa.int64())
        release()

    counted.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(counted, T.LongType())(F.coalesce(text.cast("string"), F.lit("")))


def token_counts(docs: DataFrame, path: str | None = None, text: str = "text", limit: int = 1024) -> DataFrame:
    """All input rows with n_bytes, n_tokens and over_limit (more than ``limit`` tokens).  A map: nothing is shuffled."""
    df = packed(docs, F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("long").alias("n_bytes"), n_tokens(F.col(f"`{text}`"), path or default_path("byte_bpe_50k.json")).alias("n_tokens"))
    return unpacked(df.withColumn("over_limit", F.col("n_tokens") > limit), docs.columns, "n_bytes", "n_tokens", "over_limit")
