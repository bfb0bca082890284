"""Two tokenizers' ids aligned by the bytes that they cover.

A text is encoded twice.  Where tokens of both end at one byte, the text is
cut into groups; tokens whose bytes overlap are linked.  How many documents
hold a pair of ids linked is counted over all of them: every link is one packed
64-bit number (id of the first tokenizer, id of the second), each document's
distinct ones are added up by np.unique in each task, and the tasks' counts are
range-partitioned, sorted, and summed along runs into shards of sorted keys
beside their counts.  Documents' keys then find their counts in the mapped
shards by searchsorted.

Texts are encoded by parts (words with the space before them, marks, line
ends), at whose ends neither tokenizer joins what is before to what is after:
that is checked against their settings and all their pieces.  A part that came
before needn't be encoded again.  Texts with runs of white space are cut at
spaces alone, and other tokenizers get whole texts.

Defined results: null and empty texts, and those whose tokens' bytes aren't a
space and the text, have no tokens; ids of documents play no part, so null and
repeated ones are rows like others, and repeated rows are documents of their
own; texts are taken whole, however long; an empty table gives an empty result
and no shards.  Other columns are carried along; computed ones replace those of
their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import uuid
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, cut, new_folder, packed, release, unpacked, written
from .encoders import BYTE_PARTS, OTHER, SYMBOLS, WHITE, default_path

if sys.byteorder != "little":
    raise ImportError("keys are kept in the machine's own order, which is little-endian here")

#: Parts that a process holds at most, twice (those in use, and those of the time before); longer ones hardly come again.
ENTRIES, LONGEST = 100_000, 48
#: Words of a text, not held, from which on they are encoded as one text.
TOGETHER = 4
#: Keys that a task holds before they are reduced to distinct ones, and distinct ones before they are passed on.
KEYS = 2_000_000
#: Keys of a shard file at most (16 bytes each).
SHARD_KEYS = 1 << 20
#: A space that follows something else than white space.
CUT = re.compile(f"(?<=[^{WHITE}])(?= )")
#: White space after white space: without it, the byte-level tokenizer's own parts are ends for both.
RUN = re.compile(f"[{WHITE}]{{2}}")


class Aligned(NamedTuple):
    """Of a piece of text: groups as text, keys of links in order of place, and how many tokens and groups there are."""

    groups: bytes
    keys: bytes
    n_a: int
    n_b: int
    n_groups: int


def aligned(a: list[int], a_sizes: list[int], b: list[int], b_sizes: list[int]) -> Aligned:
    """Two token sequences over the same bytes, in one pass: the token that ends first gives way to the next one."""
    keys, groups = array("q"), []
    i = j = from_a = from_b = 0
    x, y = a_sizes[0], b_sizes[0]
    while True:
        keys.append(a[i] << 32 | b[j])
        if x == y:
            groups.append(f"{','.join(map(str, a[from_a : i + 1]))}|{','.join(map(str, b[from_b : j + 1]))}")
            i, j = i + 1, j + 1
            if i == len(a):
                break
            from_a, from_b, x, y = i, j, x + a_sizes[i], y + b_sizes[j]
        elif x < y:
            i += 1
            x += a_sizes[i]
        else:
            j += 1
            y += b_sizes[j]
    return Aligned(";".join(groups).encode(), keys.tobytes(), len(a), len(b), len(groups))


class Pair:
    """Both tokenizers of a process: ``of(text)`` is the alignment of a whole text, None if it has no tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {symbol: b for b, symbol in SYMBOLS.items()}
        self.a_bytes: dict[int, bytes] = {i: bytes(byte[c] for c in s) if all(c in byte for c in s) else s.encode() for s, i in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        own = [p.replace("▁", " ") for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        # pieces that go on where BYTE_PARTS end a part; a text that holds none of them has no token of the second tokenizer across such an end
        across = re.compile(f"[^{WHITE}][{WHITE}]|[{WHITE.replace(' ', '')}].|[^{OTHER}][{OTHER}]", re.DOTALL)
        self.across = [p for p in own if across.search(p)]
        self.splits = self._splits(own)
        # sizes by id, and each id in decimals with what follows it: a comma, a bar or a semicolon
        size = 1 + max(max(self.a_bytes, default=0), len(pieces))
        self.a_sizes, self.b_sizes = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.a_sizes[list(self.a_bytes)] = [len(s) for s in self.a_bytes.values()]
        self.b_sizes[: len(pieces)] = [len(s) for s in self.b_bytes]
        self.decimals = [b"%d%s" % (i, mark) for i in range(size) for mark in (b",", b"|", b";")]
        self.held: dict[str, Aligned | None] = {}
        self.old: dict[str, Aligned | None] = {}

    def _splits(self, pieces: list[str]) -> bool:
        """Whether texts can be encoded by parts: the first tokenizer is byte-level with its usual pattern; the second leaves texts as they are, and has no piece with a space after anything but white space or with a line end."""
        pre = json.loads(self.a.pre_tokenizer.__getstate__()) if self.a.pre_tokenizer is not None else {}
        plain = pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"] and self.a.normalizer is None and not self.a.truncation and not self.a.padding and type(self.a.model).__name__ == "BPE" and not self.a.model.dropout
        inner = re.compile(f"[^{WHITE}] |\n")
        probe = " a  b　ﬁ éé\t c  "
        return plain and not any(inner.search(p) for p in pieces) and b"".join(self.b_bytes[i] for i in self.b.encode(probe)) == f" {probe}".encode()

    def _aligned(self, a: list[int], b: list[int], want: bytes) -> Aligned | None:
        x, y = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(x) != want or b"".join(y) != want:
            return None
        return aligned(a, [len(s) for s in x], b, [len(s) for s in y])

    def _whole(self, text: str) -> Aligned | None:
        """Of a text that a space goes before."""
        return self._aligned(self.a.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids, self.b.encode(text), f" {text}".encode())

    def _part(self, part: str) -> Aligned | None:
        """Of a part that both tokenizers take by itself."""
        data = part.encode()
        word = part[part[:1] == " " :]
        if word.isalpha():
            a = [t.id for t in self.a.model.tokenize(part.replace(" ", SYMBOLS[32]) if part.isascii() else data.decode("latin-1").translate(SYMBOLS))]
        else:
            a = self.a.encode_batch_fast([part], add_special_tokens=False)[0].ids
        # the second tokenizer puts a space before; a line end, which joins with nothing, keeps it from a part that has none
        b = self.b.encode(word) if word and word is not part else self.b.encode(f"\n{part}")[2:]
        return self._aligned(a, b, data)

    def _parts(self, parts: list[str]) -> list[Aligned | None]:
        """Of distinct parts: those that are a space and letters are one text for both tokenizers, which cut it at the spaces anyway; others one by one."""
        words = [p for p in parts if p[:1] == " " and p[1:].isalpha()]
        made = self._joined(words) if len(words) >= TOGETHER else None
        if made is None:
            return [self._part(p) for p in parts]
        if len(words) == len(parts):
            return made
        found = dict(zip(words, made, strict=True))
        return [found[p] if p in found else self._part(p) for p in parts]

    def _joined(self, words: list[str]) -> list[Aligned] | None:
        """_aligned() of many words, each with the space before it, from their one text; None if a token goes beyond a word."""
        text = "".join(words)
        want = text.encode()
        a, b = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:])
        if b"".join([self.a_bytes[i] for i in a]) != want or b"".join([self.b_bytes[i] for i in b]) != want:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        of_a, of_b = self.a_sizes[a], self.b_sizes[b]
        ends = np.cumsum([len(w) for w in words] if len(want) == len(text) else [len(w.encode()) for w in words])
        end_a, end_b = np.cumsum(of_a), np.cumsum(of_b)
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        if not (of_a.all() and of_b.all()) or not np.array_equal(both[np.minimum(np.searchsorted(both, ends), len(both) - 1)], ends):
            return None
        every = np.union1d(end_a, end_b)  # tokens that overlap do so up to one of these
        keys = (a[np.searchsorted(end_a, every)] << 32 | b[np.searchsorted(end_b, every)]).tobytes()
        # tokens in the order of the text of groups, each with its mark
        in_a, in_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        before = np.r_[0, np.searchsorted(end_b, both, "right")]
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + before[in_a]] = 3 * a + (both[in_a] == end_a)
        order[np.arange(len(b)) + np.searchsorted(end_a, both, "right")[in_b]] = 3 * b + 2 * (both[in_b] == end_b)
        marked = [self.decimals[i] for i in order.tolist()]
        count = lambda x: np.searchsorted(x, ends, "right").tolist()
        out, i, j, k, m = [], 0, 0, 0, 0
        for to_i, to_j, to_k, to_m in zip(count(end_a), count(end_b), count(both), count(every), strict=True):
            out.append(Aligned(b"".join(marked[i + j : to_i + to_j])[:-1], keys[8 * m : 8 * to_m], to_i - i, to_j - j, to_k - k))
            i, j, k, m = to_i, to_j, to_k, to_m
        return out

    def _held(self, parts: list[str], make: Callable[[list[str]], list[Aligned | None]]) -> list[Aligned | None]:
        out = list(map(self.held.get, parts))
        missing = dict.fromkeys([p for p, found in zip(parts, out, strict=True) if found is None])
        if not missing:
            return out
        made = {p: self.old.get(p) for p in missing}
        new = [p for p, found in made.items() if found is None]
        made.update(zip(new, make(new), strict=True))
        for p, found in made.items():
            if len(p) <= LONGEST:
                if len(self.held) >= ENTRIES:
                    self.old, self.held = self.held, {}
                self.held[p] = found
        return [made[p] if found is None else found for p, found in zip(parts, out, strict=True)]

    def of(self, text: str) -> list[Aligned] | None:
        """The alignments of the text's parts in order; None if it has no tokens."""
        if not text:
            return None
        if self.splits and not RUN.search(spaced := f" {text}") and not any(p in spaced for p in self.across):
            out = self._held(BYTE_PARTS.findall(spaced), self._parts)
        elif self.splits:
            out = self._held(CUT.split(f" {text}"), lambda parts: [self._whole(p[1:]) for p in parts])
        else:
            out = [None]
        if None in out:  # the bytes of whole texts decide
            whole = self._whole(text)
            return None if whole is None else [whole]
        return out

    def rest(self) -> None:
        self.old = {}
        release()


@lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    """One per process and pair of files."""
    return Pair(path_a, path_b)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers with their bytes by place: high ones are mostly zero, which files keep small."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def encoded(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """The rows as __row, with n_a, n_b, n_groups, n_links, groups_sha256, and the distinct keys and how often each is linked."""

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = pair(path_a, path_b)
        for batch in batches:
            rows = []
            for t in batch:
                found = own.of(t.as_py() or "")
                if found is None:
                    rows.append({"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "sha": "", "keys": b"", "times": b""})
                    continue
                groups, links, n_a, n_b, n_groups = zip(*found, strict=True)
                keys, times = np.unique(np.frombuffer(b"".join(links), dtype=np.int64), return_counts=True)
                sha = hashlib.sha256(b";".join(groups)).hexdigest()
                rows.append({"n_a": sum(n_a), "n_b": sum(n_b), "n_groups": sum(n_groups), "n_links": int(times.sum()), "sha": sha, "keys": _planes(keys), "times": _planes(times.astype(np.int64))})
            yield pa.array(rows, kind)
        own.rest()

    kind = pa.struct([(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [("sha", pa.string()), ("keys", pa.binary()), ("times", pa.binary())])
    udf = F.arrow_udf(encode, "n_a long, n_b long, n_groups long, n_links long, sha string, keys binary, times binary")
    return packed(docs, F.col(f"`{text}`").cast("string").alias("__text")).select(ROW, udf("__text").alias("__x"))


def partial_counts(keys: DataFrame) -> DataFrame:
    """(key, n): distinct keys of rows ``keys`` (each row's are distinct), added up in each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(at: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(at), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(at[a : a + 100_000]), pa.array(n[a : a + 100_000])], names=["key", "n"])

        at, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting, held = [], 0

        def reduced() -> tuple[np.ndarray, np.ndarray]:
            own, times = np.unique(np.concatenate(waiting), return_counts=True)
            every, where = np.unique(np.concatenate([at, own]), return_inverse=True)
            total = np.zeros(len(every), dtype=np.int64)
            np.add.at(total, where[: len(at)], n)
            np.add.at(total, where[len(at) :], times)
            return every, total

        for batch in batches:
            for k in batch.column(0):
                waiting.append(_from_planes(k.as_py(), np.int64))
                held += len(waiting[-1])
                if held >= KEYS:
                    (at, n), waiting, held = reduced(), [], 0
                    if len(at) >= KEYS:
                        yield from out(at, n)
                        at, n = at[:0], n[:0]
        if waiting:
            at, n = reduced()
        yield from out(at, n)
        release()

    return keys.mapInArrow(count, "key long, n long")


@dataclass
class Counts:
    """Shards of a folder in order of keys: (name, first key, last key, entries); and the highest count of each id of the first tokenizer, by id."""

    folder: str
    shards: list[tuple[str, int, int, int]]
    best: np.ndarray


def write_counts(partial: DataFrame, folder: str, size: int) -> Counts:
    """Sorts the partial counts over all tasks, sums equal keys, and writes shards.

    A task writes under names of its own attempt and reports them; only
    reported files are read.  What reaches the driver is a row per shard, and
    the highest counts by id, which the vocabulary (``size`` ids) bounds.
    """
    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs_, at = fs.FileSystem.from_uri(folder)

        def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            name = f"counts-{uuid.uuid4().hex}"
            with fs_.open_output_stream(f"{at}/{name}.bin") as f:
                f.write(keys.tobytes())
                f.write(n.tobytes())
            ids = keys >> 32
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            best = np.stack([ids[starts], np.maximum.reduceat(n, starts)])
            return pa.RecordBatch.from_pydict({"name": [name], "first": pa.array([int(keys[0])]), "last": pa.array([int(keys[-1])]), "entries": pa.array([len(keys)]), "best": pa.array([best.tobytes()], pa.binary())})

        keys, n, held = [], [], 0
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            n.append(batch.column(1).to_numpy())
            held += len(keys[-1])
            if held > SHARD_KEYS:
                own, total = _runs(np.concatenate(keys), np.concatenate(n))
                while len(own) > SHARD_KEYS:  # the last key may go on
                    yield out(own[:SHARD_KEYS], total[:SHARD_KEYS])
                    own, total = own[SHARD_KEYS:], total[SHARD_KEYS:]
                keys, n, held = [own], [total], len(own)
        if held:
            own, total = _runs(np.concatenate(keys), np.concatenate(n))
            for a in range(0, len(own), SHARD_KEYS):
                yield out(own[a : a + SHARD_KEYS], total[a : a + SHARD_KEYS])
        release()

    parts = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = partial.repartitionByRange(parts, "key").sortWithinPartitions("key")
    manifest = cut(ordered.mapInArrow(store, "name string, first long, last long, entries long, best binary"))
    best = np.zeros(size, dtype=np.int64)
    shards = []
    for r in manifest.toLocalIterator():
        shards.append((r["name"], r["first"], r["last"], r["entries"]))
        ids, n = np.frombuffer(r["best"], dtype=np.int64).reshape(2, -1)
        best[ids] = np.maximum(best[ids], n)
    return Counts(folder, sorted(shards, key=lambda s: s[1]), best)


def _runs(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys as distinct ones, with their sums."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(n, starts)


class Lookup:
    """Counts by key.  Files are mapped where they are local; others are read whole, one at a time."""

    def __init__(self, counts: Counts):
        self.where, self.root = fs.FileSystem.from_uri(counts.folder)
        self.shards = counts.shards
        self.first = np.array([s[1] for s in counts.shards], dtype=np.int64)
        self.mapped: dict[int, np.ndarray] = {}

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        name, _, _, entries = self.shards[k]
        at = f"{self.root}/{name}.bin"
        if isinstance(self.where, fs.LocalFileSystem):
            if k not in self.mapped:
                if os.path.getsize(at) != 16 * entries:
                    raise ValueError(f"{name} is not a whole shard")
                self.mapped[k] = np.memmap(at, dtype=np.int64, mode="r")
            both = self.mapped[k]
        else:
            with self.where.open_input_stream(at) as f:
                both = np.frombuffer(f.read(), dtype=np.int64)
        return both[:entries], both[entries:]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Of keys in order; KeyError for one that was never counted."""
        out = np.zeros(len(keys), dtype=np.int64)
        ends = np.append(np.searchsorted(keys, self.first[1:]), len(keys))
        a = 0
        for k, b in enumerate(ends.tolist()):
            if b > a:
                own, n = self.shard(k)
                at = np.searchsorted(own, keys[a:b])
                if at[-1] >= len(own) or not np.array_equal(own[at], keys[a:b]):
                    raise KeyError("a key has no count")
                out[a:b] = n[at]
            a = b
        return out


def looked_up(rows: DataFrame, counts: Counts) -> DataFrame:
    """The rows of encoded() with __best and __sum: links whose count is the highest of their first id, and the sum of all links' counts."""
    sent = rows.sparkSession.sparkContext.broadcast(counts)  # a row per shard and 8 bytes per id of the vocabulary

    def look(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        table, best = Lookup(sent.value), sent.value.best
        for keys, times in batches:
            n_best, total = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
            a = 0
            while a < len(keys):
                own, b, held = [], a, 0
                while b < len(keys) and held < KEYS:
                    own.append((_from_planes(keys[b].as_py(), np.int64), _from_planes(times[b].as_py(), np.int64)))
                    held += len(own[-1][0])
                    b += 1
                every, where = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
                n = table.counts(every)
                top = n == best[every >> 32]
                at = 0
                for i, (k, m) in enumerate(own, a):
                    mine = where[at : at + len(k)]
                    n_best[i], total[i] = m[top[mine]].sum(), (m * n[mine]).sum()
                    at += len(k)
                a = b
            yield pa.StructArray.from_arrays([pa.array(n_best), pa.array(total)], names=["best", "sum"])
        release()

    udf = F.arrow_udf(look, "best long, sum long")
    found = rows.withColumn("__y", udf("__x.keys", "__x.times"))
    return found.select(ROW, "__x", F.col("__y.best").alias("__best"), F.col("__y.sum").alias("__sum"))


COMPUTED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, text: str = "text") -> DataFrame:
    """All input rows with the columns COMPUTED.  Rows are kept once in the shared folder, with their keys; pass what is needed of them alone."""
    path_a, path_b = path_a or default_path("byte_bpe_50k.json"), path_b or default_path("piece_bpe_32k.model")
    spark = docs.sparkSession
    rows = written(encoded(docs, path_a, path_b, text), "aligned")
    partial = written(partial_counts(rows.select("__x.keys")), "pairs")
    counts = write_counts(partial, new_folder(spark, "counts"), vocabulary_of(path_a))
    df = looked_up(rows, counts)
    own = [F.col(f"__x.{c}").alias(c) for c in COMPUTED[:4]]
    df = df.select(ROW, *own, F.col("__best").alias("n_best"), F.col("__sum").alias("count_sum"), F.col("__x.sha").alias("groups_sha256"))
    return unpacked(df, docs.columns, *COMPUTED)


def pair_counts(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, text: str = "text") -> DataFrame:
    """(a, b, n): how many documents hold the two ids linked, for every pair that any does."""
    rows = encoded(docs, path_a or default_path("byte_bpe_50k.json"), path_b or default_path("piece_bpe_32k.model"), text)
    sums = partial_counts(rows.select("__x.keys")).groupBy("key").agg(F.sum("n").alias("n"))
    return sums.select(F.shiftright("key", 32).cast("int").alias("a"), F.col("key").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "n")


def vocabulary_of(path: str) -> int:
    """One more than the largest id of the first tokenizer."""
    from .encoders import vocabulary_size

    return vocabulary_size(path)
