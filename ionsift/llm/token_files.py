"""Token ids in flat binary files.

A shard is two files: ``<name>.bin`` holds the ids of its documents, one after
the other, as little-endian unsigned integers of 16 or 32 bits, 16 where the
vocabulary allows; ``<name>.idx`` holds a header of five 64-bit integers
(magic, width in bytes, documents, those without an id, ids) and then, for
each document, its id (64 bits; those without one come last and have 0) and
where its ids begin (64 bits, counted in ids), with the end of the last one
after them.  Both are memory-mapped to be read, or read by ranges where they
are not local.

Texts are encoded where they lie, and only their ids are shuffled: into the
ranges that quantiles of the document ids give, sorted within, one shard a
task.  An id that fills several ranges, or no id, may go to any of them: its
rows are dealt out by their texts and, of equal texts, in turn, which is the
same whenever a task is run again.  A task writes under a name of its own attempt and reports it; only reported
files are read, so a lost executor or a second attempt leaves at most a file
that nobody reads.  The shards' bases in the whole are prefix sums of their
reported totals.

Defined results: null and empty texts are the end id alone; null document ids
come last; document ids are whole numbers of 64 bits, other types raise
ValueError; a token id that the width can't hold raises ValueError; texts of
any length are encoded whole, one at a time; repeated rows are documents of their own, in any order among rows of one id; an empty
table gives no shards and no rows.  Files hold ids alone: other columns,
whatever their names, don't come back.
"""

from __future__ import annotations

import itertools
import os
import struct
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, new_folder
from .encoders import default_path, encoder, vocabulary_size

MAGIC = 0x3249424B4F54
HEAD = struct.Struct("<5q")
END = 1


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def narrowed(ids: bytes, width: int) -> bytes:
    """32-bit ids in so many bytes each; ValueError if one doesn't fit."""
    if width == 4:
        return ids
    values = np.frombuffer(ids, dtype="<u4")
    if len(values) and int(values.max()) >> 16:
        raise ValueError(f"id {int(values.max())} does not fit into 16 bits")
    return values.astype("<u2").tobytes()


def _write_shard(documents: Iterator[tuple[int | None, bytes]], folder: str, part: int, width: int) -> tuple[str, int, int]:
    """The shard's path without ending, its documents and ids.  Ids are appended as they come; 16 bytes a document are held."""
    where, root = opened(folder)
    name = f"{root}/shard-{part:06d}-{uuid.uuid4().hex}"
    index, at, without = array("q"), 0, 0
    with where.open_output_stream(f"{name}.bin") as out:
        for doc_id, own in documents:
            out.write(own)
            without += doc_id is None
            index.extend((doc_id or 0, at))
            at += len(own) // width
    index.append(at)
    with where.open_output_stream(f"{name}.idx") as out:
        out.write(HEAD.pack(MAGIC, width, len(index) // 2, without, at))
        out.write(np.frombuffer(index, dtype=np.int64).astype("<i8").tobytes())
    return os.path.basename(name), len(index) // 2, at


@dataclass
class Ranges:
    """Where documents go: ``bounds`` between the ranges of ids, rising, and after those so many ranges for documents without an id."""

    bounds: np.ndarray
    known: int
    unknown: int

    def of(self, doc_id: int | None) -> tuple[int, int]:
        """The first range that may hold an id, and how many may."""
        if doc_id is None:
            return self.known, self.unknown
        low, high = (int(np.searchsorted(self.bounds, doc_id, side)) for side in ("left", "right"))
        return low, high - low + 1


def ranges(ids: DataFrame, n: int) -> Ranges:
    """About n ranges of equal counts, from one aggregate over a column doc_id."""
    at = [k / n for k in range(1, n)] or [0.5]
    r = ids.agg(F.count("*").alias("all"), F.count("doc_id").alias("known"), F.percentile_approx("doc_id", at, max(10_000, 50 * n)).alias("at")).first()
    unknown = max(1, round(n * (1 - r["known"] / r["all"]))) if r["known"] < r["all"] else 0
    known = max(1, n - unknown) if r["known"] else 0
    every = np.array(r["at"] or [], dtype=np.int64)
    # as many of the bounds as there are ranges left for known ids
    few = every[np.linspace(0, len(every) - 1, known - 1).round().astype(int)] if known > 1 and len(every) and n > 1 else every[:0]
    return Ranges(few, len(few) + 1 if known else 0, unknown)


def encoded(docs: DataFrame, path: str, text: str, doc_id: str, end: int | None, width: int, into: Ranges) -> DataFrame:
    """part, doc_id and the document's ids in the files' width.  A map."""
    tail = b"" if end is None else end.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            parts, ids, turns = [], [], Counter()  # of equal texts in a batch; those of other batches are dealt out by their texts alike
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                plain = own.ids(t.as_py() or "") + tail
                low, several = into.of(i)
                if several > 1:
                    mark = zlib.crc32(plain)
                    low += (mark + turns[i, mark]) % several
                    turns[i, mark] += 1
                parts.append(low)
                ids.append(narrowed(plain, width))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), batch.column(0), pa.array(ids, pa.binary())], names=["part", "doc_id", "ids"])
        own.rest()

    named = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return named.mapInArrow(encode, "part int, doc_id long, ids binary")


def write(docs: DataFrame, folder: str, path: str | None = None, text: str = "text", doc_id: str = "doc_id", end: int | None = END, width: int | None = None, shards: int | None = None) -> DataFrame:
    """Encodes, writes, and returns the shards in order: part, name, docs, ids, base_docs, base_ids.

    ``width`` is 2 or 4 bytes, by default what the vocabulary needs.
    """
    spark, path = docs.sparkSession, path or default_path("word_bpe_49k.json")
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise ValueError(f"document ids are whole numbers, {doc_id} is {docs.schema[doc_id].dataType.simpleString()}")
    width = width or (2 if max(vocabulary_size(path), (end or 0) + 1) <= 1 << 16 else 4)
    if width not in (2, 4):
        raise ValueError("ids have two or four bytes")
    opened(folder)[0].create_dir(opened(folder)[1], recursive=True)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows = ((i.as_py(), own.as_py()) for batch in batches for i, own in zip(batch.column(0), batch.column(1), strict=True))
        first = next(rows, None)
        if first is None:
            return
        name, n_docs, n_ids = _write_shard(itertools.chain([first], rows), folder, part, width)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "docs": pa.array([n_docs], pa.int64()), "ids": pa.array([n_ids], pa.int64())})

    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    into = ranges(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id")), n)
    flat = encoded(docs, path, text, doc_id, end, width, into)
    laid = flat.repartitionById(max(1, into.known + into.unknown), "part").sortWithinPartitions(F.col("doc_id").asc_nulls_last())
    manifest = cut(laid.select("doc_id", "ids").mapInArrow(store, "part int, name string, docs long, ids long"))
    rows, base_docs, base_ids = [], 0, 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):  # a row per shard
        rows.append((r["part"], r["name"], r["docs"], r["ids"], base_docs, base_ids))
        base_docs, base_ids = base_docs + r["docs"], base_ids + r["ids"]
    return spark.createDataFrame(rows, "part int, name string, docs long, ids long, base_docs long, base_ids long")


class _Ranges:
    """A file that is not local, read by ranges as a mapped one is."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def __len__(self) -> int:
        return self.file.size()

    def __getitem__(self, at: slice) -> np.ndarray:
        self.file.seek(at.start or 0)
        return np.frombuffer(self.file.read((len(self) if at.stop is None else at.stop) - (at.start or 0)), dtype=np.uint8)


class Shard:
    """A shard's files, memory-mapped where they are local and read by ranges where not."""

    def __init__(self, folder: str, name: str):
        where, root = opened(folder)
        parts = []
        for ending in ("idx", "bin"):
            at = f"{root}/{name}.{ending}"
            if isinstance(where, fs.LocalFileSystem):
                parts.append(np.memmap(at, dtype=np.uint8, mode="r") if os.path.getsize(at) else np.zeros(0, np.uint8))
            else:
                parts.append(_Ranges(where.open_input_file(at)))
        self.index, self.data = parts
        magic, self.width, self.docs, self.without, ids = HEAD.unpack(self.index[: HEAD.size].tobytes()) if len(self.index) >= HEAD.size else (0,) * 5
        if magic != MAGIC or len(self.index) != HEAD.size + 8 + 16 * self.docs or len(self.data) != self.width * ids:
            raise ValueError(f"{name} is not a whole shard")

    def __len__(self) -> int:
        return self.docs

    def documents(self, a: int, b: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, where its ids begin, ids) of the documents a to b - 1."""
        table = self.index[HEAD.size + 16 * a : HEAD.size + 16 * b + 16 if b < self.docs else None].view("<i8")
        names, starts = table[: 2 * (b - a) : 2], np.append(table[1 : 2 * (b - a) : 2], table[2 * (b - a) + 1 if b < self.docs else -1])
        ids = self.data[self.width * int(starts[0]) : self.width * int(starts[-1])].view(f"<u{self.width}")
        for k in range(b - a):
            yield None if a + k >= self.docs - self.without else int(names[k]), int(starts[k]), ids[starts[k] - starts[0] : starts[k + 1] - starts[0]]

    def document(self, k: int) -> np.ndarray:
        return next(self.documents(k, k + 1))[2]


def read(shards: DataFrame, folder: str, with_ids: bool = True, step: int = 1024) -> DataFrame:
    """One row per document, from the files: doc_id, start (in the whole), n_tokens, ids_crc32 (of 32-bit ids), and ids if asked for."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(folder, name)
                for a in range(0, len(shard), step):
                    rows = [(i, base + at, ids.astype("<u4")) for i, at, ids in shard.documents(a, min(a + step, len(shard)))]
                    cols = {
                        "doc_id": pa.array([i for i, *_ in rows], pa.int64()),
                        "start": pa.array([at for _, at, _ in rows], pa.int64()),
                        "n_tokens": pa.array([len(x) for *_, x in rows], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for *_, x in rows], pa.int64()),
                    }
                    if with_ids:
                        cols["ids"] = pa.array([x.astype(np.int64) for *_, x in rows], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(cols)

    n = max(1, shards.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return shards.repartition(n, "part").select("name", "base_ids").mapInArrow(load, schema)


def token_files(docs: DataFrame, folder: str | None = None, **options) -> tuple[DataFrame, str]:
    """Writes the documents' shards and returns (shards, folder)."""
    folder = folder or new_folder(docs.sparkSession, "tokens")
    return write(docs, folder, **options), folder
