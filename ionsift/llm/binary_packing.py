"""Packing by power-of-two decomposition.

A document of L tokens is split as L is in binary: pieces of the sequence
length first, then one piece for each bit that is set.  A piece is a sequence
of its own, its length a power of two, so no sequence crosses documents and
none is padded.  Equal lengths share a bucket, in which sequences are
numbered without gaps in the order of documents: the pieces, without ids, are
range-partitioned by (length, document, start), and each partition's numbers
begin where the totals of those before it end.

Defined results: texts are cut into as many pieces as they take, however long; a null or empty text is its end id alone, one piece of length
one; null document ids come last in their bucket; repeated rows give repeated
pieces in sequences of their own; an empty table gives no pieces.  A piece
carries its document's id and nothing else: other columns, whatever their
names, don't come back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .encoders import default_path, encoder
from .prefix import numbered

LENGTH = 2048
END = 1


def binary_lengths(total: int, most: int = LENGTH) -> list[int]:
    """Powers of two that add up to the total, largest first, none above ``most`` (itself a power of two)."""
    return [most] * (total // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if total % most >> b & 1]


def pieces(docs: DataFrame, path: str, most: int = LENGTH, end: int | None = END, with_ids: bool = False) -> DataFrame:
    """The pieces of a table (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, and ids (little-endian, 32 bits) if asked for."""
    if most < 1 or most & (most - 1):
        raise ValueError("the sequence length is a power of two")
    tail = b"" if end is None else end.to_bytes(4, "little")
    names = ["start", "length", "ids_crc32", "doc_tokens"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            cols: dict[str, list[int]] = {n: [] for n in names}
            source, kept = [], []
            for k, t in enumerate(batch.column(1)):
                ids, at = own.ids(t.as_py() or "") + tail, 0
                for n in binary_lengths(len(ids) // 4, most):
                    part = ids[4 * at : 4 * (at + n)]
                    for name, x in zip(names, (at, n, zlib.crc32(part), len(ids) // 4), strict=True):
                        cols[name].append(x)
                    source.append(k)
                    if with_ids:
                        kept.append(part)
                    at += n
            out = [batch.column(0).take(pa.array(source, pa.int64())), *[pa.array(cols[n], pa.int64()) for n in names]]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(kept, pa.binary())] if with_ids else []), names=["doc_id", *names] + ["ids"] * with_ids)
        own.rest()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(split, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", ids binary" * with_ids)


def packed_sequences(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id", most: int = LENGTH, end: int | None = END, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    Sequences are numbered from 0, those of the longest bucket first.
    """
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    flat = pieces(named, path or default_path("byte_bpe_50k.json"), most, end, with_ids)
    order = [F.col("length").desc(), F.col("doc_id").asc_nulls_last(), F.col("start"), F.col("ids_crc32")]
    df = numbered(cut(flat), order, "sequence_id")
    return df.withColumn("offset", F.lit(0).cast("long"))
