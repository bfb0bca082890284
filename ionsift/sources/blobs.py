"""Strings in byte blobs, by mass: a data source whose partitions are the byte ranges that a window of mass needs.

A table is a folder of pairs of files, each written by one task from rows
sorted by mass: ``.txt`` holds the strings one after the other, ``.idx`` a
header (magic, rows, rows of a block), the first mass of every block, all
masses, and where each string begins.  A manifest names the files that
successful tasks reported, with their first and last mass.  To read a window,
the driver finds the files by the manifest and the blocks by the first masses
alone; tasks then read the masses, places and bytes of their blocks.

Rows without a finite mass or without a string are not kept.  Strings of any
length are; ties in mass keep no order.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..lineage import settled

MAGIC = 0x424C4F42
HEAD, HEAD_SIZE = "<3q", 24
#: Rows of a block, the least that is read; blocks of a partition at most.
BLOCK = 1024
BLOCKS = 256
MANIFEST = "_blobs.json"


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write(df: DataFrame, folder: str, value: str, mass: str = "mass", partitions: int | None = None, block: int = BLOCK) -> int:
    """Writes (mass, value) of the rows; the number kept.  The folder is a URI that driver and executors see."""
    system, root = _opened(folder)
    system.create_dir(root, recursive=True)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(folder)
        name, masses, places, at = f"blob-{uuid.uuid4().hex}", [], [], 0
        with system.open_output_stream(f"{root}/{name}.txt") as out:
            for batch in batches:
                masses.append(batch.column(0).to_numpy())
                for text in batch.column(1).to_pylist():
                    places.append(at)
                    at += out.write(text.encode("utf-8"))
        if not places:
            system.delete_file(f"{root}/{name}.txt")
            return
        all_ = np.concatenate(masses).astype("<f8")
        with system.open_output_stream(f"{root}/{name}.idx") as out:
            out.write(struct.pack(HEAD, MAGIC, len(all_), block))
            for part in (all_[::block], all_, np.array([*places, at], dtype="<i8")):
                out.write(part.tobytes())
        yield pa.RecordBatch.from_pydict({"name": [name], "rows": pa.array([len(all_)], pa.int64()), "low": [float(all_[0])], "high": [float(all_[-1])]})

    m = F.col(mass).cast("double")
    kept = df.select(m.alias("mass"), F.col(value).cast("string").alias("value")).where(F.col("value").isNotNull() & m.isNotNull() & ~F.isnan("mass") & (F.abs("mass") < float("inf")))
    dealt = kept.repartitionByRange(partitions, "mass") if partitions else kept.repartitionByRange("mass")
    manifest = settled(dealt.sortWithinPartitions("mass").mapInArrow(store, "name string, rows long, low double, high double"))
    files = [r.asDict() for r in manifest.orderBy("low").collect()]  # a row per file
    with system.open_output_stream(f"{root}/{MANIFEST}") as out:
        out.write(json.dumps(files).encode("utf-8"))
    return sum(f["rows"] for f in files)


@dataclass
class Range(InputPartition):
    """Blocks of a file, from one up to before another."""

    name: str
    first: int
    last: int

    def __init__(self, name: str, first: int, last: int):
        super().__init__((name, first, last))
        self.name, self.first, self.last = name, first, last


class _Reader(DataSourceReader):
    """A window's bounds are closed; what a filter excludes beside them Spark filters itself."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.low, self.high = float(options.get("low", "-inf")), float(options.get("high", "inf"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) and f.attribute == ("mass",):
                self.low = max(self.low, float(f.value))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) and f.attribute == ("mass",):
                self.high = min(self.high, float(f.value))
            yield f  # bounds are a superset: strict ones, and other filters, are still to be tested

    def partitions(self) -> list[Range]:
        system, root = _opened(self.folder)
        with system.open_input_stream(f"{root}/{MANIFEST}") as f:
            files = json.loads(f.read())
        out = []
        for file in files:
            if file["high"] < self.low or file["low"] > self.high:
                continue
            with system.open_input_file(f"{root}/{file['name']}.idx") as f:
                firsts = np.frombuffer(f.read_at((-(-file["rows"] // _block(f))) * 8, HEAD_SIZE), dtype="<f8")
            a = max(0, int(np.searchsorted(firsts, self.low)) - 1)  # the block before may hold the bound as well
            b = int(np.searchsorted(firsts, self.high, "right"))
            out += [Range(file["name"], k, min(b, k + BLOCKS)) for k in range(a, b, BLOCKS)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, root = _opened(self.folder)
        with system.open_input_file(f"{root}/{partition.name}.idx") as idx, system.open_input_file(f"{root}/{partition.name}.txt") as txt:
            magic, rows, block = struct.unpack(HEAD, idx.read_at(HEAD_SIZE, 0))
            blocks = -(-rows // block)
            if magic != MAGIC or idx.size() != HEAD_SIZE + 8 * blocks + 16 * rows + 8:
                raise ValueError(f"{partition.name} is not a whole blob")
            masses_at, places_at = HEAD_SIZE + 8 * blocks, HEAD_SIZE + 8 * blocks + 8 * rows
            for k in range(partition.first, partition.last):
                a, b = k * block, min(rows, (k + 1) * block)
                mass = np.frombuffer(idx.read_at(8 * (b - a), masses_at + 8 * a), dtype="<f8")
                i, j = a + int(np.searchsorted(mass, self.low)), a + int(np.searchsorted(mass, self.high, "right"))
                if i < j:
                    places = np.frombuffer(idx.read_at(8 * (j - i + 1), places_at + 8 * i), dtype="<i8")
                    data = txt.read_at(int(places[-1] - places[0]), int(places[0]))
                    cut = (places - places[0]).tolist()
                    values = [data[x:y].decode("utf-8") for x, y in zip(cut, cut[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(mass[i - a : j - a], pa.float64()), pa.array(values, pa.string())], names=["mass", "value"])


def _block(idx: pa.NativeFile) -> int:
    return struct.unpack(HEAD, idx.read_at(HEAD_SIZE, 0))[2]


class MassBlobs(DataSource):
    """format("mass_blobs"): mass and value; bounds on mass, as filters or as options low and high, decide what is read."""

    @classmethod
    def name(cls) -> str:
        return "mass_blobs"

    def schema(self) -> str:
        return "mass double, value string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All rows; filters on mass reach the files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MassBlobs)
    return spark.read.format("mass_blobs").load(folder)


def window(spark: SparkSession, folder: str, low: float, high: float) -> DataFrame:
    """The rows with a mass within closed bounds."""
    return read(spark, folder).where(F.col("mass").between(low, high))
