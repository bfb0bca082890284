"""Streams: the hand-off of completed molecules as files, stateful reservoirs, and windows of events.

The last three go beyond what batch retrieval needs; they are for the events
that surround it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..sources.sinks import read_text, write_text

HANDOFF = "molecule_id string, ranking array<string>, confidence double, expired boolean"


def handoffs(spark: SparkSession, folder: str, schema: str = HANDOFF, files: int = 2) -> DataFrame:
    """The stream of completed hand-offs: JSON files that appear whole in a folder, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def emit(df: DataFrame, folder: str) -> None:
    """Hand-offs as files of a folder; Spark's committer lets each appear whole."""
    df.write.mode("append").json(folder)


def consume(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, key: str = "molecule_id") -> StreamingQuery:
    """Each molecule once, whatever fails between: repeated ids are dropped, and a batch has the same number when it is tried again."""
    return stream.dropDuplicates([key]).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: A hand-off's events: a molecule that was asked for with its original ranking, its revised ranking, or the end of all ('end', far in the future).
EVENT = "kind string, molecule_id string, ranking array<string>, at timestamp"
ANSWER = "molecule_id string, ranking array<string>, status string"
END = "9999-01-01 00:00:00"
MARKER = "complete.json"


class Deadlines(StatefulProcessor):
    """For each molecule: its original ranking until the revised one comes, or its time is up.

    A revised ranking within its time is given out with status 'revised', and
    a second one for the molecule fails the query.  When the watermark passes
    the deadline, a molecule without one is given its original ranking, with
    status 'expired', and its state is dropped either way; so is what is known
    of answered ones, which makes the state as large as the molecules that are
    under way.  A ranking for a molecule that isn't under way is 'unexpected'.
    """

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.under_way = handle.getValueState("under_way", "ranking array<string>, answered boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in sorted(rows, key=lambda r: (r["kind"] != "asked", r["at"])):  # of one batch, what was asked goes first
            if r["kind"] == "end":
                continue
            state = self.under_way.get() if self.under_way.exists() else None
            if r["kind"] == "asked":
                if state is not None:
                    raise ValueError(f"molecule {key[0]} was asked for twice")
                due = int(r["at"].timestamp() * 1000) + self.patience
                if due <= timerValues.getCurrentWatermarkInMs():  # its time was up before it came
                    yield Row(molecule_id=key[0], ranking=r["ranking"], status="expired")
                else:
                    self.under_way.update((r["ranking"], False))
                    self.handle.registerTimer(due)
            elif state is None:
                yield Row(molecule_id=key[0], ranking=r["ranking"], status="unexpected")
            elif state[1]:
                raise ValueError(f"molecule {key[0]} was handed off twice")
            else:
                self.under_way.update((state[0], True))
                yield Row(molecule_id=key[0], ranking=r["ranking"], status="revised")

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.under_way.exists():
            ranking, answered = self.under_way.get()
            self.under_way.clear()
            if not answered:
                yield Row(molecule_id=key[0], ranking=list(ranking), status="expired")

    def close(self) -> None:
        pass


def answered(events: DataFrame, patience_ms: int, late: str = "0 seconds") -> DataFrame:
    """(molecule_id, ranking, status) of a stream of EVENT rows, each molecule once.  Needs the RocksDB state store, which timers rest on."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events.withWatermark("at", late).groupBy("molecule_id").transformWithState(statefulProcessor=Deadlines(patience_ms), outputStructType=ANSWER, outputMode="append", timeMode="eventTime")


def complete(spark: SparkSession, folder: str) -> None:
    """Ends a folder of events: an event in the far future, so that all deadlines pass, and then the marker."""
    spark.sql(f"select 'end' as kind, '' as molecule_id, cast(array() as array<string>) as ranking, timestamp '{END}' as at").write.mode("append").json(folder)
    write_text(spark, f"{folder.rstrip('/')}/_{MARKER}", "{}")


def until_complete(spark: SparkSession, folder: str, start: Callable[[DataFrame], StreamingQuery], wait: float = 1.0, most: int | None = None) -> int:
    """Runs passes over the folder's events until one has begun after the marker was there; the number of passes.

    ``start`` begins a query of a stream that ends with what is available;
    TimeoutError after ``most`` passes without a marker.
    """
    passes = 0
    while True:
        last = read_text(spark, f"{folder.rstrip('/')}/_{MARKER}") is not None
        query = start(spark.readStream.schema(EVENT).json(folder))
        query.awaitTermination()
        passes += 1
        if last:
            return passes
        if most is not None and passes >= most:
            raise TimeoutError(f"{folder} was not completed within {most} passes")
        time.sleep(wait)


def settled(df: DataFrame, original: str = "original", revised: str = "ranking") -> DataFrame:
    """``final``: the revised ranking, or the original where the deadline passed."""
    return df.withColumn("final", F.when(F.coalesce("expired", F.lit(False)), F.col(original)).otherwise(F.col(revised)))


def windowed_counts(events: DataFrame, time: str, by: list[str], size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts by window of event time; on a stream, with a watermark."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """key, start, end, n of sessions that a gap ends."""
    rows = events.withWatermark(time, gap) if events.isStreaming else events
    out = rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def reservoirs(stream: DataFrame, key: str, row: str, k: int = 4) -> DataFrame:
    """For each key the k rows of smallest hash so far, kept as state: (key, rows), a line whenever they change.

    The same rows as the batch sample of a hash order, whatever the batches.
    """
    own = stream.select(F.col(key).cast("string").alias("key"), F.col(row).cast("long").alias("row"), F.xxhash64(F.col(key).cast("string"), F.col(row).cast("long")).alias("h"))

    def step(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        old = list(zip(*state.get, strict=True)) if state.exists else []
        new = sorted({*old, *((int(h), int(r)) for b in batches for h, r in zip(b["h"], b["row"], strict=True))})[:k]
        state.update(([h for h, _ in new], [r for _, r in new]))
        if new != old:
            yield pd.DataFrame({"key": [name[0]], "rows": [[r for _, r in new]]})

    return own.groupBy("key").applyInPandasWithState(step, "key string, rows array<long>", "h array<long>, r array<long>", "update", "NoTimeout")
