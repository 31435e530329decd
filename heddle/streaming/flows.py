"""Structured Streaming wrappers: the batch operators, run on micro-batches.

State lives in versioned Parquet folders; a batch writes version ``epoch`` whole before the
pointer moves, so a repeated batch (a restart) overwrites its own version and changes
nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heddle.operators import history, indexes


class State:
    """A table with one folder per version; the highest finished version is current."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._fs()
        if not fs.exists(path):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")]
        done = [n for n in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done)

    def read(self, before: int | None = None) -> DataFrame:
        own = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v={own[-1]}") if own else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, version: int, keep: int = 3) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/v={version}")
        _, fs = self._fs()
        for old in self.versions()[:-keep]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v={old}"), True)


def transitions(stream: DataFrame, state: State, step: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Run ``step(state, batch) -> state`` on every micro-batch, exactly once per batch in effect."""

    def run(batch: DataFrame, epoch: int) -> None:
        state.write(step(state.read(before=epoch), batch), epoch)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_state(stream: DataFrame, state: State, key: list[str], seq: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest snapshot of every key of a change log."""
    return transitions(stream, state, lambda old, batch: history.current(old.unionByName(batch.select(*old.columns)), key, [seq]), checkpoint)


def index_maintenance(stream: DataFrame, entries: State, key: list[str], index_key: list[str], projected: list[str], checkpoint: str) -> StreamingQuery:
    """Apply the index actions of changes (key, seq, old, new) to an index; of one item's changes in a batch the first old and the last new count."""

    def step(old: DataFrame, batch: DataFrame) -> DataFrame:
        folded = batch.groupBy(*key).agg(F.min_by("old", "seq").alias("old"), F.max_by("new", "seq").alias("new"))
        return indexes.apply_actions(old, indexes.maintenance(folded, key, index_key, projected), key, index_key)

    return transitions(stream, entries, step, checkpoint)


def last_writer_wins(stream: DataFrame, state: State, key: list[str], rank: str, checkpoint: str) -> StreamingQuery:
    return transitions(stream, state, lambda old, batch: history.import_events(old, history.winners(batch.select(*old.columns), key, history.event_order(F.col(rank))), key, history.event_order(F.col(rank))), checkpoint)


def append_stream(stream: DataFrame, state: State, operation: str, seq: str, checkpoint: str) -> StreamingQuery:
    """An append-only user stream: repeated operation ids are appended once."""
    return transitions(stream, state, lambda old, batch: history.append_once(old, batch, operation, seq), checkpoint)


def windowed_activity(stream: DataFrame, at: str, late: str, window: str, *by: str) -> DataFrame:
    """Counts per window and group; rows later than ``late`` behind the watermark are out, as retention has it."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), *by).agg(F.count("*").alias("n"))
