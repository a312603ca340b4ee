"""Keyed folds in event-time order, whatever order rows arrive in.

Rows wait in keyed state, packed by time bucket, until the watermark has passed their bucket; an event-time timer then folds the
bucket's rows in order, bucket after bucket, and carries the small folded state on. A task therefore holds one bucket of one key at a
time (small ones together, ``ROWS_AT_ONCE``), and the state store (RocksDB) holds what lies between the watermark and the newest row on
disk. Rows later than the watermark are dropped by Spark, as everywhere in Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from aerovigil.session import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSING = "stream_end"   #: Marks the row that closes a bounded stream; it is never folded.
ROWS_AT_ONCE = 10_000   #: Small buckets of a key that are due are folded together, up to so many rows and a bucket.
CLOSES_AT = "2200-01-01"   #: Its time, late in the range that pandas holds in nanoseconds.


class OrderedFold(StatefulProcessor):
    """``fold(state, rows)`` takes the carried tuple and a frame in (ts, source_row_id) order, and returns the next tuple and results."""

    def __init__(self, fold: Callable, fresh: Callable[[], tuple], state: str, key: str, bucket_ms: int):
        self.fold, self.fresh, self.state, self.key, self.bucket_ms = fold, fresh, state, key, bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long, part long", "rows binary")
        self.carried = handle.getValueState("carried", self.state)
        self.parts = handle.getValueState("parts", "next long")
        self.passed, self.folded = None, set()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number = self.parts.get()[0] if self.parts.exists() else 0
        for part in rows:
            part = part[~part[CLOSING].astype(bool)]
            bucket = (part["ts"].astype("datetime64[us]").astype("int64") // (1000 * self.bucket_ms)).to_numpy()
            order = np.argsort(bucket, kind="stable")
            buckets, starts = np.unique(bucket[order], return_index=True)
            batch = pa.RecordBatch.from_pandas(part.iloc[order], preserve_index=False) if len(part) else None
            for at, start, end in zip(buckets.tolist(), starts.tolist(), [*starts.tolist()[1:], len(part)]):
                self.waiting.updateValue((at, number), (_pack(batch.slice(start, end - start)),))
                self.handle.registerTimer((at + 1) * self.bucket_ms)
                number += 1
        self.parts.update((number,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        if passed != self.passed:
            self.passed, self.folded = passed, set()
        if key in self.folded:
            return  # an earlier timer of this batch has folded all that is due
        self.folded.add(key)
        held = list(self.waiting.keys())
        due = sorted((at, number) for at, number in held if (at + 1) * self.bucket_ms <= passed)
        if not due:
            return
        state = self.carried.get()
        state = self.fresh() if state is None else tuple(state)
        parts: list[pa.Table] = []
        for i, (at, number) in enumerate(due):
            parts.append(_unpack(self.waiting.getValue((at, number))[0]))
            if i + 1 < len(due) and (due[i + 1][0] == at or sum(p.num_rows for p in parts) < ROWS_AT_ONCE):
                continue
            rows = pa.concat_tables(parts, promote_options="permissive").to_pandas().sort_values(["ts", "source_row_id"], ignore_index=True)
            parts = []
            state, out = self.fold(state, rows)
            out.insert(0, self.key, key[0])
            yield out
        if len(due) == len(held):
            self.waiting.clear()
        else:
            for k in due:
                self.waiting.removeKey(k)
        self.carried.update(state)


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def in_order(stream: DataFrame, fold: Callable, fresh: Callable[[], tuple], state: str, result: str, delay: str, key: str = "node_id",
             bucket_ms: int = 60_000) -> DataFrame:
    """The results of ``fold`` per key over a stream with ``ts`` and ``source_row_id``, emitted as the watermark passes each bucket."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    if CLOSING not in timed.columns:
        timed = timed.withColumn(CLOSING, F.lit(False))
    return timed.withWatermark("ts", delay).groupBy(key).transformWithStateInPandas(
        OrderedFold(fold, fresh, state, key, bucket_ms), T._parse_datatype_string(result), "Append", "EventTime")


def run_to_end(stream: DataFrame, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """All results of ``build`` over a bounded stream, also those that wait for the watermark.

    The stream runs until nothing new is available. A closing row far in the future is then added to a second source and the query is
    started again from its checkpoint: the watermark passes every row that waits, and their timers fire.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    timed = stream.withColumns({"ts": F.col("ts").cast("timestamp"), CLOSING: F.lit(False)})
    spark.createDataFrame([], timed.schema).write.parquet(f"{folder}/close")
    closing = spark.readStream.schema(timed.schema).parquet(f"{folder}/close")
    results = build(timed.unionByName(closing))

    def run() -> None:
        query = (results.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/data")
                 .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
        query.awaitTermination()

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        run()
        fixed = {"ts": F.lit(CLOSES_AT), CLOSING: F.lit(True)}
        row = spark.range(1).select(*[fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in timed.schema])
        row.write.mode("append").parquet(f"{folder}/close")
        run()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(results.schema).parquet(f"{folder}/data")
