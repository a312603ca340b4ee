"""Sharding by histogram sort: splitters are found by counting, then rows move once.

Rows are ordered by (crc32 of the text, a hash of id and row): equal texts stand together, and a text with very many copies can
be cut anywhere inside. Each splitter has a bracket of keys around its byte target. A round spreads probes over all open
brackets, counts the exact bytes below every probe in all partitions (a partial histogram per task, summed), and narrows the
brackets, until a probe is within ``tolerance`` of its target or the bracket holds one row. Then every row knows its
range and is exchanged once. A shard whose rows exceed ``rows_per_task`` is cut into several ranges, so no task sorts more.

Law: ``bytes``, shards of nearly equal size. Defined results: a null text has no bytes and crc32 0, every row counts 16 bytes
more; null and repeated ids and repeated rows are placed like others; extra columns are ignored unless carried; shards may stay
empty when there are fewer rows than shards; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerovigil.session import durable

OVERHEAD = 16
PROBES = 48               #: Probes per open bracket and round.
TOLERANCE = 0.0005        #: Of a range's mean size.
ROWS_PER_TASK = 1_000_000


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One narrow row per document with its sort key, written once so that row numbers stay fixed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    crc = F.crc32(F.encode(whole, "UTF-8"))
    low = F.xxhash64(F.col(doc_id), F.monotonically_increasing_id()).bitwiseAND((1 << 31) - 1)
    return durable(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + OVERHEAD).cast("long").alias("size"),
                               crc.alias("text_crc32"), F.shiftleft(crc, 31).bitwiseOR(low).alias("_key"), *(carry or [])))


def histogram(rows: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each probe."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, count = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(probes, batch.column("_key").to_numpy(), "right")
            np.add.at(size, at, batch.column("size").to_numpy())
            count += np.bincount(at, minlength=len(count))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(count[some])], ["at", "bytes", "rows"])

    found = rows.select("_key", "size").mapInArrow(run, "at long, bytes long, rows long")
    total = np.zeros((2, len(probes) + 1), np.int64)
    for r in found.groupBy("at").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect():  # a row per probe
        total[:, r["at"]] = r["bytes"], r["rows"]
    below = np.cumsum(total, axis=1)[:, :-1]
    return below[0], below[1]


def splitters(rows: DataFrame, parts: int, n: int, total: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> np.ndarray:
    """``parts - 1`` keys that cut the rows into ranges of nearly equal bytes."""
    target = np.array([i * total / parts for i in range(1, parts)])
    low, high = np.zeros(parts - 1, np.int64), np.full(parts - 1, np.iinfo(np.int64).max, np.int64)
    below_low, below_high = np.zeros(parts - 1), np.full(parts - 1, float(total))
    rows_low, rows_high = np.zeros(parts - 1, np.int64), np.full(parts - 1, n)
    slack = max(1.0, tolerance * total / parts)

    def open_() -> np.ndarray:
        near = np.minimum(target - below_low, below_high - target) <= slack
        return np.flatnonzero(~near & (high - low > 1) & (rows_high - rows_low > 1))

    while len(now := open_()):
        asked = np.unique(np.concatenate([low[i] + ((high[i] - low[i]) // (probes + 1) + 1) * np.arange(1, probes + 1) for i in now]))
        asked = asked[asked > 0]  # a step past the largest key wraps around
        below, count = histogram(rows, asked)
        for i in now:
            k = int(np.searchsorted(below, target[i], "right"))  # the first probe with more bytes below than wanted
            for at in range(max(0, k - 1), min(len(asked), k + 1)):
                if below[at] <= target[i] and low[i] < asked[at] < high[i]:
                    low[i], below_low[i], rows_low[i] = asked[at], below[at], count[at]
                elif below[at] > target[i] and low[i] < asked[at] < high[i]:
                    high[i], below_high[i], rows_high[i] = asked[at], below[at], count[at]
    return np.maximum.accumulate(np.where(target - below_low <= below_high - target, low, high)) if parts > 1 else low


def shard(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None,
          tolerance: float = TOLERANCE, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, *carry), a row per document row."""
    rows = keyed(docs, doc_id, text, carry)
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    fine = max(1, -(-n // (shards * rows_per_task)))
    keys = splitters(rows, shards * fine, n, total, tolerance)
    _, below = histogram(rows, np.unique(keys))
    below = dict(zip(np.unique(keys).tolist(), below.tolist()))
    first = np.array([0] + [below[k] for k in keys.tolist()], np.int64)  # rows before each range
    start = first - first[np.arange(shards * fine) // fine * fine]       # rows before it within its shard

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(keys, batch.column("_key").to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(start[at])], [*batch.schema.names, "_range", "_start"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_range", T.LongType()), T.StructField("_start", T.LongType())])
    placed = rows.mapInArrow(place, schema)
    number = F.row_number().over(Window.partitionBy("_range").orderBy("_key", "doc_id"))
    return placed.withColumn("_slot", F.col("_start") + number - 1).select(
        F.col("doc_id").alias(doc_id), "size", "text_crc32", F.lit("bytes").alias("law"),
        F.floor(F.col("_range") / fine).cast("int").alias("shard"), F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), *(carry or []))


def write(docs: DataFrame, folder: str, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> None:
    """The documents as one folder per shard, in slot order within each file."""
    carry = [c for c in docs.columns if c != doc_id and c not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    placed = shard(docs, shards, doc_id, text, carry)
    placed.sortWithinPartitions("shard", "slot").select(doc_id, *carry, "shard", "slot").write.partitionBy("shard").parquet(folder)
