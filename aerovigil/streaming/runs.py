"""Starting streams: bounded runs over what is available, and the event-log sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerovigil import constants as K
from aerovigil.functions.hashing import record_hash
from aerovigil.operators import ledger
from aerovigil.operators.ordered import add_positions
from aerovigil.session import shared_folder

FILES = 256   #: Files that a micro-batch reads at most.
PROGRESS = 20_000   #: Reports of progress that a counted run keeps, a small record per micro-batch.
REPORTS = "spark.sql.streaming.numRecentProgressUpdates"


def read_table(spark: SparkSession, pattern: str, schema=None, files: int = FILES) -> DataFrame:
    """Stream of the parquet files that match a path pattern, at most ``files`` of them in a micro-batch."""
    schema = schema or spark.read.parquet(pattern).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(pattern)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Processes everything available, then returns what was written, as a batch frame."""
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/data")
             .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")


def run_counted(stream: DataFrame, name: str, mode: str = "append") -> tuple[DataFrame, DataFrame]:
    """As ``run_available``, with a second frame (batch, read, late, state_rows) of what each micro-batch read, dropped as late and kept.

    ``late`` counts rows that are not after the watermark with which the micro-batch before evicted its state: the latest time seen
    up to the one before that, less the delay. State that a row is compared with is evicted after the micro-batch, so a repeated row
    meets either the state or that watermark and never comes out a second time.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    before = spark.conf.get(REPORTS)
    spark.conf.set(REPORTS, PROGRESS)
    try:
        query = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/data")
                 .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.set(REPORTS, before)
    if len(query.recentProgress) >= PROGRESS:
        raise ValueError(f"more than {PROGRESS} reports of progress: read more files in a micro-batch")
    rows = [(p["batchId"], p["numInputRows"], sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"]),
             sum(o["numRowsTotal"] for o in p["stateOperators"])) for p in query.recentProgress]
    counted = spark.createDataFrame(rows, "batch long, read long, late long, state_rows long")
    return spark.read.schema(stream.schema).parquet(f"{folder}/data"), counted


def event_log_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: hashes the events of a micro-batch and writes them under its number.

    Rewriting the folder of a repeated batch keeps the log free of duplicates after a failure.
    """
    def write(batch: DataFrame, number: int) -> None:
        (batch.withColumn("log_hash", record_hash(batch)).withColumn("stream_batch", F.lit(number).cast("bigint"))
         .write.mode("overwrite").parquet(f"{path}/stream_batch_id={number}"))
    return write


def merkle_log_writer(spark: SparkSession, path: str, order: tuple[str, ...] = ("ts", "event_id"),
                      rows: int = K.LEDGER_ROWS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that seals a stream of events into Merkle batches of ``rows``.

    The events of a micro-batch follow those that the one before left over in an unfilled batch. Full batches are written to
    ``roots`` and ``log``, the rest to ``carry``, each in the micro-batch's own folder. A repeated micro-batch reads the same carry and
    overwrites the same folders, so a replay changes nothing.
    """
    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.withColumn("log_hash", record_hash(batch)).withColumns({"log_timestamp": F.col(order[0]).cast("string"), "_age": F.lit(1)})
        events, before = fresh, 0
        if number:
            carried = spark.read.schema(T.StructType([*fresh.schema.fields, T.StructField("_pos", T.LongType())])).parquet(f"{path}/carry/{number - 1}")
            row = spark.read.parquet(f"{path}/sealed/{number - 1}").first()
            events, before = fresh.unionByName(carried.drop("_pos").withColumn("_age", F.lit(0))), row.sealed
        placed = add_positions(events, ["_age", *order]).withColumn("_pos", F.col("_pos") + before)
        placed.write.mode("overwrite").parquet(f"{path}/placed/{number}")
        placed = spark.read.schema(placed.schema).parquet(f"{path}/placed/{number}")
        sealed = (before + placed.count()) // rows * rows
        log = placed.where(F.col("_pos") <= sealed).withColumn("batch_id", F.expr(f"(_pos - 1) div {rows} + 1"))
        log.drop("_age").write.mode("overwrite").parquet(f"{path}/log/stream_batch_id={number}")
        ledger.merkle_batches(log, rows).write.mode("overwrite").parquet(f"{path}/roots/stream_batch_id={number}")
        placed.where(F.col("_pos") > sealed).coalesce(1).write.mode("overwrite").parquet(f"{path}/carry/{number}")
        spark.createDataFrame([(int(sealed),)], "sealed bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/sealed/{number}")
    return write


def seal_available(stream: DataFrame, name: str, order: tuple[str, ...] = ("ts", "event_id"), rows: int = K.LEDGER_ROWS) -> tuple[DataFrame, DataFrame]:
    """(log, Merkle batches) of everything available; the last unfilled batch is closed at the end."""
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    query = (stream.writeStream.foreachBatch(merkle_log_writer(spark, f"{folder}/m", order, rows))
             .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
    query.awaitTermination()
    last = query.lastProgress.batchId
    log, roots = (spark.read.parquet(f"{folder}/m/{k}").drop("stream_batch_id") for k in ("log", "roots"))
    left = spark.read.schema(T.StructType([*log.drop("_pos", "batch_id").schema.fields, T.StructField("_age", T.IntegerType()), T.StructField("_pos", T.LongType())])).parquet(
        f"{folder}/m/carry/{last}").drop("_age").withColumn("batch_id", F.expr(f"(_pos - 1) div {rows} + 1"))
    return log.unionByName(left), roots.unionByName(ledger.merkle_batches(left, rows))


def log_available(stream: DataFrame, name: str) -> DataFrame:
    """Writes a stream of events to a fresh log folder and reads the log back."""
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    query = (stream.writeStream.foreachBatch(event_log_writer(f"{folder}/log"))
             .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/log")
