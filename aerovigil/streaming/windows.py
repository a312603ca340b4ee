"""Streaming windows: radio means, gateway traffic with entropies, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerovigil.constants import JAM_METRICS
from aerovigil.operators.windows import gateway_columns, gateway_counts


def with_event_time(stream: DataFrame, delay: str, column: str = "ts") -> DataFrame:
    """Event time as a timestamp with a watermark; later rows are dropped."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def edge_windows(stream: DataFrame, length: str = "1 second", delay: str = "1 second") -> DataFrame:
    """Mean of the radio metrics per (node, window), emitted when the window closes."""
    metrics = [m for m in JAM_METRICS if m in stream.columns]
    closed = with_event_time(stream, delay).groupBy(F.window("ts", length), "node_id").agg(
        F.count("*").alias("samples"), *[F.avg(m).alias(m) for m in metrics])
    return closed.select("node_id", F.unix_micros("window.start").alias("window_start"),
                         F.lit("edge").alias("collection_point"), "samples", *metrics)


def gateway_windows(stream: DataFrame, length: str = "1 second", delay: str = "1 second",
                    gateway: str = "gcc_001") -> DataFrame:
    """Gateway traffic per window. Entropies need counts per value, so two aggregations are chained."""
    timed = with_event_time(stream, delay)
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(c, F.lit("")).alias("value"))
                       for c in ("ip_src", "ip_dst")])
    # Packet totals are summed along the source values, where every packet occurs exactly once.
    values = (timed.select("*", F.explode(fields).alias("f")).select("*", "f.*").groupBy(
        F.window("ts", length), "field", "value").agg(*gateway_counts()))
    source = F.col("field") == "ip_src"
    sums = []
    for c in ("ip_src", "ip_dst"):
        n = F.when(F.col("field") == c, F.col("n"))
        sums += [F.sum(n).alias(f"_n_{c}"), F.sum(n * F.log2(n)).alias(f"_nlogn_{c}")]
    totals = [F.sum(F.when(source, F.col(c))).alias(c) for c in ("n", "total_bytes", "icmp", "udp", "syn", "fin_rst")]
    whole = values.groupBy(F.window(F.window_time("window"), length)).agg(
        *totals, *sums, F.count_if(source).alias("ip_src_distinct"))
    entropies = {f"{c}_entropy": F.log2(F.col(f"_n_{c}")) - F.col(f"_nlogn_{c}") / F.col(f"_n_{c}") for c in ("ip_src", "ip_dst")}
    ready = whole.withColumns({**entropies, "_src_null": F.lit(0), "window_start": F.unix_micros("window.start")})
    return gateway_columns(ready, gateway)


def first_per_key(stream: DataFrame, delay: str = "1 second") -> DataFrame:
    """One row per (ts, node) among the rows that arrive within the watermark."""
    return with_event_time(stream, delay).dropDuplicatesWithinWatermark(["ts", "node_id"])
