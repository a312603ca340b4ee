"""Compressed traffic and radio summaries per time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerovigil.functions import scalars as S
from aerovigil.functions.hashing import pseudonym
from aerovigil.operators import membership
from aerovigil.operators.quantiles import grouped_quantiles

SOURCE_FILTER = membership.BloomShape.for_capacity(5_000, 0.01)   #: Fixed values: shape of a traffic sketch's source filter.
LOG_K = 12                                                        #: Registers of a distinct sketch, as a power of two.

_TRAFFIC = {"pps": "packets_per_second", "bps": "bytes_per_second", "syn_rate": "syn_packet_rate",
            "src_entropy": "src_ip_entropy"}
_RADIO = {"snr_db": 0.0, "noise_floor_dbm": -90.0, "bit_error_rate": 0.0, "packet_delivery_ratio": 1.0,
          "channel_occupancy_pct": 20.0}


def _rounded(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.round(value, digits)


def traffic_sketch(df: DataFrame, seconds: float = 10.0, rows_per_task: int = 1_000_000, digits: int | None = 2) -> DataFrame:
    """Mean, maximum and 95th percentile of the rates, distinct node pseudonyms, share of attacks; ``digits`` None: unrounded."""
    keyed = df.select(S.bucket_start(F.col("ts"), seconds).alias("window_start"), "node_id", "final_label", *[
        F.coalesce(S.with_default(df, c, 0.0).cast("double"), F.lit(0.0)).alias(n) for n, c in _TRAFFIC.items()])
    attack = ~F.col("final_label").isin("NORMAL", "SUSPICIOUS")
    base = keyed.groupBy("window_start").agg(
        F.count("*").alias("total_windows"), F.count_if(attack).alias("attack_windows"),
        *[_rounded(f(n), digits).alias(f"{n}_{k}") for n in _TRAFFIC for k, f in (("mean", F.avg), ("max", F.max))])
    sources = (keyed.select("window_start", pseudonym(F.col("node_id")).alias("source")).distinct()
               .groupBy("window_start").agg(F.count("*").alias("unique_sources_hashed")))
    upper = grouped_quantiles(keyed, ["window_start"], {f"{n}_p95": (n, 0.95) for n in _TRAFFIC},
                              rows_per_task=rows_per_task)
    upper = upper.select("window_start", *[_rounded(F.col(f"{n}_p95"), digits).alias(f"{n}_p95") for n in _TRAFFIC])
    return (base.join(sources, "window_start").join(upper, "window_start")
            .withColumn("attack_fraction", F.round(F.col("attack_windows") / F.col("total_windows"), 4)))


def channel_change(action: Column) -> Column:
    """The action names a channel, a hop or a switch."""
    return action.rlike("CHANNEL|HOP|SWITCH")


def radio_sketch(df: DataFrame, seconds: float = 10.0, digits: int | None = 4) -> DataFrame:
    """Mean, population deviation, min and max of the radio metrics; jamming and channel events."""
    keyed = df.withColumn("window_start", S.bucket_start(F.col("ts"), seconds)).withColumns(
        {c: F.coalesce(S.with_default(df, c, d).cast("double"), F.lit(d)) for c, d in _RADIO.items()})
    return keyed.groupBy("window_start").agg(
        F.count("*").alias("total_windows"), F.count_if(F.col("final_label").isin("JAMMING", "HYBRID_ATTACK")).alias("jamming_windows"),
        *[_rounded(f(c), digits).alias(f"{c}_{k}") for c in _RADIO
          for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))],
        F.count_if(channel_change(S.with_default(df, "rf_action_taken", ""))).alias("channel_switch_events"),
        F.count_if(S.with_default(df, "lte_fallback_active", False)).alias("lte_fallback_events"))


def source_filters(df: DataFrame, seconds: float = 10.0, item: str = "node_id") -> tuple[DataFrame, DataFrame]:
    """(filter summary per window, filter blocks per window): what a traffic sketch tells of its sources. Blocks of any windows
    merge into the filter of their whole time by ``membership.merge``."""
    keyed = df.select(S.bucket_start(F.col("ts"), seconds).alias("window_start"), F.coalesce(F.col(item).cast("string"), F.lit("")).alias(item))
    return (membership.summary_by(keyed, ["window_start"], item, SOURCE_FILTER),
            membership.build_by(keyed, ["window_start"], item, SOURCE_FILTER))


def distinct_sketches(df: DataFrame, item: str, seconds: float = 10.0, log_k: int = LOG_K) -> DataFrame:
    """(window_start, sketch, rows): a HyperLogLog sketch of the distinct items per window, 2^log_k bytes or fewer, partially aggregated."""
    keyed = df.select(S.bucket_start(F.col("ts"), seconds).alias("window_start"), F.col(item).cast("string").alias("item"))
    return keyed.groupBy("window_start").agg(F.hll_sketch_agg("item", log_k).alias("sketch"), F.count("*").alias("rows"))


def roll_up(sketches: DataFrame, seconds: float | None = None) -> DataFrame:
    """Sketches merged into longer windows, or into one row without ``seconds``; the items are not read again."""
    keys = [] if seconds is None else [(F.col("window_start") - F.pmod("window_start", F.lit(int(seconds * 1e6)))).alias("window_start")]
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("rows").alias("rows"))


def distinct_bound(log_k: int = LOG_K, deviations: float = 3.0) -> float:
    """Largest relative error of an estimate, ``deviations`` standard errors of HyperLogLog."""
    return deviations * 1.04 / 2 ** (log_k / 2)
