"""Temporal features of the radio tier and of the traffic tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerovigil import constants as K
from aerovigil.functions import scalars as S
from aerovigil.functions.joins import join_rows
from aerovigil.operators import series as R
from aerovigil.operators.ordered import ROWS_PER_TASK, order_rows
from aerovigil.operators.quantiles import normal_quantiles

ORDER = ["ts", "source_row_id"]
KEYS = ["node_id"]


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: S.to_number(F.col(c)) for c in columns if c in df.columns})


def radio_thresholds(df: DataFrame) -> dict[str, float]:
    return normal_quantiles(df, {m: (m, q) for m, (q, _) in K.JAM_FLAG_TARGETS.items()})


def traffic_thresholds(df: DataFrame) -> dict[str, float]:
    specs = {m: (m, q) for m, (q, _) in K.DOS_FLAG_TARGETS.items()}
    return normal_quantiles(df, {**specs, "low_entropy": ("src_ip_entropy", 0.10),
                                 "high_entropy": ("src_ip_entropy", 0.99),
                                 "high_error": ("error_response_rate", 0.99)})


def radio_features(df: DataFrame, thresholds: dict[str, float] | None = None,
                   rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """EWMA, rolling statistics, deltas, CUSUM, confirmed flags, composite score, noise drift."""
    df = numeric(df, K.JAM_METRICS)
    thresholds = thresholds or radio_thresholds(df)
    s = order_rows(df, ORDER, KEYS, halo=R.HALO_ROWS, rows_per_task=rows_per_task)
    has = set(df.columns)
    col = F.col
    first = {}
    for m, widths in K.ROLLING_TARGETS.items():
        for w in widths if m in has else []:
            first[f"{m}_roll_mean_{w}s"] = R.rolling(s, col(m), w, "mean")
            first[f"{m}_roll_std_{w}s"] = R.rolling(s, col(m), w, "std")
    for m in K.DELTA_METRICS:
        if m in has:
            first[f"{m}_delta"] = R.delta(s, col(m))
    first.update(R.threshold_flags(s, {m: t for m, t in K.JAM_FLAG_TARGETS.items() if m in has}, thresholds))
    out = s.rows.withColumns(first)
    changes = {f"{m}_abs_delta": F.abs(f"{m}_delta") for m in K.DELTA_METRICS if m in has}
    drops = {name: F.abs(F.least(col(f"{m}_delta"), F.lit(0.0))) for name, m in K.DROP_COLUMNS.items() if m in has}
    out = out.withColumns({**changes, **drops})
    out = R.ewma(s, out, [m for m in K.EWMA_METRICS if m in has])
    directions = {m: d for m, d in K.JAM_CUSUM.items() if m in has}
    warm = [*directions, *(["noise_floor_dbm"] if "noise_floor_dbm" in has else [])]
    out = R.cusum(s, R.warmup_statistics(s, out, warm), directions)
    out = R.noise_drift(s, out).drop(*[f"_{k}_{m}" for k in ("mu", "sd") for m in warm])
    fired = [c for c in out.columns if c.endswith("_flag") and c != "noise_floor_drift_flag"
             and any(m in c for m in K.JAM_METRICS)]
    score = S.total([col(c) for c in fired]) if fired else F.lit(0)
    return s.finish(out.withColumn("jam_threshold_score", score)).drop("_pos")


def traffic_features(df: DataFrame, thresholds: dict[str, float] | None = None,
                     rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Bursts, entropy dynamics, CUSUM, protocol shares, connection exhaustion, flags, score."""
    df = numeric(df, K.DOS_METRICS)
    thresholds = thresholds or traffic_thresholds(df)
    has = set(df.columns)
    packets = F.nullif(F.col("packets_per_second"), F.lit(0.0)) if "packets_per_second" in has else F.lit(1.0)
    shares = {"syn_fraction": "syn_packet_rate", "icmp_fraction": "icmp_packet_rate",
              "udp_fraction": "udp_packet_rate", "fin_rst_fraction": "fin_rst_rate"}
    df = df.withColumns({n: S.guarded_ratio(F.col(m), packets, 0.0, 1.0) for n, m in shares.items() if m in has})
    s = order_rows(df, ORDER, KEYS, halo=31, rows_per_task=rows_per_task)
    col, out = F.col, {}
    for m in K.BURST_METRICS:
        if m in has:
            out[f"{m}_burst_index"] = S.guarded_ratio(col(m), R.rolling(s, col(m), 30, "mean"), 1.0, 1000.0)
            out[f"{m}_roll_std_10s"] = R.rolling(s, col(m), 10, "std")
            out[f"{m}_roll_mean_5s"] = R.rolling(s, col(m), 5, "mean")
    if "src_ip_entropy" in has:
        out["src_entropy_delta"] = R.delta(s, col("src_ip_entropy"))
        out["src_entropy_roll_min_10s"] = R.rolling(s, col("src_ip_entropy"), 10, "min")
        recent = R.rolling(s, col("src_ip_entropy"), 5, "mean")
        out["low_src_entropy_flag"] = S.flag(recent < thresholds["low_entropy"])
        out["high_src_entropy_flag"] = S.flag(recent > thresholds["high_entropy"])
    if "dst_ip_entropy" in has:
        out["dst_entropy_delta"] = R.delta(s, col("dst_ip_entropy"))
        if "src_ip_entropy" in has:
            out["entropy_asymmetry"] = col("src_ip_entropy") - col("dst_ip_entropy")
    if "syn_packet_rate" in has:
        out["syn_fraction_delta"] = R.delta(s, col("syn_fraction"), absolute=True)
        out["syn_dominance"] = R.rolling(s, col("syn_fraction"), 5, "max")
    if "half_open_connections" in has:
        out["half_open_accel"] = R.delta(s, col("half_open_connections"))
        out["half_open_roll_mean"] = R.rolling(s, col("half_open_connections"), 10, "mean")
    if "error_response_rate" in has:
        out["error_rate_delta"] = R.delta(s, col("error_response_rate"), absolute=True)
        out["error_rate_roll_mean"] = R.rolling(s, col("error_response_rate"), 10, "mean")
    if "unique_source_count" in has:
        out["source_count_accel"] = R.delta(s, col("unique_source_count"))
        out["source_count_roll_max"] = R.rolling(s, col("unique_source_count"), 10, "max")
    out.update(R.threshold_flags(s, {m: t for m, t in K.DOS_FLAG_TARGETS.items() if m in has}, thresholds))
    done = s.rows.withColumns(out)
    late = {}
    if "src_ip_entropy" in has:
        late["src_entropy_drop"] = F.abs(F.least(col("src_entropy_delta"), F.lit(0.0)))
        late["src_entropy_spike"] = F.greatest(col("src_entropy_delta"), F.lit(0.0))
    if "error_response_rate" in has:
        late["high_error_rate_flag"] = S.flag(col("error_rate_roll_mean") > thresholds["high_error"])
    done = done.withColumns(late) if late else done
    directions = {m: d for m, d in K.DOS_CUSUM.items() if m in has}
    done = R.cusum(s, R.warmup_statistics(s, done, list(directions)), directions)
    done = done.drop(*[f"_{k}_{m}" for k in ("mu", "sd") for m in directions])
    fired = [c for c in done.columns if c.endswith("_flag") and any(m in c for m in K.DOS_METRICS)]
    score = S.total([col(c) for c in fired]) if fired else F.lit(0)
    return s.finish(done.withColumn("dos_threshold_score", score)).drop("_pos")


def rolling_packet_context(samples: DataFrame, rows: int = 20, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rates, sizes, spreads and distinct sources over the last packets of each node."""
    s = order_rows(samples, ["ts", "packet_id"], KEYS, halo=rows, rows_per_task=rows_per_task)
    col = F.col
    mean = lambda c: R.rolling(s, col(c), rows, "mean")
    rate = 1.0 / (mean("iat_s") + 1e-6)
    out = {
        "packets_per_second": rate, "bytes_per_second": rate * mean("frame_len"),
        "mean_packet_size_bytes": mean("frame_len"), "rssi_roll_std": R.rolling(s, col("rssi_dbm"), rows, "std"),
        "retry_roll_sum": R.rolling(s, col("mac_retry_count"), rows, "sum"),
        "badfcs_roll_mean": mean("bad_packet_ratio"), "udp_roll_rate": mean("is_udp"),
        "icmp_roll_rate": mean("is_icmp"), "arp_roll_rate": mean("arp_flag"),
        "ttl_roll_std": R.rolling(s, col("ip_ttl"), rows, "std"),
        "unique_source_count": F.size(F.collect_set(F.coalesce("ip_src", F.lit("nan")))
                                      .over(s.last_rows(rows))).cast("double")
        if "ip_src" in samples.columns else F.lit(1.0),
    }
    return s.finish(s.rows.withColumns(out)).drop("_pos")


def tier_features(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Radio features of edge rows and traffic features of gateway rows on every row, absent ones 0."""
    from aerovigil.operators.windows import split_tiers

    edge, gateway = split_tiers(df)
    radio = radio_features(edge, rows_per_task=rows_per_task)
    traffic = traffic_features(gateway, rows_per_task=rows_per_task)
    new_radio = [c for c in radio.columns if c not in df.columns]
    new_traffic = [c for c in traffic.columns if c not in df.columns]
    out = join_rows(join_rows(df, radio.select("source_row_id", *new_radio), "left"), traffic.select("source_row_id", *new_traffic), "left")
    metrics = [m for m in K.ALL_METRICS if m in df.columns]
    return out.na.fill(0.0, metrics + new_radio + new_traffic)
