"""Score fusion: risk scores, final label, severity, reason codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerovigil.functions import scalars as S
from aerovigil.functions.joins import join_rows
from aerovigil.operators.ordered import ROWS_PER_TASK, order_rows
from aerovigil.operators.quantiles import normal_quantiles
from aerovigil.operators.series import run_length

# Decision limits.
JAM_STRONG, JAM_MODERATE = 0.60, 0.40
DOS_STRONG, DOS_MODERATE = 0.60, 0.30
HYBRID_GATE, SIDE_GATE, SUSPICIOUS = 0.60, 0.30, 0.10

EDGE_COLUMNS = ["gru_jam_score", "gru_jam_flag", "ae_jam_score", "ae_jam_flag", "edge_alarm"]
FEATURE_COLUMNS = ["cross_layer_anomaly_score", "swarm_consensus_anomaly_score", "jam_threshold_score",
                   "dos_threshold_score", "coordinated_flood_flag", "cross_layer_attack_flag", "unique_source_count",
                   "src_ip_entropy", "noise_floor_drift_flag", "bit_error_rate", "snr_db"]
GATEWAY_COLUMNS = ["jamming_conf_attack", "dos_conf_attack", "hybrid_conf_attack", "jamming_ae_flag",
                   "dos_ae_flag", "traffic_outlier"]


def attach_scores(df: DataFrame, edge: DataFrame | None, gateway: DataFrame | None) -> DataFrame:
    """Left-join both tiers' results by source_row_id; only columns the frame lacks.

    Every input of the fusion becomes a finite number here, absent ones 0; the steps below rely on it.
    """
    for side, wanted in ((edge, EDGE_COLUMNS), (gateway, None)):
        if side is not None:
            new = [c for c in side.columns if c not in df.columns and (wanted is None or c in wanted)]
            df = join_rows(df, side.select("source_row_id", *new), "left")
    return df.withColumns({c: S.to_number(S.with_default(df, c, 0.0)) for c in EDGE_COLUMNS + GATEWAY_COLUMNS + FEATURE_COLUMNS})


def fusion_limits(df: DataFrame) -> dict:
    """Limits calibrated on normal rows, the spread of the source signals, presence of hybrid truth."""
    spread = lambda c: F.stddev_samp(S.with_default(df, c, None).cast("double"))
    limits = normal_quantiles(df, {
        "cross": ("cross_layer_anomaly_score", 0.95), "swarm": ("swarm_consensus_anomaly_score", 0.95),
        "jam": ("jam_threshold_score", 0.99), "dos": ("dos_threshold_score", 0.99),
        "sources": ("unique_source_count", 0.95), "entropy": ("src_ip_entropy", 0.90)},
        extra={"sources_sd": spread("unique_source_count"), "entropy_sd": spread("src_ip_entropy"),
               "hybrid_truth": F.bool_or(F.lower(S.with_default(df, "label", "")).contains("hybrid"))})
    limits["sources_vary"] = (limits["sources_sd"] or 0.0) > 1e-9
    limits["entropy_varies"] = (limits["entropy_sd"] or 0.0) > 1e-9
    limits["truth_has_hybrid"] = bool(limits["hybrid_truth"])
    return limits


def risk_scores(df: DataFrame, limits: dict) -> DataFrame:
    """Unrounded risks in ``_jam``, ``_dos``, ``_hybrid``, ``_fusion`` and their rounded columns."""
    col = F.col
    over = lambda c, k: S.as_double(col(c) > limits[k])
    cross = over("cross_layer_anomaly_score", "cross")
    unit = lambda c: S.bounded(col(c), 0, 1)
    out = df.withColumns({
        "_jam": S.bounded(S.weighted([
            (0.30, unit("jamming_conf_attack")), (0.20, col("edge_alarm")), (0.15, col("jamming_ae_flag")),
            (0.15, col("gru_jam_flag")), (0.10, over("jam_threshold_score", "jam")), (0.10, cross)]), 0, 1),
        "_dos": S.bounded(S.weighted([
            (0.30, unit("dos_conf_attack")), (0.20, col("traffic_outlier")), (0.15, col("dos_ae_flag")),
            (0.15, over("dos_threshold_score", "dos")), (0.10, over("swarm_consensus_anomaly_score", "swarm")),
            (0.10, col("coordinated_flood_flag"))]), 0, 1)})
    both = S.as_double((F.col("_jam") > 0.3) & (F.col("_dos") > 0.3))
    out = out.withColumn("_hybrid", S.bounded(S.weighted([
        (0.35, unit("hybrid_conf_attack")), (0.30, cross), (0.25, col("cross_layer_attack_flag")), (0.10, both)]), 0, 1))
    out = out.withColumn("_fusion", S.bounded(
        F.greatest("_jam", "_dos", "_hybrid") + 0.05 * col("edge_alarm"), 0, 1))
    return out.withColumns({"jam_risk_score": F.round("_jam", 4), "dos_risk_score": F.round("_dos", 4),
                            "hybrid_risk_score": F.round("_hybrid", 4), "fusion_confidence": F.round("_fusion", 4)})


def source_signals(limits: dict) -> tuple[Column, Column, Column]:
    """(many sources, high source entropy, flood is distributed)."""
    col = F.col
    many = (col("unique_source_count") > limits["sources"]) if limits["sources_vary"] else F.lit(False)
    high = (col("src_ip_entropy") > limits["entropy"]) if limits["entropy_varies"] else F.lit(False)
    if not (limits["sources_vary"] or limits["entropy_varies"]):
        return many, high, col("traffic_outlier") >= 0.5
    return many, high, many | high


def final_label(limits: dict) -> Column:
    """First matching rule; would-be hybrid rows go to the dominant side when truth knows no hybrid."""
    jam, dos, hybrid, fusion = F.col("_jam"), F.col("_dos"), F.col("_hybrid"), F.col("_fusion")
    col = F.col
    _, _, spread = source_signals(limits)
    evidence = (col("cross_layer_anomaly_score") > limits["cross"]) | (col("cross_layer_attack_flag") >= 0.5)
    gate = (hybrid >= HYBRID_GATE) & (jam >= SIDE_GATE) & (dos >= SIDE_GATE) & evidence
    flood = F.when(spread, F.lit("DDOS")).otherwise(F.lit("DOS"))
    mixed = F.lit("HYBRID_ATTACK") if limits["truth_has_hybrid"] else F.when(jam >= dos, F.lit("JAMMING")).otherwise(flood)
    return (F.when(gate, mixed)
            .when(jam >= JAM_STRONG, F.lit("JAMMING")).when(dos >= DOS_STRONG, flood)
            .when(jam >= JAM_MODERATE, F.lit("JAMMING")).when(dos >= DOS_MODERATE, flood)
            .when(fusion >= SUSPICIOUS, F.lit("SUSPICIOUS")).otherwise(F.lit("NORMAL")))


def severity(attack: Column, run: Column, fusion: Column) -> Column:
    return S.decision([(attack & (run >= 10), "HIGH"), (attack & (run >= 3), "MEDIUM"),
                       (attack & (fusion >= 0.50), "MEDIUM")], "LOW")


def _reasons(limits: dict) -> list[tuple[str, Column]]:
    col = F.col
    many, high, _ = source_signals(limits)
    return [
        ("EDGE_ALARM", col("edge_alarm") == 1),
        ("GRU_JAM_ANOMALY", col("gru_jam_flag") == 1),
        ("LSTM_AE_JAM_CONFIRMED", col("jamming_ae_flag") == 1),
        ("CNN_LSTM_JAM_DETECTED", col("jamming_conf_attack") > 0.5),
        ("CNN_LSTM_DOS_DETECTED", col("dos_conf_attack") > 0.5),
        ("CNN_LSTM_HYBRID_DETECTED", col("hybrid_conf_attack") > 0.5),
        ("LSTM_AE_DOS_CONFIRMED", col("dos_ae_flag") == 1),
        ("DBSCAN_TRAFFIC_OUTLIER", col("traffic_outlier") == 1),
        ("HIGH_JAM_THRESHOLD_SCORE", col("jam_threshold_score") > limits["jam"]),
        ("HIGH_DOS_THRESHOLD_SCORE", col("dos_threshold_score") > limits["dos"]),
        ("CROSS_LAYER_ATTACK", col("cross_layer_attack_flag") == 1),
        ("HIGH_CROSS_LAYER_SCORE", col("cross_layer_anomaly_score") > limits["cross"]),
        ("SWARM_CONSENSUS_ANOMALY", col("swarm_consensus_anomaly_score") > limits["swarm"]),
        ("COORDINATED_FLOOD", col("coordinated_flood_flag") == 1),
        ("HIGH_SRC_ENTROPY", high),
        ("HIGH_SOURCE_COUNT", many),
        ("NOISE_FLOOR_ELEVATED", col("noise_floor_drift_flag") == 1),
        ("PHYSICAL_IMPOSSIBILITY", (col("bit_error_rate") > 0.30) & (col("snr_db") < 0)),
    ]


def reason_codes(limits: dict) -> Column:
    return S.names_where(_reasons(limits))


#: Reasons in the order of their bits.
REASONS = ["EDGE_ALARM", "GRU_JAM_ANOMALY", "LSTM_AE_JAM_CONFIRMED", "CNN_LSTM_JAM_DETECTED", "CNN_LSTM_DOS_DETECTED",
           "CNN_LSTM_HYBRID_DETECTED", "LSTM_AE_DOS_CONFIRMED", "DBSCAN_TRAFFIC_OUTLIER", "HIGH_JAM_THRESHOLD_SCORE",
           "HIGH_DOS_THRESHOLD_SCORE", "CROSS_LAYER_ATTACK", "HIGH_CROSS_LAYER_SCORE", "SWARM_CONSENSUS_ANOMALY", "COORDINATED_FLOOD",
           "HIGH_SRC_ENTROPY", "HIGH_SOURCE_COUNT", "NOISE_FLOOR_ELEVATED", "PHYSICAL_IMPOSSIBILITY"]


def reason_bits(limits: dict) -> Column:
    """The reasons as bits of an int, so that they travel in four bytes; ``reason_names`` spells them out."""
    held = dict(_reasons(limits))
    return reduce(Column.bitwiseOR, [F.when(held[n], F.lit(1 << i)).otherwise(F.lit(0)) for i, n in enumerate(REASONS)])


def reason_names(bits: Column) -> Column:
    return S.names_where([(n, bits.bitwiseAND(F.lit(1 << i)) != 0) for i, n in enumerate(REASONS)])


def fuse(df: DataFrame, edge: DataFrame | None = None, gateway: DataFrame | None = None,
         limits: dict | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The detection table: features plus scores, label, severity, run length, reason codes and their ``reason_bits``."""
    base = attach_scores(df, edge, gateway)
    limits = limits or fusion_limits(base)
    scored = risk_scores(base, limits)
    labelled = scored.withColumns({"final_label": final_label(limits),
                                   "reason_bits": reason_bits(limits)})
    s = order_rows(labelled, ["ts", "source_row_id"], ["node_id"], rows_per_task=rows_per_task)
    attack = F.col("final_label") != "NORMAL"
    out = s.finish(run_length(s, s.rows, attack, "consecutive_attack_count"))
    return (out.withColumns({"severity": severity(attack, F.col("consecutive_attack_count"), F.col("_fusion")),
                             "detection_reason_codes": reason_names(F.col("reason_bits"))})
            .drop("_jam", "_dos", "_hybrid", "_fusion", "_pos"))
