"""Swarm coordination: trust evidence, coordinated attacks, actions and node status."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerovigil import constants as K
from aerovigil.functions import scalars as S
from aerovigil.functions.joins import join_rows
from aerovigil.operators.ordered import ROWS_PER_TASK, add_positions, order_rows
from aerovigil.operators.trust import beta_trust
from aerovigil.session import durable

# Priors of the two hypotheses.
PRIOR_ISOLATED, PRIOR_COORDINATED = 0.30, 0.20
RECENT_ROWS = 10
GLOBAL_ORDER = ["ts", "node_id", "source_row_id"]
ROWS_PER_GLOBAL_TASK = 250_000
#: Columns of the coordination table that come from detection and response, those that are read beside them, and those that are added.
_KEPT = ["source_row_id", "ts", "node_id", "node_type", "final_label", "severity", "fusion_confidence", "detection_reason_codes",
         "rf_action_taken", "net_action_taken", "safety_override", "reactive_triggered", "notify_neighbors", "notify_edge", "notify_gcc",
         "jam_risk_score", "dos_risk_score", "cross_layer_anomaly_score", "swarm_consensus_anomaly_score"]
_READ = ["hybrid_risk_score", "consecutive_attack_count"]
_JUDGED = ["final_label", "trust_after", "fusion_confidence", "jam_risk_score", "dos_risk_score", "swarm_consensus_anomaly_score",
           "cross_layer_anomaly_score", "notify_gcc"]   #: Read by ``act``.
_RECENT = ["coordinated_nodes", "coordinated_node_count", "multi_node_factor", "coordinated_attack_detected"]
_ADDED = ["trust_before", "trust_after", "positive_evidence", "negative_evidence", "evidence_score", "coordination_status",
          "bayes_p_isolated", "bayes_p_coordinated", "coordinated_attack_detected", "coordinated_node_count", "coordinated_nodes",
          "coordination_action", "quarantine_decision", "rerouting_decision", "gcc_notified", "alert_scope"]


def combine(detection: DataFrame, response: DataFrame) -> DataFrame:
    """Detection rows with the response columns they lack, joined on the row id."""
    clash = [c for c in response.columns if c in detection.columns
             and c not in ("source_row_id", "ts", "node_id", "final_label", "severity", "node_type", "fusion_confidence")]
    side = response.select("source_row_id", *[c for c in response.columns if c not in detection.columns],
                           *[F.col(c).alias(f"{c}_resp") for c in clash])
    return join_rows(detection, side, "left")


def _num(df: DataFrame, name: str) -> Column:
    return F.coalesce(S.with_default(df, name, 0.0).cast("double"), F.lit(0.0))


def _yes(df: DataFrame, name: str) -> Column:
    return F.coalesce(S.with_default(df, name, False).cast("boolean"), F.lit(False))


def evidence(df: DataFrame) -> DataFrame:
    """``positive_evidence``, ``negative_evidence`` and the clipped ``evidence_score`` per row."""
    n = lambda c: _num(df, c)
    score = S.weighted([
        (0.22, n("jam_risk_score")), (0.22, n("dos_risk_score")), (0.12, n("hybrid_risk_score")),
        (0.15, n("fusion_confidence")), (0.10, n("cross_layer_anomaly_score")),
        (0.10, n("swarm_consensus_anomaly_score")),
        (0.09, F.least(n("consecutive_attack_count"), F.lit(20.0)) / 20.0)])
    label = F.col("final_label")
    rf, net = S.with_default(df, "rf_action_taken", ""), S.with_default(df, "net_action_taken", "")
    extra_bad = S.total([
        S.decision([(label.isin("JAMMING", "DOS"), 0.75), (label == "DDOS", 0.85), (label == "HYBRID_ATTACK", 1.0),
                    (label == "SUSPICIOUS", 0.30)], 0.0),
        0.20 * S.flag(rf.isin("ACTIVATE_ANTI_JAMMING_HOP", "SWITCH_TO_LTE_FALLBACK")),
        0.20 * S.flag(net.isin("DDOS_MITIGATION_ACTIVE", "HYBRID_CONTAIN_AND_REROUTE")),
        0.15 * S.flag(_yes(df, "safety_override")), 0.10 * S.flag(_yes(df, "notify_gcc"))])
    quiet = (rf == "NO_RF_CHANGE") & (net == "NO_NETWORK_CHANGE") & (label == "NORMAL")
    extra_good = S.decision([(label.isin(K.ATTACK_FINAL_LABELS), 0.0), (label == "SUSPICIOUS", 0.10)], 0.75) \
        + 0.20 * S.flag(quiet)
    return df.withColumn("_score", score).withColumns({
        "positive_evidence": F.greatest(1.0 - F.col("_score"), F.lit(0.0)) + extra_good,
        "negative_evidence": F.col("_score") + extra_bad,
        "evidence_score": S.bounded(F.col("_score"), 0, 1)}).drop("_score")


def recent_nodes(df: DataFrame, min_nodes: int = 3, min_confidence: float = 0.50,
                 rows_per_task: int = ROWS_PER_GLOBAL_TASK) -> DataFrame:
    """Over the last ten rows of the whole table: attacking nodes, their number, suspicious share; by source_row_id."""
    narrow = df.select(*GLOBAL_ORDER, "final_label", _num(df, "fusion_confidence").alias("fusion_confidence"))
    return in_global_order(narrow, min_nodes, min_confidence, rows_per_task).select("source_row_id", *_RECENT)


def in_global_order(df: DataFrame, min_nodes: int = 3, min_confidence: float = 0.50, rows_per_task: int = ROWS_PER_GLOBAL_TASK) -> DataFrame:
    """Rows with their position in the table and what its last ten rows show, in one exchange; written once.

    A sorted range is folded as it is written. Its first nine rows also look into the ranges before it: they are completed from the first and
    last nine rows of all ranges.
    """
    rows = df.count()
    marks = {"_sure": F.coalesce(F.col("final_label").isin(K.ATTACK_FINAL_LABELS) & (_num(df, "fusion_confidence") >= min_confidence), F.lit(False)),
             "_odd": F.coalesce(F.col("final_label") != "NORMAL", F.lit(False))}
    nodes = T.ArrayType(df.schema["node_id"].dataType)
    schema = T.StructType([*df.schema.fields, T.StructField("_nodes", nodes), T.StructField("_suspects", T.IntegerType())])
    names = schema.names[:-2]
    placed = add_positions(df, GLOBAL_ORDER, rows_per_partition=rows_per_task, rows=rows,
                           fold=lambda ranged: ranged.withColumns(marks).mapInArrow(_last_nodes(names), schema))
    if rows > rows_per_task:
        near = placed.where((F.col("_before") < RECENT_ROWS - 1) | (F.col("_behind") < RECENT_ROWS - 1)).withColumns(marks)
        # At most 18 rows per range.
        frame = Window.partitionBy(F.lit(0)).orderBy("_pos").rangeBetween(1 - RECENT_ROWS, 0)
        first = near.select("_pos", "_before", *[F.collect_set(F.when(F.col(m), F.col("node_id"))).over(frame).alias(m) for m in marks])
        whole = durable(first.where(F.col("_before") < RECENT_ROWS - 1).select(
            "_pos", F.array_sort("_sure").alias("_whole"), F.size("_odd").alias("_all")))
        placed = placed.join(F.broadcast(whole), "_pos", "left").withColumns(
            {"_nodes": F.coalesce("_whole", "_nodes"), "_suspects": F.coalesce("_all", "_suspects")})
    return placed.select(*names, "_pos", F.col("_nodes").alias("coordinated_nodes"), F.size("_nodes").alias("coordinated_node_count"),
                         F.least(F.col("_suspects") / 5.0, F.lit(1.0)).alias("multi_node_factor"),
                         (F.size("_nodes") >= min_nodes).alias("coordinated_attack_detected"))


def _last_nodes(names: list[str]):
    """Fold of sorted rows: nodes of the ``_sure`` rows among the last ten, sorted, and the number of nodes of the ``_odd`` ones."""
    def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        frames = np.sort(np.lib.stride_tricks.sliding_window_view(codes, RECENT_ROWS), axis=1)
        new = frames >= 0
        new[:, 1:] &= frames[:, 1:] != frames[:, :-1]
        return frames, new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None   # node and marks of the nine rows before
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.table({c: batch.column(c) for c in ("node_id", "_sure", "_odd")})
            seen = now if held is None else pa.concat_tables([held, now])
            held = seen.slice(max(0, seen.num_rows - RECENT_ROWS + 1))
            coded = seen["node_id"].combine_chunks().dictionary_encode()
            by_name = pc.sort_indices(coded.dictionary)
            rank = np.empty(len(by_name) + 1, dtype=np.int64)
            rank[by_name.to_numpy()], rank[-1] = np.arange(len(by_name)), -1   # the last place stands for null
            codes = rank[pc.fill_null(coded.indices, len(by_name)).to_numpy()]
            pad = np.full(batch.num_rows + RECENT_ROWS - 1 - len(codes), -1)
            sure, odd = (np.concatenate([pad, np.where(seen[m].to_numpy(), codes, -1)]) for m in ("_sure", "_odd"))
            frames, new = distinct(sure)
            ends = np.concatenate([[0], np.cumsum(new.sum(axis=1))]).astype(np.int32)
            nodes = pa.ListArray.from_arrays(pa.array(ends), coded.dictionary.take(by_name).take(pa.array(frames[new])))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], nodes, pa.array(distinct(odd)[1].sum(axis=1), pa.int32())],
                                             names=[*names, "_nodes", "_suspects"])

    return run


def hypotheses(df: DataFrame) -> DataFrame:
    """Posterior of an isolated fault and of a coordinated attack."""
    n = lambda c: _num(df, c)
    risk, many = F.greatest(n("jam_risk_score"), n("dos_risk_score")), n("multi_node_factor")
    swarm, cross = n("swarm_consensus_anomaly_score"), n("cross_layer_anomaly_score")
    told, fusion = S.as_double(_yes(df, "notify_gcc")), n("fusion_confidence")
    together = S.bounded(S.weighted([(0.25, fusion), (0.20, risk), (0.20, swarm), (0.20, many), (0.10, cross), (0.05, told)]),
                      0.001, 0.999)
    alone = S.bounded(S.weighted([(0.30, fusion), (0.25, risk), (0.20, 1.0 - many), (0.10, 1.0 - swarm), (0.10, told),
                               (0.05, cross)]), 0.001, 0.999)
    a, b = PRIOR_ISOLATED * alone, PRIOR_COORDINATED * together
    return df.withColumns({"bayes_p_isolated": a / (b + a + S.EPS), "bayes_p_coordinated": b / (b + a + S.EPS)})


def node_status() -> Column:
    trust, attack = F.col("trust_after"), F.col("final_label").isin(K.ATTACK_FINAL_LABELS)
    return S.decision([(trust < 0.35, "ISOLATED"), (attack | (trust < 0.60), "RESTRICTED"),
                       (trust < 0.80, "MONITORED")], "TRUSTED")


def swarm_action() -> Column:
    label, trust = F.col("final_label"), F.col("trust_after")
    attack, together = label.isin(K.ATTACK_FINAL_LABELS), F.col("coordinated_attack_detected")
    likely = attack & (F.col("bayes_p_coordinated") >= 0.65)
    return S.decision([
        (together & label.isin("HYBRID_ATTACK", "DDOS"), "GLOBAL_CONTAINMENT_AND_REROUTE"),
        (likely & (label == "JAMMING"), "ACTIVATE_SWARM_WIDE_CHANNEL_HOP"),
        (likely & label.isin("DDOS", "HYBRID_ATTACK"), "SWARM_WIDE_RATE_LIMIT_AND_ISOLATE"),
        (likely, "GLOBAL_CONTAINMENT_AND_REROUTE"),
        (trust < 0.35, "ISOLATE_NODE_AND_BROADCAST"),
        (together & attack, "RESTRICT_SWARM_AND_NOTIFY_GCC"),
        (attack, "RESTRICT_ROLE_AND_NOTIFY_NEIGHBORS"),
        (trust < 0.60, "MONITOR_AND_LIMIT_ROUTING"),
    ], "NO_GLOBAL_CHANGE")


def node_trust(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Detection rows with their response columns, and with evidence, Beta trust and status, in one exchange by node."""
    s = order_rows(evidence(df), ["ts", "source_row_id"], ["node_id"], rows_per_task=rows_per_task)
    return s.finish(beta_trust(s, s.rows, "positive_evidence", "negative_evidence")).drop("_pos").withColumn("coordination_status", node_status())


def coordinate(detection: DataFrame, response: DataFrame | None, min_nodes: int = 3, min_confidence: float = 0.50,
               rows_per_task: int = ROWS_PER_TASK, rows_per_global_task: int = ROWS_PER_GLOBAL_TASK, keep: list[str] | None = None) -> DataFrame:
    """The coordination table, one row per detection row that has a time. Without ``response`` its columns are in ``detection``.

    With ``keep`` only these columns are returned, and others that nothing reads are left behind before the global order.
    """
    merged = detection if response is None else combine(detection, response)
    # Rows pass through the order within their node and the order of the table as they are; only the latter is written.
    there = merged.where(F.col("ts").isNotNull()).select(*[c for c in [*_KEPT, *_READ] if c in merged.columns])
    wanted = [c for c in [*_KEPT, *_ADDED] if keep is None or c in keep]
    trusted = node_trust(there, rows_per_task).drop("coordination_status")
    carried = trusted.select(*[c for c in trusted.columns if c in {*wanted, *GLOBAL_ORDER, *_JUDGED}])
    out = act(in_global_order(carried, min_nodes, min_confidence, rows_per_global_task))
    return out.select(*[c for c in wanted if c in out.columns])


def act(df: DataFrame) -> DataFrame:
    """Rows of ``in_global_order`` with status, hypotheses, the action of the swarm and what follows from it; needs trust and decisions."""
    acted = hypotheses(df).withColumn("coordination_status", node_status()).withColumn("coordination_action", swarm_action())
    action = F.col("coordination_action")
    told = F.coalesce(F.col("notify_gcc"), F.lit(False)) | action.isin(
        "GLOBAL_CONTAINMENT_AND_REROUTE", "RESTRICT_SWARM_AND_NOTIFY_GCC", "ACTIVATE_SWARM_WIDE_CHANNEL_HOP",
        "SWARM_WIDE_RATE_LIMIT_AND_ISOLATE")
    return acted.withColumns({
        "quarantine_decision": F.col("coordination_status") == "ISOLATED",
        "rerouting_decision": action.isin("GLOBAL_CONTAINMENT_AND_REROUTE", "RESTRICT_SWARM_AND_NOTIFY_GCC",
                                          "MONITOR_AND_LIMIT_ROUTING", "SWARM_WIDE_RATE_LIMIT_AND_ISOLATE"),
        "gcc_notified": told,
        "alert_scope": F.when(told, F.lit("gcc")).when(F.col("coordinated_attack_detected"), F.lit("edge"))
        .otherwise(F.lit("local"))})
