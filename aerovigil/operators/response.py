"""Three-tier response: safety rules, reactive rules, radio and network actions, policy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerovigil import constants as K
from aerovigil.functions import scalars as S
from aerovigil.operators import series
from aerovigil.operators.ordered import ROWS_PER_TASK, order_rows
from aerovigil.operators.trust import clamped_trust
from aerovigil.session import durable


_RULE_COLUMNS = ["consecutive_attack_count", "edge_alarm", "snr_db", "packets_per_second", "syn_packet_rate", "half_open_connections",
                 "channel_occupancy_pct"]


def prepare(df: DataFrame) -> DataFrame:
    """Required columns checked, rows without time dropped, absent inputs set to their defaults."""
    S.require_columns(df, ["ts", "node_id", "final_label", "severity"])
    return df.where(F.col("ts").isNotNull()).withColumns(
        {c: S.to_number(S.with_default(df, c, d), d) for c, d in K.RESPONSE_DEFAULTS.items()})


def _is(*labels: str) -> Column:
    return F.col("final_label").isin(*labels)


def _high() -> Column:
    return F.col("severity") == "HIGH"


def safety_rules() -> tuple[Column, Column]:
    """(constraint, forced action), NONE where no constraint applies; the first match wins."""
    rules = [
        (_is("DOS", "DDOS", "HYBRID_ATTACK") & _high(), "CRITICAL_TRAFFIC_PROTECTION", "SHED_NON_CRITICAL_LOAD"),
        (_is("JAMMING") & _high() & (F.col("consecutive_attack_count") >= 10), "ANTI_FRAGMENTATION", "SWITCH_TO_LTE_FALLBACK"),
        (_is("DOS", "DDOS") & F.col("severity").isin("MEDIUM", "HIGH"), "RATE_LIMIT_ENFORCEMENT", "FLAG_AND_RATE_LIMIT"),
    ]
    return (S.decision([(c, name) for c, name, _ in rules], "NONE"),
            S.decision([(c, action) for c, _, action in rules], "NONE"))


def safety_details() -> Column:
    """Parameters that go with the constraint."""
    constraint = safety_rules()[0]
    critical = constraint == "CRITICAL_TRAFFIC_PROTECTION"
    return F.struct(
        F.when(critical, F.lit(20.0)).alias("min_bandwidth_reserved_pct"), critical.alias("priority_traffic_flag"),
        (constraint == "ANTI_FRAGMENTATION").alias("lte_activated"),
        F.when(constraint == "RATE_LIMIT_ENFORCEMENT", F.lit(1000)).alias("rate_limit_pps"))


def _weak_signal() -> Column:
    return (_is("JAMMING") | (F.col("edge_alarm") == 1)) & (F.col("snr_db") < 0)


def _flooded() -> Column:
    return F.col("packets_per_second") > 50000


def reactive_rules() -> Column:
    """Immediate actions; the rules are independent."""
    return S.names_where([
        ("EMERGENCY_CHANNEL_SWITCH", _weak_signal()),
        ("ACTIVATE_SYN_COOKIE_IMMEDIATE", (F.col("syn_packet_rate") > 5000) | (F.col("half_open_connections") > 2000)),
        ("EMERGENCY_LOAD_SHED", _flooded()),
        ("TRIGGER_FREQUENCY_HOP", (F.col("channel_occupancy_pct") > 80) & _is("JAMMING", "HYBRID_ATTACK")),
    ])


def trust_steps() -> dict[str, tuple[Column, Column]]:
    """Per channel: the reactive step and the step of the radio or network tier."""
    def by_severity(high: float, other: float) -> Column:
        return F.when(_high(), F.lit(-high)).otherwise(F.lit(-other))

    radio = (F.when(_is("JAMMING", "HYBRID_ATTACK"), by_severity(0.40, 0.25))
             .when(_is("SUSPICIOUS"), F.lit(-0.05)).when(_is("DOS", "DDOS", "NORMAL"), F.lit(0.01)).otherwise(F.lit(0.01)))
    network = (F.when(_is("DDOS"), by_severity(0.40, 0.25)).when(_is("DOS"), by_severity(0.35, 0.20))
               .when(_is("HYBRID_ATTACK"), by_severity(0.45, 0.30)).when(_is("SUSPICIOUS"), F.lit(-0.10))
               .otherwise(F.lit(0.005)))
    return {"signal": (F.when(_weak_signal(), F.lit(-0.30)).otherwise(F.lit(0.0)), radio),
            "network": (F.when(_flooded(), F.lit(-0.20)).otherwise(F.lit(0.0)), network)}


def last_safe_state(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(source_row_id, safe): signal, channel and time of the node's latest row so far that the radio tier left alone.

    Those are all rows but jamming, hybrid and suspicious ones; rows under a traffic attack count as safe.
    """
    alone = ~_is("JAMMING", "HYBRID_ATTACK", "SUSPICIOUS")
    narrow = df.select("source_row_id", "node_id", "ts", "final_label", F.coalesce(S.with_default(df, "snr_db", None).cast("double"), F.lit(0.0)).alias("snr_db"),
                       F.coalesce(S.with_default(df, "rssi_dbm", None).cast("double"), F.lit(-70.0)).alias("rssi_dbm"), F.lit("PRIMARY").alias("channel"))
    s = order_rows(narrow, ["ts", "source_row_id"], ["node_id"], rows_per_task=rows_per_task)
    fields = ["snr_db", "rssi_dbm", "channel", "ts"]
    return s.finish(series.last_where(s, s.rows, alone, fields, "safe")).select("source_row_id", "safe")


def radio_actions() -> dict[str, Column]:
    attack, watch = _is("JAMMING", "HYBRID_ATTACK"), _is("SUSPICIOUS")
    hard, soft = attack & _high(), attack & ~_high()
    return {
        "rf_action_taken": S.decision([(hard, "ACTIVATE_ANTI_JAMMING_HOP"), (soft, "SWITCH_TO_BACKUP_CHANNEL"),
                                       (watch, "INCREASE_RF_MONITORING")], "NO_RF_CHANGE"),
        "rf_channel_mode": S.decision([(hard, "FREQUENCY_HOPPING"), (soft, "CHANNEL_SWITCH_MONITOR"),
                                       (watch, "HEIGHTENED_MONITORING")], "NORMAL_OPERATION"),
        "fallback_channel": S.decision([(hard, "BACKUP_5GHz"), (soft, "BACKUP_2.4GHz")], None),
        "lte_fallback_active": hard & (F.col("consecutive_attack_count") >= 10),
        "_rf_neighbors": attack, "_rf_edge": attack | watch, "_rf_gcc": hard,
    }


def network_actions() -> dict[str, Column]:
    """Needs ``policy_action``, the policy's recommendation for the row."""
    ddos, dos, mixed, watch = _is("DDOS"), _is("DOS"), _is("HYBRID_ATTACK"), _is("SUSPICIOUS")
    advice = F.col("policy_action")
    return {
        "net_action_taken": S.decision([(ddos, "DDOS_MITIGATION_ACTIVE"), (dos, "DOS_BLOCK_AND_RATE_LIMIT"),
                                        (mixed, "HYBRID_CONTAIN_AND_REROUTE"), (watch, "MONITOR_NETWORK_PATH")],
                                       "NO_NETWORK_CHANGE"),
        "_net_selected": (F.when(ddos, F.lit("SHED_NON_CRITICAL_LOAD")).when(dos, F.lit("BLOCK_SUSPICIOUS_SOURCES"))
                          .when(mixed, F.lit("REROUTE_THROUGH_BACKUP_RELAY"))
                          .when(watch & (advice == "CONTINUE_NORMAL_OPERATION"), F.lit("FLAG_AND_RATE_LIMIT"))
                          .otherwise(advice)),
        "alert_delivery_mode": S.decision([(ddos | mixed, "BACKUP_MULTI_HOP"), (dos, "PRIMARY_PLUS_BROADCAST")],
                                          "PRIMARY_ROUTE"),
        "_net_neighbors": ddos | dos | mixed, "_net_edge": ddos | dos | mixed | watch,
        "_net_gcc": ddos | mixed | (dos & _high()),
    }


def reward(action: Column) -> Column:
    """Reward of taking ``action`` on the row."""
    label = F.col("final_label")
    wanted = F.coalesce(F.array_contains(F.element_at(_desired(), label), action), F.lit(False))
    attack = label.isin(K.ATTACK_FINAL_LABELS)
    urgent = attack & _high()
    base = F.when(wanted, F.lit(1.0)).otherwise(F.lit(-1.5))
    false_alarm = F.when((label == "NORMAL") & action.isin(K.DISRUPTIVE_ACTIONS), F.lit(-1.5)).otherwise(F.lit(0.0))
    bonus = (F.when(urgent & wanted, F.lit(2.0)).when(urgent & action.isin(K.PASSIVE_ACTIONS), F.lit(-2.0))
             .otherwise(F.lit(0.0)))
    both = F.when((label == "HYBRID_ATTACK") & wanted, F.lit(1.0)).otherwise(F.lit(0.0))
    strain = (F.least(F.col("channel_occupancy_pct") / 100.0, F.lit(1.0))
              + F.least(F.col("error_response_rate"), F.lit(1.0)))
    return S.bounded(base + false_alarm + bonus + both + F.col("fusion_confidence") - strain, -5, 5)


def _desired() -> Column:
    pairs = []
    for label, actions in K.DESIRED_ACTIONS.items():
        pairs += [F.lit(label), F.array(*[F.lit(a) for a in actions])]
    return F.create_map(*pairs)


def action_rewards(df: DataFrame) -> DataFrame:
    """One row per (row, action) with its reward; twelve actions, generated in place."""
    actions = F.array(*[F.struct(F.lit(i).alias("action_index"), F.lit(a).alias("action")) for i, a in enumerate(K.ACTIONS)])
    spread = df.select("*", F.explode(actions).alias("_a")).select("*", "_a.*").drop("_a")
    return spread.withColumn("reward", reward(F.col("action")))


def action_values(df: DataFrame) -> DataFrame:
    """Mean reward per (label, severity, action): at most 6 x 3 x 12 rows. Rows are not multiplied by the actions."""
    sums = df.groupBy("final_label", "severity").agg(F.count("*").alias("rows"), *[
        F.avg(reward(F.lit(a))).alias(f"_v{i}") for i, a in enumerate(K.ACTIONS)])
    entries = F.array(*[F.struct(F.lit(i).alias("action_index"), F.lit(a).alias("action"), F.col(f"_v{i}").alias("value"))
                        for i, a in enumerate(K.ACTIONS)])
    return sums.select("final_label", "severity", "rows", F.inline(entries)).select(
        "final_label", "severity", "action_index", "action", "value", "rows")


def greedy_policy(values: DataFrame) -> DataFrame:
    """(final_label, severity, policy_action): the best action, the earlier one on a tie."""
    best = F.max(F.struct(F.round("value", 9).alias("v"), (-F.col("action_index")).alias("i"), F.col("action").alias("a")))
    return (values.groupBy("final_label", "severity").agg(best.alias("b"))
            .select("final_label", "severity", F.col("b.a").alias("policy_action")))


def discounted_values(df: DataFrame, gamma: float = 0.95, sweeps: int = 300,
                      rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Action values including discounted later rewards along each node's observed label sequence.

    Transitions between (label, severity) states do not depend on the action, so the state table has
    at most 18 rows; it is solved on the driver, the counting is distributed.
    """
    spark = df.sparkSession
    s = order_rows(df.select("node_id", "ts", "source_row_id", "final_label", "severity"),
                   ["ts", "source_row_id"], ["node_id"], halo=1, rows_per_task=rows_per_task)
    state = F.concat_ws("|", "final_label", "severity")
    steps = s.rows.withColumn("_from", F.lag(state, 1).over(s.window())).withColumn("_to", state)
    moves = (s.finish(steps).where(F.col("_from").isNotNull()).groupBy("_from", "_to").agg(F.count("*").alias("n"))).collect()
    values = action_values(df).collect()
    states = sorted({f"{r['final_label']}|{r['severity']}" for r in values})
    index = {n: i for i, n in enumerate(states)}
    chance = np.zeros((len(states), len(states)))
    for r in moves:
        chance[index[r["_from"]], index[r["_to"]]] += r["n"]
    chance /= np.maximum(chance.sum(axis=1, keepdims=True), 1)
    now = np.full((len(states), len(K.ACTIONS)), -np.inf)
    for r in values:
        now[index[f"{r['final_label']}|{r['severity']}"], r["action_index"]] = r["value"]
    worth = np.zeros(len(states))
    for _ in range(sweeps):
        worth = (now + gamma * (chance @ worth)[:, None]).max(axis=1)
    total = now + gamma * (chance @ worth)[:, None]
    rows = [(*n.split("|"), a, K.ACTIONS[a], float(total[i, a])) for n, i in index.items() for a in range(len(K.ACTIONS))]
    return spark.createDataFrame(rows, "final_label string, severity string, action_index int, action string, value double")


def decide(df: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """The row's own decisions beside its columns: all of the response but the running trust, which no rule reads.

    Without ``policy`` the selected network action stays out, the one decision that takes its advice.
    """
    constraint, forced = safety_rules()
    network = network_actions()
    if policy is None:
        network.pop("_net_selected")
    else:
        # The policy has one row per (label, severity): at most 18.
        df = df.join(F.broadcast(policy), ["final_label", "severity"], "left").fillna({"policy_action": "CONTINUE_NORMAL_OPERATION"})
    acted = df.withColumns({
        "safety_constraint": constraint, "safety_forced_action": forced, "safety_details": safety_details(),
        "reactive_actions": reactive_rules(), **radio_actions(), **network})
    override = F.col("safety_constraint") != "NONE"
    selected = {} if policy is None else {
        "net_selected_action": F.when(override, F.col("safety_forced_action")).otherwise(F.col("_net_selected"))}
    return acted.withColumns({
        "safety_override": override, "reactive_triggered": F.size("reactive_actions") > 0, **selected,
        "notify_neighbors": F.col("_rf_neighbors") | F.col("_net_neighbors"),
        "notify_edge": F.col("_rf_edge") | F.col("_net_edge"),
        "notify_gcc": F.col("_rf_gcc") | F.col("_net_gcc") | override,
        "response_status": F.lit("EXECUTED"), "response_success": F.lit(True)}).drop(
        "_rf_neighbors", "_rf_edge", "_rf_gcc", "_net_neighbors", "_net_edge", "_net_gcc", "_net_selected")


def running_trust(prepared: DataFrame, carry: list[str] | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Trust of both channels around each row, beside the row id and the columns ``carry``; all others are left behind before the exchange."""
    return clamped_trust(prepared, trust_steps(), rows_per_task=rows_per_task, carry=carry)


def respond(detection: DataFrame, policy: DataFrame | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The response table, one row per detection row.

    ``detection`` is read once, so it may be a plan: rows are written with their trust, and the policy is learned from there.
    """
    df = prepare(detection)
    df = df.withColumn("node_type", S.with_default(df, "node_type", "uav"))
    # What the rules and the reward read passes through the trust step.
    read = _RULE_COLUMNS if policy is not None else [*_RULE_COLUMNS, "error_response_rate"]
    carry = list(dict.fromkeys(["ts", "node_id", "node_type", "final_label", "severity", "fusion_confidence", *read]))
    rows = running_trust(df, carry, rows_per_task)
    if policy is None:
        rows = durable(rows)
        policy = greedy_policy(action_values(rows))
    return decide(rows, policy).select(
        "source_row_id", "ts", "node_id", "node_type", "final_label", "severity", "fusion_confidence",
        F.col("signal_before").alias("trust_before_signal"), F.col("network_before").alias("trust_before_network"),
        "safety_override", "safety_constraint", "safety_forced_action", "safety_details", "reactive_triggered",
        "reactive_actions", "rf_action_taken", "rf_channel_mode", "fallback_channel",
        F.col("signal_middle").alias("signal_trust_before"), F.col("signal_after").alias("signal_trust_after"),
        "lte_fallback_active", "net_action_taken", "net_selected_action", "policy_action", "alert_delivery_mode",
        F.col("network_middle").alias("network_trust_before"), F.col("network_after").alias("network_trust_after"),
        "notify_neighbors", "notify_edge", "notify_gcc", "response_status", "response_success")


#: Columns of a prepared row that its state reads beside trust.
STATE_COLUMNS = ["jam_risk_score", "dos_risk_score", "hybrid_risk_score", "fusion_confidence", "edge_alarm", "cross_layer_anomaly_score", "snr_db",
                 "channel_occupancy_pct", "packet_delivery_ratio", "half_open_connections", "src_ip_entropy", "error_response_rate",
                 "consecutive_attack_count"]


def state_vector(df: DataFrame, signal_trust: str = "signal_trust_after", network_trust: str = "network_trust_before") -> Column:
    """Fifteen values in [0, 1]; radio trust after, network trust before the row's third tier."""
    col = F.col
    raw = [col("jam_risk_score"), col("dos_risk_score"), col("hybrid_risk_score"), col("fusion_confidence"),
           col("edge_alarm"), col("cross_layer_anomaly_score"), (col("snr_db") + 30.0) / 60.0,
           col("channel_occupancy_pct") / 100.0, col("packet_delivery_ratio"), col("half_open_connections") / 20000.0,
           col("src_ip_entropy") / 9.0, col("error_response_rate"), col("consecutive_attack_count") / 20.0,
           col(signal_trust), col(network_trust)]
    return F.array(*[F.greatest(F.least(c.cast("double"), F.lit(1.0)), F.lit(0.0)) for c in raw])


def response_rates(df: DataFrame) -> DataFrame:
    """Overall tier rates, trust means and coverage of high-severity attacks."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    urgent = (F.col("severity") == "HIGH") & (F.col("final_label") != "NORMAL")
    return df.agg(rate("safety_override").alias("safety_override_rate"), rate("reactive_triggered").alias("reactive_trigger_rate"),
                  rate("notify_gcc").alias("gcc_notification_rate"), rate("lte_fallback_active").alias("lte_fallback_rate"),
                  F.avg("signal_trust_after").alias("signal_trust_mean"), F.avg("network_trust_after").alias("network_trust_mean"),
                  F.avg(F.when(urgent, F.col("notify_gcc").cast("double"))).alias("high_attack_gcc_coverage"))


def response_distribution(df: DataFrame) -> DataFrame:
    """(dimension, group, item, n, share, trust statistics) for the tables of the evaluation report."""
    def counts(dimension: str, group: str, item: str) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), F.col(group).alias("group"),
                        F.col(item).cast("string").alias("item"))

    entries = F.array(counts("rf_action", "final_label", "rf_action_taken"),
                      counts("network_action", "final_label", "net_selected_action"),
                      counts("gcc_by_severity", "severity", "notify_gcc"),
                      F.struct(F.lit("safety_constraint").alias("dimension"), F.lit("all").alias("group"),
                               F.col("safety_constraint").alias("item")))
    return (df.select(F.explode(entries).alias("e")).groupBy("e.dimension", "e.group", "e.item")
            .agg(F.count("*").alias("n")))


def trust_by_label(df: DataFrame) -> DataFrame:
    return df.groupBy("final_label").agg(*[f(f"{c}_trust_after").alias(f"{c}_{n}") for c in ("signal", "network")
                                           for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])
