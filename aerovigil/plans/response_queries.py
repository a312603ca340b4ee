"""Queries for the response tiers, trust, policy and response evaluation."""

from pyspark.sql import functions as F

from aerovigil import constants as K
from aerovigil.operators import response as R
from aerovigil.plans.detection_queries import DETECTION_CTE, detection
from aerovigil.plans.registry import query
from aerovigil.session import durable

_WEAK = "((final_label = 'JAMMING' or edge_alarm = 1) and snr_db < 0)"
_MIX = "final_label in ('JAMMING', 'HYBRID_ATTACK')"
_SIG = f"case when {_MIX} then case when severity = 'HIGH' then -0.40 else -0.25 end when final_label = 'SUSPICIOUS' then -0.05 else 0.01 end"
_NET = """case final_label when 'DDOS' then case when severity = 'HIGH' then -0.40 else -0.25 end when 'DOS' then case when severity = 'HIGH' then -0.35 else -0.20 end
    when 'HYBRID_ATTACK' then case when severity = 'HIGH' then -0.45 else -0.30 end when 'SUSPICIOUS' then -0.10 else 0.005 end"""
_CONSTRAINT = """case when final_label in ('DOS', 'DDOS', 'HYBRID_ATTACK') and severity = 'HIGH' then 'CRITICAL_TRAFFIC_PROTECTION'
    when final_label = 'JAMMING' and severity = 'HIGH' and consecutive_attack_count >= 10 then 'ANTI_FRAGMENTATION'
    when final_label in ('DOS', 'DDOS') and severity in ('MEDIUM', 'HIGH') then 'RATE_LIMIT_ENFORCEMENT' else 'NONE' end"""
_FORCED = "case safety_constraint when 'CRITICAL_TRAFFIC_PROTECTION' then 'SHED_NON_CRITICAL_LOAD' when 'ANTI_FRAGMENTATION' then 'SWITCH_TO_LTE_FALLBACK' when 'RATE_LIMIT_ENFORCEMENT' then 'FLAG_AND_RATE_LIMIT' else 'NONE' end"
_POLICY = """case final_label when 'NORMAL' then 'CONTINUE_NORMAL_OPERATION' when 'SUSPICIOUS' then 'INCREASE_MONITORING' when 'JAMMING' then 'SWITCH_TO_BACKUP_CHANNEL'
    when 'DOS' then 'FLAG_AND_RATE_LIMIT' when 'DDOS' then 'BLOCK_SUSPICIOUS_SOURCES' else 'SWITCH_TO_BACKUP_CHANNEL' end"""


def _step(x, d):
    return f"least(1::double, greatest(0::double, {x} + {d}))"


RESPONSE_CTE = DETECTION_CTE.replace("with t as", "with recursive t as", 1) + f""",
    st as materialized (select *, row_number() over (partition by node_id order by ts, source_row_id) as rn,
        case when {_WEAK} then -0.30 else 0 end::double as s0, ({_SIG})::double as s1,
        case when packets_per_second > 50000 then -0.20 else 0 end::double as n0, ({_NET})::double as n1 from det),
    tr as (select source_row_id, node_id, rn, 1::double as sb, {_step('1', 's0')} as sm, {_step(_step('1', 's0'), 's1')} as sa,
            1::double as nb, {_step('1', 'n0')} as nm, {_step(_step('1', 'n0'), 'n1')} as na from st where rn = 1
        union all select st.source_row_id, st.node_id, st.rn, tr.sa, {_step('tr.sa', 'st.s0')}, {_step(_step('tr.sa', 'st.s0'), 'st.s1')},
            tr.na, {_step('tr.na', 'st.n0')}, {_step(_step('tr.na', 'st.n0'), 'st.n1')} from tr join st on st.node_id = tr.node_id and st.rn = tr.rn + 1),
    rs0 as (select det.*, tr.sb, tr.sm, tr.sa, tr.nb, tr.nm, tr.na, {_CONSTRAINT} as safety_constraint, {_POLICY} as policy_action,
        concat_ws(',', case when {_WEAK} then 'EMERGENCY_CHANNEL_SWITCH' end, case when syn_packet_rate > 5000 or half_open_connections > 2000 then 'ACTIVATE_SYN_COOKIE_IMMEDIATE' end,
            case when packets_per_second > 50000 then 'EMERGENCY_LOAD_SHED' end, case when channel_occupancy_pct > 80 and {_MIX} then 'TRIGGER_FREQUENCY_HOP' end) as reactive_actions
        from det join tr on det.source_row_id = tr.source_row_id),
    resp as materialized (select *, {_FORCED} as safety_forced_action, safety_constraint <> 'NONE' as safety_override, reactive_actions <> '' as reactive_triggered,
        case when {_MIX} and severity = 'HIGH' then 'ACTIVATE_ANTI_JAMMING_HOP' when {_MIX} then 'SWITCH_TO_BACKUP_CHANNEL' when final_label = 'SUSPICIOUS' then 'INCREASE_RF_MONITORING' else 'NO_RF_CHANGE' end as rf_action_taken,
        case when {_MIX} and severity = 'HIGH' then 'FREQUENCY_HOPPING' when {_MIX} then 'CHANNEL_SWITCH_MONITOR' when final_label = 'SUSPICIOUS' then 'HEIGHTENED_MONITORING' else 'NORMAL_OPERATION' end as rf_channel_mode,
        {_MIX} and severity = 'HIGH' and consecutive_attack_count >= 10 as lte_fallback_active,
        case final_label when 'DDOS' then 'DDOS_MITIGATION_ACTIVE' when 'DOS' then 'DOS_BLOCK_AND_RATE_LIMIT' when 'HYBRID_ATTACK' then 'HYBRID_CONTAIN_AND_REROUTE' when 'SUSPICIOUS' then 'MONITOR_NETWORK_PATH' else 'NO_NETWORK_CHANGE' end as net_action_taken,
        case when safety_constraint <> 'NONE' then {_FORCED} when final_label = 'DDOS' then 'SHED_NON_CRITICAL_LOAD' when final_label = 'DOS' then 'BLOCK_SUSPICIOUS_SOURCES'
            when final_label = 'HYBRID_ATTACK' then 'REROUTE_THROUGH_BACKUP_RELAY' else policy_action end as net_selected_action,
        case when final_label in ('DDOS', 'HYBRID_ATTACK') then 'BACKUP_MULTI_HOP' when final_label = 'DOS' then 'PRIMARY_PLUS_BROADCAST' else 'PRIMARY_ROUTE' end as alert_delivery_mode,
        final_label in ('JAMMING', 'DOS', 'DDOS', 'HYBRID_ATTACK') as notify_neighbors, final_label <> 'NORMAL' as notify_edge,
        (({_MIX} and severity = 'HIGH') or final_label in ('DDOS', 'HYBRID_ATTACK') or (final_label = 'DOS' and severity = 'HIGH') or safety_constraint <> 'NONE') as notify_gcc
        from rs0)"""


def response(spark, sf):
    return R.respond(detection(spark, sf))


def _prepared(spark, sf):
    return R.prepare(detection(spark, sf))


@query("b29_state_vector", f"""{RESPONSE_CTE} select source_row_id, concat_ws(',', {', '.join(
    f'cast(cast(round(least(greatest({e}, 0), 1) * 10000 + 0.0001) as bigint) as varchar)' for e in (
        'jam_risk_score', 'dos_risk_score', 'hybrid_risk_score', 'fusion_confidence', 'edge_alarm', 'cross_layer_anomaly_score', '(snr_db + 30) / 60',
        'channel_occupancy_pct / 100', 'packet_delivery_ratio', 'half_open_connections / 20000', 'src_ip_entropy / 9', 'error_response_rate',
        'consecutive_attack_count / 20', 'sa', 'nm'))}) as state from resp""")
def _(spark, sf):
    # The values of the state travel with the row through the trust step, so nothing is written or joined.
    rows = R.running_trust(_prepared(spark, sf), R.STATE_COLUMNS)
    v = rows.withColumn("v", R.state_vector(rows, "signal_after", "network_middle"))
    text = F.transform("v", lambda x: F.round(x * 10000 + 0.0001).cast("bigint").cast("string"))
    return v.select("source_row_id", F.array_join(text, ",").alias("state"))


_ACT = "(values " + ", ".join(f"({i}, '{a}')" for i, a in enumerate(K.ACTIONS)) + ") as a(idx, action)"
_WANT = "(case final_label " + " ".join(f"when '{l}' then action in ({', '.join(repr(x) for x in acts)})" for l, acts in K.DESIRED_ACTIONS.items()) + " else false end)"
_ATT = "final_label in ('JAMMING', 'DOS', 'DDOS', 'HYBRID_ATTACK')"
_REWARD = f"""least(5, greatest(-5, case when {_WANT} then 1.0 else -1.5 end
    + case when final_label = 'NORMAL' and action in ('SWITCH_TO_BACKUP_CHANNEL', 'BLOCK_SUSPICIOUS_SOURCES', 'ACTIVATE_FREQUENCY_HOPPING', 'SHED_NON_CRITICAL_LOAD') then -1.5 else 0 end
    + case when {_ATT} and severity = 'HIGH' and {_WANT} then 2.0 when {_ATT} and severity = 'HIGH' and action in ('CONTINUE_NORMAL_OPERATION', 'ALLOW_NORMAL_TRAFFIC') then -2.0 else 0 end
    + case when final_label = 'HYBRID_ATTACK' and {_WANT} then 1.0 else 0 end
    + fusion_confidence - least(channel_occupancy_pct / 100, 1) - least(error_response_rate, 1)))"""


@query("b30_reward", f"""{DETECTION_CTE}, x as (select source_row_id, {_REWARD} as r from det, {_ACT})
    select source_row_id, round(min(r), 6) as worst, round(max(r), 6) as best, round(sum(r), 6) as total from x group by 1""")
def _(spark, sf):
    return R.action_rewards(_prepared(spark, sf)).groupBy("source_row_id").agg(
        F.round(F.min("reward"), 6).alias("worst"), F.round(F.max("reward"), 6).alias("best"), F.round(F.sum("reward"), 6).alias("total"))


@query("h7_e9_action_values", f"""{DETECTION_CTE}, x as (select final_label, severity, idx, action, avg({_REWARD}) as v, count(*) as n from det, {_ACT} group by all)
    select final_label, severity, action, round(v, 6) as value, n as n_rows, row_number() over (partition by final_label, severity order by round(v, 9) desc, idx) = 1 as greedy from x""")
def _(spark, sf):
    v = durable(R.action_values(_prepared(spark, sf)))
    p = R.greedy_policy(v)
    return v.join(F.broadcast(p), ["final_label", "severity"]).select(
        "final_label", "severity", "action", F.round("value", 6).alias("value"), F.col("rows").alias("n_rows"),
        (F.col("action") == F.col("policy_action")).alias("greedy"))


# 300 sweeps over the (label, severity) states; the best action's immediate value does not depend on the sweep.
@query("h7_discounted_values", DETECTION_CTE.replace("with ", "with recursive ", 1) + f""",
    x as (select final_label, severity, idx, action, avg({_REWARD}) as v from det, {_ACT} group by all),
    st as (select final_label || '|' || severity as s, max(v) as best from x group by 1),
    mv as (select lag(final_label || '|' || severity) over (partition by node_id order by ts, source_row_id) as f, final_label || '|' || severity as g from det),
    ch as (select f, g, count(*) / sum(count(*)) over (partition by f) as p from mv where f is not null group by 1, 2),
    w as (select 0 as i, s, 0::double as v from st union all
        select w.i + 1, st.s, any_value(st.best) + 0.95::double * sum(coalesce(ch.p, 0) * w.v) from w cross join st left join ch on ch.f = st.s and ch.g = w.s where w.i < 300 group by w.i, st.s),
    later as (select st.s, sum(coalesce(ch.p, 0) * w.v) as v from st cross join (select * from w where i = 300) w left join ch on ch.f = st.s and ch.g = w.s group by 1)
    select x.final_label, x.severity, x.idx as action_index, x.action, round(x.v + 0.95::double * later.v + 1.23e-7, 5) as value
    from x join later on later.s = x.final_label || '|' || x.severity""")
def _(spark, sf):
    v = R.discounted_values(durable(_prepared(spark, sf)))
    return v.withColumn("value", F.round(F.col("value") + 1.23e-7, 5))


@query("b31_safety_rules", f"{RESPONSE_CTE} select source_row_id, safety_override, safety_constraint, safety_forced_action from resp")
def _(spark, sf):
    c, f = R.safety_rules()
    return _prepared(spark, sf).select("source_row_id", (c != "NONE").alias("safety_override"), c.alias("safety_constraint"), f.alias("safety_forced_action"))


@query("b32_reactive_rules", f"{RESPONSE_CTE} select source_row_id, reactive_actions, reactive_triggered from resp")
def _(spark, sf):
    r = R.reactive_rules()
    return _prepared(spark, sf).select("source_row_id", F.array_join(r, ",").alias("reactive_actions"), (F.size(r) > 0).alias("reactive_triggered"))


@query("b33_radio_actions", f"""{RESPONSE_CTE} select source_row_id, rf_action_taken, rf_channel_mode, lte_fallback_active,
    case rf_action_taken when 'ACTIVATE_ANTI_JAMMING_HOP' then 'BACKUP_5GHz' when 'SWITCH_TO_BACKUP_CHANNEL' then 'BACKUP_2.4GHz' end as fallback_channel from resp""")
def _(spark, sf):
    return _prepared(spark, sf).select("source_row_id", *[c.alias(n) for n, c in R.radio_actions().items() if not n.startswith("_")])


@query("b34_network_actions", f"{RESPONSE_CTE} select source_row_id, net_action_taken, alert_delivery_mode, policy_action from resp")
def _(spark, sf):
    d = durable(_prepared(spark, sf))
    p = R.greedy_policy(R.action_values(d))
    a = R.network_actions()
    return d.join(F.broadcast(p), ["final_label", "severity"]).select(
        "source_row_id", "policy_action", a["net_action_taken"].alias("net_action_taken"), a["alert_delivery_mode"].alias("alert_delivery_mode"))


@query("b35_response_table", f"""{RESPONSE_CTE} select source_row_id, net_selected_action, notify_neighbors, notify_edge, notify_gcc, safety_override from resp""")
def _(spark, sf):
    return response(spark, sf).select("source_row_id", "net_selected_action", "notify_neighbors", "notify_edge", "notify_gcc", "safety_override")


@query("d12_clamped_trust", f"""{RESPONSE_CTE} select source_row_id, round(sb, 6) as trust_before_signal, round(sm, 6) as signal_trust_before, round(sa, 6) as signal_trust_after,
    round(nb, 6) as trust_before_network, round(nm, 6) as network_trust_before, round(na, 6) as network_trust_after from resp""")
def _(spark, sf):
    names = ["trust_before_signal", "signal_trust_before", "signal_trust_after", "trust_before_network", "network_trust_before", "network_trust_after"]
    rows = R.running_trust(_prepared(spark, sf))  # trust does not depend on the policy, so that is not learned for it
    steps = [f"{c}_{k}" for c in ("signal", "network") for k in ("before", "middle", "after")]
    return rows.select("source_row_id", *[(F.round(s, 6) + 0.0).alias(n) for s, n in zip(steps, names)])


@query("d22_last_safe_state", f"""{DETECTION_CTE}, o as (select *, row_number() over (partition by node_id order by ts, source_row_id) as rn from det),
    l as (select *, max(case when final_label not in ('JAMMING', 'HYBRID_ATTACK', 'SUSPICIOUS') then rn end) over (partition by node_id order by ts, source_row_id) as safe from o)
    select l.source_row_id, s.snr_db as snr_db, s.rssi_dbm as rssi_dbm, case when s.rn is not null then 'PRIMARY' end as channel, strftime(s.ts, '%Y-%m-%d') as safe_day from l left join o s on s.node_id = l.node_id and s.rn = l.safe""")
def _(spark, sf):
    out = R.last_safe_state(detection(spark, sf).select("source_row_id", "node_id", "ts", "final_label", "snr_db", "rssi_dbm"))
    return out.select("source_row_id", "safe.snr_db", "safe.rssi_dbm", "safe.channel", F.date_format("safe.ts", "yyyy-MM-dd").alias("safe_day"))


def _b(c):
    return f"avg(case when {c} then 1.0 else 0.0 end)"


@query("c17_response_rates", f"""{RESPONSE_CTE} select {', '.join(f'round({_b(c)}, 6) as {n}' for c, n in (
    ('safety_override', 'safety_override_rate'), ('reactive_triggered', 'reactive_trigger_rate'), ('notify_gcc', 'gcc_notification_rate'), ('lte_fallback_active', 'lte_fallback_rate')))},
    round(avg(sa), 6) as signal_trust_mean, round(avg(na), 6) as network_trust_mean,
    round(avg(case when notify_gcc then 1.0 else 0.0 end) filter (where severity = 'HIGH' and final_label <> 'NORMAL'), 6) as high_attack_gcc_coverage from resp""")
def _(spark, sf):
    r = R.response_rates(response(spark, sf))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query("c17_response_distribution", f"""{RESPONSE_CTE} select 'rf_action' as dimension, final_label as "group", rf_action_taken as item, count(*) as n from resp group by 2, 3
    union all select 'network_action', final_label, net_selected_action, count(*) from resp group by 2, 3
    union all select 'gcc_by_severity', severity, cast(notify_gcc as varchar), count(*) from resp group by 2, 3
    union all select 'safety_constraint', 'all', safety_constraint, count(*) from resp group by 3""")
def _(spark, sf):
    return R.response_distribution(response(spark, sf))


@query("c17_trust_by_label", f"""{RESPONSE_CTE} select final_label, round(avg(sa), 6) as signal_mean, round(min(sa), 6) as signal_min, round(max(sa), 6) as signal_max,
    round(avg(na), 6) as network_mean, round(min(na), 6) as network_min, round(max(na), 6) as network_max from resp group by 1""")
def _(spark, sf):
    t = R.trust_by_label(response(spark, sf))
    return t.select("final_label", *[F.round(c, 6).alias(c) for c in t.columns[1:]])
