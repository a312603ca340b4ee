"""Queries for cross-layer features, peers, density outliers, fusion and evaluation."""

from pyspark.sql import functions as F

from aerovigil import constants as K
from aerovigil.operators import crosslayer as X
from aerovigil.operators import density as D
from aerovigil.operators import evaluation as E
from aerovigil.operators import fusion as FU
from aerovigil.operators import peers as P
from aerovigil.operators.models import merge_scores
from aerovigil.operators.selection import mutual_information
from aerovigil.plans.registry import query
from aerovigil.sources.fixtures import telemetry, telemetry_sql

DAY = 86400
_S = f"with t as materialized ({telemetry_sql(scores=True)})"

_COUPLED = f"""{_S}, q as (select quantile_cont(retransmission_count, 0.99) rx, quantile_cont(packets_per_second, 0.99) px, quantile_cont(noise_floor_drift_db, 0.99) nx from t),
    a as (select *, sqrt(least(retransmission_count / (greatest(rx, 1) + 1e-9), 1) * least(packets_per_second / (greatest(px, 1) + 1e-9), 1)) as jcc,
        case when jam_threshold_score >= 2 and dos_threshold_score >= 2 then 1 else 0 end as both_flag,
        least(greatest(1 - packet_delivery_ratio, 0), 1) as mac_loss, least(greatest(error_response_rate, 0), 1) as err,
        sqrt(least(noise_floor_drift_db / greatest(nx, 1e-6), 1) * least(greatest((packets_per_second_burst_index - 1) / 9, 0), 1)) as ntc from t, q),
    b as (select *, sqrt(mac_loss * err) as cli, least(0.40 * jcc + 0.35 * sqrt(mac_loss * err) + 0.25 * ntc, 1) as score from a)"""


def _scored(spark, sf, *columns):
    return telemetry(spark, sf, *columns, scores=True)


_CL_IN = ["label", "retransmission_count", "packets_per_second", "noise_floor_drift_db", "packets_per_second_burst_index",
          "jam_threshold_score", "dos_threshold_score", "packet_delivery_ratio", "error_response_rate", "unique_source_count"]


@query("b18_cross_layer_coupling", f"""{_COUPLED} select source_row_id, round(jcc, 6) as jam_congestion_coupling, both_flag as cross_layer_attack_flag,
    round(mac_loss, 6) as mac_loss_rate, round(cli, 6) as cross_layer_loss_index, round(abs(err - mac_loss), 6) as phy_app_loss_divergence,
    round(ntc, 6) as noise_traffic_coupling from b""")
def _(spark, sf):
    c = X.coupling_features(_scored(spark, sf, *_CL_IN))
    names = ["jam_congestion_coupling", "mac_loss_rate", "cross_layer_loss_index", "phy_app_loss_divergence", "noise_traffic_coupling"]
    return c.select("source_row_id", "cross_layer_attack_flag", *[F.round(n, 6).alias(n) for n in names])


_TIER = ", (select quantile_cont(score, 0.95) m, quantile_cont(score, 0.995) h from b where label = 'normal') z"


@query("b19_cross_layer_score", f"""{_COUPLED} select source_row_id, round(score, 6) as cross_layer_anomaly_score,
    case when score >= h then 'HIGH' when score >= m then 'MEDIUM' else 'LOW' end as cross_layer_severity from b{_TIER}""")
def _(spark, sf):
    c = X.coupling_features(_scored(spark, sf, *_CL_IN))
    return X.scenario_tags(c, X.severity_limits(c)).select(
        "source_row_id", F.round("cross_layer_anomaly_score", 6).alias("cross_layer_anomaly_score"), "cross_layer_severity")


@query("b20_scenario_tag", f"""{_COUPLED} select source_row_id, case when both_flag = 1 and score > 0.3 then 'HYBRID_ATTACK'
    when jam_threshold_score >= 3 and dos_threshold_score < 1 then 'JAMMING' when dos_threshold_score >= 3 and unique_source_count >= 50 then 'DDOS'
    when dos_threshold_score >= 3 then 'DOS' when jam_threshold_score >= 1 or dos_threshold_score >= 1 then 'SUSPICIOUS' else 'NORMAL' end as scenario_tag from b""")
def _(spark, sf):
    c = X.coupling_features(_scored(spark, sf, *_CL_IN))
    return X.scenario_tags(c, {"medium": 0.0, "high": 0.0}).select("source_row_id", "scenario_tag")


_PEER = f"""with t as materialized ({telemetry_sql()}), c as (select ts, count(*) n, min(packets_per_second) mn,
    {', '.join(f'median({m}) md_{m}, coalesce(stddev_samp({m}), 1) sd_{m}' for m in K.PEER_METRICS)} from t group by ts),
    p as (select t.*, c.n - 1 as neighbor_count, mn, {', '.join(f'md_{m}, abs({m} - md_{m}) as dev_{m}, least(coalesce(abs({m} - md_{m}) / (sd_{m} + 1e-9), 0), 10) as z_{m}' for m in K.PEER_METRICS)}
        from t join c on t.ts = c.ts),
    s as (select *, ({' + '.join(f'least(greatest(z_{m}, 0), 5) / 5' for m in K.PEER_SCORE_METRICS)}) / 4 as score from p)"""


def _peers(spark, sf):
    return P.peer_deviations(telemetry(spark, sf, "ts", "label", *K.PEER_METRICS), DAY)


@query("d13_peer_consensus", f"""{_PEER} select source_row_id, neighbor_count, {', '.join(
    f'round(md_{m}, 6) as swarm_{m}_consensus, round(dev_{m}, 6) as {m}_swarm_dev, round(z_{m}, 5) as {m}_swarm_zscore' for m in K.PEER_METRICS)} from s""")
def _(spark, sf):
    p = _peers(spark, sf)
    names = {n: r for m in K.PEER_METRICS for n, r in ((f"swarm_{m}_consensus", 6), (f"{m}_swarm_dev", 6), (f"{m}_swarm_zscore", 5))}
    return p.select("source_row_id", "neighbor_count", *[F.round(n, r).alias(n) for n, r in names.items()])


@query("d14_peer_flags", f"""{_PEER}, q as (select quantile_cont(dev_rssi_dbm, 0.99) a, quantile_cont(packets_per_second, 0.99) b,
    quantile_cont(dev_src_ip_entropy, 0.99) c, quantile_cont(score, 0.95) d from s where label = 'normal')
    select source_row_id, round(score, 6) as swarm_consensus_anomaly_score, case when dev_rssi_dbm > a then 1 else 0 end as isolated_signal_outlier,
    case when mn > b and neighbor_count >= 2 then 1 else 0 end as coordinated_flood_flag,
    case when dev_src_ip_entropy > c then 1 else 0 end as swarm_entropy_divergence_flag,
    case when round(score, 9) > round(d, 9) then 1 else 0 end as swarm_anomaly_flag from s, q""")
def _(spark, sf):
    p = _peers(spark, sf)
    limits = P.peer_limits(p)
    p = p.withColumn("score", F.round("swarm_consensus_anomaly_score", 6)).withColumn(
        "swarm_consensus_anomaly_score", F.round("swarm_consensus_anomaly_score", 9))
    limits["score"] = round(limits["score"], 9)
    return P.peer_flags(p, limits).select(
        "source_row_id", F.col("score").alias("swarm_consensus_anomaly_score"),
        "isolated_signal_outlier", "coordinated_flood_flag", "swarm_entropy_divergence_flag", "swarm_anomaly_flag")


_DENSE = {"a": "packets_per_second / 105000", "b": "src_ip_entropy / 9", "c": "half_open_connections / 10500"}
_H5 = f"""with t as materialized (select source_row_id, ts, {', '.join(f'{e} as {n}' for n, e in _DENSE.items())} from ({telemetry_sql()})),
    n as (select x.source_row_id i, y.source_row_id j from t x join t y on x.ts = y.ts
        where (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c) <= 0.2::double * 0.2::double),
    core as (select i from n group by 1 having count(*) >= 3),
    ok as (select distinct n.i from n join core on n.j = core.i),
    sz as (select ts, count(*) n from t group by 1)
    select t.source_row_id, case when sz.n < 3 then -2 when ok.i is null then -1 else 0 end as dbscan_label,
        case when sz.n >= 3 and ok.i is null then 1 else 0 end as traffic_outlier
    from t join sz on t.ts = sz.ts left join ok on t.source_row_id = ok.i"""


@query("h5_density_outliers", _H5)
def _(spark, sf):
    t = telemetry(spark, sf, "node_id", "ts", *K.DENSITY_METRICS).selectExpr(
        "source_row_id", "node_id", "ts", *[f"{e} as {n}" for n, e in _DENSE.items()])
    return D.density_outliers(t, seconds=DAY, metrics=list(_DENSE))


_LIMITS = """q as (select quantile_cont(cross_layer_anomaly_score, 0.95) cl, quantile_cont(swarm_consensus_anomaly_score, 0.95) sw,
    quantile_cont(jam_threshold_score, 0.99) jt, quantile_cont(dos_threshold_score, 0.99) dt, quantile_cont(unique_source_count, 0.95) us,
    quantile_cont(src_ip_entropy, 0.90) en from t where label = 'normal')"""
DETECTION_CTE = f"""{_S}, {_LIMITS},
    r1 as (select *, least(0.30::double * jamming_conf_attack + 0.20::double * edge_alarm + 0.15::double * jamming_ae_flag + 0.15::double * gru_jam_flag
        + 0.10::double * (case when jam_threshold_score > jt then 1 else 0 end) + 0.10::double * (case when cross_layer_anomaly_score > cl then 1 else 0 end), 1) as jam,
        least(0.30::double * dos_conf_attack + 0.20::double * traffic_outlier + 0.15::double * dos_ae_flag + 0.15::double * (case when dos_threshold_score > dt then 1 else 0 end)
        + 0.10::double * (case when swarm_consensus_anomaly_score > sw then 1 else 0 end) + 0.10::double * coordinated_flood_flag, 1) as dos,
        (unique_source_count > us) as many, (src_ip_entropy > en) as high from t, q),
    r2 as (select *, least(0.35::double * hybrid_conf_attack + 0.30::double * (case when cross_layer_anomaly_score > cl then 1 else 0 end) + 0.25::double * cross_layer_attack_flag
        + 0.10::double * (case when jam > 0.3 and dos > 0.3 then 1 else 0 end), 1) as hyb from r1),
    r3 as (select *, least(greatest(jam, dos, hyb) + 0.05::double * edge_alarm, 1) as fus, (many or high) as spread,
        hyb >= 0.6 and jam >= 0.3 and dos >= 0.3 and (cross_layer_anomaly_score > cl or cross_layer_attack_flag = 1) as gate from r2),
    r4 as (select *, case when gate and jam >= dos then 'JAMMING' when gate and spread then 'DDOS' when gate then 'DOS'
        when jam >= 0.6 then 'JAMMING' when dos >= 0.6 and spread then 'DDOS' when dos >= 0.6 then 'DOS' when jam >= 0.4 then 'JAMMING'
        when dos >= 0.3 and spread then 'DDOS' when dos >= 0.3 then 'DOS' when fus >= 0.1 then 'SUSPICIOUS' else 'NORMAL' end as final_label,
        row_number() over (partition by node_id order by ts, source_row_id) as rn from r3),
    r5 as (select *, cast(rn - coalesce(max(case when final_label = 'NORMAL' then rn end) over (partition by node_id order by ts, source_row_id), 0) as integer)
        as consecutive_attack_count from r4),
    det as materialized (select * exclude (rn), round(jam, 4) as jam_risk_score, round(dos, 4) as dos_risk_score, round(hyb, 4) as hybrid_risk_score, round(fus, 4) as fusion_confidence,
        case when final_label = 'NORMAL' then 'LOW' when consecutive_attack_count >= 10 then 'HIGH' when consecutive_attack_count >= 3 then 'MEDIUM'
        when fus >= 0.5 then 'MEDIUM' else 'LOW' end as severity from r5)"""


def detection(spark, sf):
    """The detection table of the scored telemetry view."""
    return FU.fuse(telemetry(spark, sf, scores=True))


@query("b21_risk_scores", f"""{DETECTION_CTE} select source_row_id, jam_risk_score, dos_risk_score, hybrid_risk_score, fusion_confidence from det""")
def _(spark, sf):
    t = FU.attach_scores(_scored(spark, sf), None, None)
    return FU.risk_scores(t, FU.fusion_limits(t)).select(
        "source_row_id", "jam_risk_score", "dos_risk_score", "hybrid_risk_score", "fusion_confidence")


@query("b22_distributed_flood", f"{DETECTION_CTE} select source_row_id, many as many_sources, high as high_entropy, spread as distributed from det")
def _(spark, sf):
    t = _scored(spark, sf, "label", "unique_source_count", "src_ip_entropy", "traffic_outlier")
    t = FU.attach_scores(t, None, None)
    many, high, spread = FU.source_signals(FU.fusion_limits(t))
    return t.select("source_row_id", many.alias("many_sources"), high.alias("high_entropy"), spread.alias("distributed"))


@query("b23_b24_label_and_severity", f"{DETECTION_CTE} select source_row_id, final_label, severity, consecutive_attack_count from det")
def _(spark, sf):
    return detection(spark, sf).select("source_row_id", "final_label", "severity", "consecutive_attack_count")


_REASONS = [("EDGE_ALARM", "edge_alarm = 1"), ("GRU_JAM_ANOMALY", "gru_jam_flag = 1"), ("LSTM_AE_JAM_CONFIRMED", "jamming_ae_flag = 1"),
            ("CNN_LSTM_JAM_DETECTED", "jamming_conf_attack > 0.5"), ("CNN_LSTM_DOS_DETECTED", "dos_conf_attack > 0.5"),
            ("CNN_LSTM_HYBRID_DETECTED", "hybrid_conf_attack > 0.5"), ("LSTM_AE_DOS_CONFIRMED", "dos_ae_flag = 1"),
            ("DBSCAN_TRAFFIC_OUTLIER", "traffic_outlier = 1"), ("HIGH_JAM_THRESHOLD_SCORE", "jam_threshold_score > jt"),
            ("HIGH_DOS_THRESHOLD_SCORE", "dos_threshold_score > dt"), ("CROSS_LAYER_ATTACK", "cross_layer_attack_flag = 1"),
            ("HIGH_CROSS_LAYER_SCORE", "cross_layer_anomaly_score > cl"), ("SWARM_CONSENSUS_ANOMALY", "swarm_consensus_anomaly_score > sw"),
            ("COORDINATED_FLOOD", "coordinated_flood_flag = 1"), ("HIGH_SRC_ENTROPY", "high"), ("HIGH_SOURCE_COUNT", "many"),
            ("NOISE_FLOOR_ELEVATED", "noise_floor_drift_flag = 1"), ("PHYSICAL_IMPOSSIBILITY", "bit_error_rate > 0.3 and snr_db < 0")]
REASONS_SQL = "concat_ws(',', " + ", ".join(f"case when {c} then '{n}' end" for n, c in _REASONS) + ")"


@query("b25_reason_codes", f"{DETECTION_CTE} select source_row_id, {REASONS_SQL} as reasons from det")
def _(spark, sf):
    t = FU.attach_scores(_scored(spark, sf), None, None)
    return t.select("source_row_id", F.array_join(FU.reason_codes(FU.fusion_limits(t)), ",").alias("reasons"))


@query("e1_e2_e5_attach_scores", f"""{_S} select source_row_id, case when node_id like '%1' then edge_alarm else 0 end::double as edge_alarm,
    case when l2 = 0 then jamming_conf_attack else 0.0 end as jamming_conf_attack, case when l2 = 0 and hybrid_conf_attack > 0.5 then traffic_outlier else 0 end::double as traffic_outlier
    from (select *, cast(src_ip_entropy * 10 as bigint) % 2 as l2 from t)""")
def _(spark, sf):
    t = _scored(spark, sf, "node_id", "src_ip_entropy")
    s = _scored(spark, sf, "node_id", "src_ip_entropy", "edge_alarm", "jamming_conf_attack", "hybrid_conf_attack", "traffic_outlier")
    edge = s.where(F.col("node_id").like("%1")).select("source_row_id", "edge_alarm")
    even = s.where((F.col("src_ip_entropy") * 10).cast("bigint") % 2 == 0)
    jam = even.select("source_row_id", "jamming_conf_attack")
    outlier = s.where("hybrid_conf_attack > 0.5").select("source_row_id", "traffic_outlier")
    # Result sets of separate detectors become one gateway table; outliers only complete rows it has.
    hybrid = even.select("source_row_id", "hybrid_conf_attack")
    out = FU.attach_scores(t, edge, merge_scores([jam, hybrid], outlier))
    return out.select("source_row_id", "edge_alarm", "jamming_conf_attack", "traffic_outlier")


@query("h6_detection_table", f"""{DETECTION_CTE} select final_label, severity, label, count(*) as n, round(avg(fusion_confidence), 6) as mean_confidence,
    max(consecutive_attack_count) as longest_run from det group by 1, 2, 3""")
def _(spark, sf):
    return detection(spark, sf).groupBy("final_label", "severity", "label").agg(
        F.count("*").alias("n"), F.round(F.avg("fusion_confidence"), 6).alias("mean_confidence"),
        F.max("consecutive_attack_count").alias("longest_run"))


_CM = """c as (select count(*) filter (where label <> 'normal' and final_label <> 'NORMAL') tp, count(*) filter (where label = 'normal' and final_label = 'NORMAL') tn,
    count(*) filter (where label = 'normal' and final_label <> 'NORMAL') fp, count(*) filter (where label <> 'normal' and final_label = 'NORMAL') fn from det)"""


@query("c15_binary_metrics", f"""{DETECTION_CTE}, {_CM} select tp, tn, fp, fn, round(tp / (tp + fp), 6) as "precision", round(tp / (tp + fn), 6) as recall,
    round(2 * tp / (2 * tp + fp + fn), 6) as f1, round(case when fp + tn > 0 then fp / (fp + tn) else 0 end, 6) as fpr from c""")
def _(spark, sf):
    m = E.binary_metrics(detection(spark, sf))
    return m.select("tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "fpr")])


@query("c16_attack_breakdown", f"""{DETECTION_CTE} select final_label as attack, count(*) as predicted, count(*) filter (where lower(label) = lower(final_label)) as tp,
    count(*) filter (where lower(label) <> lower(final_label)) as fp from det where final_label <> 'NORMAL' group by 1""")
def _(spark, sf):
    return E.attack_breakdown(detection(spark, sf))


@query("c16_severity_breakdown", f"""{DETECTION_CTE} select severity, count(*) filter (where label <> 'normal') as tp, count(*) filter (where label = 'normal') as fp
    from det where final_label <> 'NORMAL' group by 1""")
def _(spark, sf):
    return E.severity_breakdown(detection(spark, sf))


@query("c16_class_report", f"""{DETECTION_CTE}, {_CM} select 'ATTACK' as class, round(tp / (tp + fp), 6) as "precision", round(tp / (tp + fn), 6) as recall,
    round(2 * tp / (2 * tp + fp + fn), 6) as f1, tp + fn as support from c union all select 'NORMAL', round(coalesce(tn / nullif(tn + fn, 0), 0), 6),
    round(coalesce(tn / nullif(tn + fp, 0), 0), 6), round(coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0), 6), tn + fp from c""")
def _(spark, sf):
    r = E.class_report(detection(spark, sf))
    return r.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("c14_label_profile", f"""{_S} {' union all '.join(f"select label, '{m}' as feature, round(avg({m}), 4) as mean, round(stddev_samp({m}), 4) as std, min({m}) as min, max({m}) as max from t group by 1" for m in K.JAM_METRICS[:8])}""")
def _(spark, sf):
    p = E.label_profile(telemetry(spark, sf, "label", *K.JAM_METRICS), K.JAM_METRICS, 8)
    return p.select("label", "feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max")


_MI_NAMES = ["snr_db", "packets_per_second", "cca_failure_count", "unique_source_count", "jamming_conf_attack", "dos_conf_attack"]


def mi_sql(names: list[str]) -> str:
    """CTEs ending in ``mi(feature, mi)``: 32 equal-frequency bins per feature against the label, in nats."""
    grid = ", ".join(f"{i / 32}::double" for i in range(1, 32))
    return f"""{_S}, x as ({' union all '.join(f"select '{c}' as feature, cast({c} as double) as v, label from t" for c in names)}),
        q as (select feature, list_distinct(quantile_disc(v, [{grid}])) as edges from x group by 1),
        b as (select x.feature, len(list_filter(edges, lambda e: v > e)) as bin, label, count(*) as n from x join q on x.feature = q.feature group by all),
        g as (select *, sum(n) over (partition by feature, bin) as nb, sum(n) over (partition by feature, label) as nl, sum(n) over (partition by feature) as total from b),
        mi as (select feature, sum(n / total * ln(n * total / (nb * nl))) as mi from g group by 1)"""


@query("c25_mutual_information", f"{mi_sql(_MI_NAMES)} select feature, round(mi + 1.23e-9, 8) as mi from mi")
def _(spark, sf):
    mi = mutual_information(telemetry(spark, sf, "label", *_MI_NAMES, scores=True), _MI_NAMES)
    return mi.select("feature", F.round(F.col("mi") + 1.23e-9, 8).alias("mi"))


@query("g3_top_features", f"""{_S}, c as (select label, cast(cca_failure_count as integer) as v, count(*) as n from t group by 1, 2) select v as cca_failure_count, sum(n)::bigint as n
    from c group by 1 order by 2 desc, 1 limit 5""")
def _(spark, sf):
    t = telemetry(spark, sf, "cca_failure_count")
    return (t.groupBy(F.col("cca_failure_count").cast("int").alias("cca_failure_count")).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "cca_failure_count").limit(5))
