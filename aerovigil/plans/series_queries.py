"""Queries over per-node series, with recursive or brute-force SQL as oracles."""

from pyspark.sql import functions as F

from aerovigil import constants as K
from aerovigil.functions import scalars as S
from aerovigil.operators import series as R
from aerovigil.operators import temporal as T
from aerovigil.operators import thresholds as TH
from aerovigil.operators import windows as W
from aerovigil.operators.ordered import order_rows
from aerovigil.operators.quantiles import exact_quantiles, normal_quantiles
from aerovigil.plans.registry import query
from aerovigil.session import durable
from aerovigil.sources.fixtures import packets, packets_sql, telemetry, telemetry_sql

_T = f"with recursive t as materialized ({telemetry_sql()})"
_W = "(partition by node_id order by ts, source_row_id)"
_NUM = f"""{_T}, s as (select *, row_number() over {_W} as p, count(*) over (partition by node_id) as n from t)"""


def _frame(w):
    return f"(partition by node_id order by ts, source_row_id rows between {w - 1} preceding and current row)"


def _series(spark, sf, *columns, halo=R.HALO_ROWS):
    t = telemetry(spark, sf, "node_id", "ts", *columns)
    return order_rows(t, T.ORDER, T.KEYS, halo=halo)


_ROLL = [(m, w) for m, ws in K.ROLLING_TARGETS.items() for w in ws]


@query("d1_rolling_statistics", f"""{_T} select source_row_id, {', '.join(
    f"round(avg({m}) over {_frame(w)}, 7) as {m}_roll_mean_{w}s, round(coalesce(stddev_samp({m}) over {_frame(w)}, 0), 6) as {m}_roll_std_{w}s"
    for m, w in _ROLL)}, min(snr_db) over {_frame(10)} as snr_min, max(snr_db) over {_frame(10)} as snr_max,
    sum(mac_retry_count) over {_frame(5)} as retry_sum from t""")
def _(spark, sf):
    s = _series(spark, sf, *K.ROLLING_TARGETS)
    cols = {}
    for m, w in _ROLL:
        cols[f"{m}_roll_mean_{w}s"] = F.round(R.rolling(s, F.col(m), w, "mean"), 7)
        cols[f"{m}_roll_std_{w}s"] = F.round(R.rolling(s, F.col(m), w, "std"), 6)
    cols |= {"snr_min": R.rolling(s, F.col("snr_db"), 10, "min"), "snr_max": R.rolling(s, F.col("snr_db"), 10, "max"),
             "retry_sum": R.rolling(s, F.col("mac_retry_count"), 5, "sum")}
    return s.finish(s.rows.withColumns(cols)).select("source_row_id", *cols)


@query("d2_deltas", f"""{_T}, d as (select source_row_id, {', '.join(
    f'coalesce({m} - lag({m}) over {_W}, 0) as {m}_delta' for m in K.DELTA_METRICS)} from t)
    select source_row_id, {', '.join(f'round({m}_delta, 6) + 0.0 as {m}_delta, round(abs({m}_delta), 6) as {m}_abs_delta' for m in K.DELTA_METRICS)},
    round(abs(least(rssi_dbm_delta, 0)), 6) as rssi_drop, round(abs(least(packet_delivery_ratio_delta, 0)), 6) as pdr_drop from d""")
def _(spark, sf):
    s = _series(spark, sf, *K.DELTA_METRICS, halo=1)
    d = s.rows.withColumns({f"{m}_delta": R.delta(s, F.col(m)) for m in K.DELTA_METRICS})
    out = {f"{m}_abs_delta": F.abs(f"{m}_delta") for m in K.DELTA_METRICS}
    out |= {"rssi_drop": F.abs(F.least(F.col("rssi_dbm_delta"), F.lit(0.0))),
            "pdr_drop": F.abs(F.least(F.col("packet_delivery_ratio_delta"), F.lit(0.0)))}
    names = [f"{m}_delta" for m in K.DELTA_METRICS] + list(out)
    return s.finish(d.withColumns(out)).select("source_row_id", *[(F.round(n, 6) + 0.0).alias(n) for n in names])


@query("d3_ewma", f"""{_NUM}, e as (select node_id, p, source_row_id, {', '.join(f'{m} as {m}_ewma' for m in K.EWMA_METRICS)} from s where p = 1
    union all select s.node_id, s.p, s.source_row_id, {', '.join(f's.{m} * 0.3::double + e.{m}_ewma * 0.7::double' for m in K.EWMA_METRICS)}
    from e join s on s.node_id = e.node_id and s.p = e.p + 1)
    select source_row_id, {', '.join(f'round({m}_ewma + 1.23456789e-8::double, 6) as {m}_ewma' for m in K.EWMA_METRICS)} from e""")
def _(spark, sf):
    s = _series(spark, sf, *K.EWMA_METRICS)
    filled = R.fill_forward(s, s.rows, K.EWMA_METRICS)
    out = s.finish(R.ewma(s, filled, K.EWMA_METRICS))
    # The constant keeps short decimals away from rounding ties.
    return out.select("source_row_id", *[F.round(F.col(f"{m}_ewma") + 1.23456789e-8, 6).alias(f"{m}_ewma") for m in K.EWMA_METRICS])


_WARM = "p <= least(10, greatest(3, n // 5))"


@query("d4_warmup_calibration", f"""{_NUM} select node_id, {', '.join(
    f'round(avg({m}) filter (where {_WARM}), 6) as mu_{m}, round(stddev_pop({m}) filter (where {_WARM}) + 1e-6, 6) as sd_{m}' for m in K.JAM_CUSUM)}
    from s group by 1""")
def _(spark, sf):
    s = _series(spark, sf, *K.JAM_CUSUM, halo=0)
    w = s.finish(R.warmup_statistics(s, s.rows, list(K.JAM_CUSUM))).where("_pos = 1")
    return w.select("node_id", *[F.round(f"_mu_{m}", 6).alias(f"mu_{m}") for m in K.JAM_CUSUM],
                    *[F.round(F.col(f"_sd_{m}") + 1e-6, 6).alias(f"sd_{m}") for m in K.JAM_CUSUM])


_CUSUM = {**K.JAM_CUSUM, **K.DOS_CUSUM}


def _cusum_step(m, d, s):
    y = f"s.{m} - w.mu_{m}"
    return f"greatest(0, {s} + {y} - 0.5 * w.sd_{m})" if d == "up" else f"least(0, {s} + {y} + 0.5 * w.sd_{m})"


@query("d5_cusum", f"""{_NUM}, w as (select node_id, {', '.join(
    f'avg({m}) filter (where {_WARM}) as mu_{m}, stddev_pop({m}) filter (where {_WARM}) + 1e-6::double as sd_{m}' for m in _CUSUM)} from s group by 1),
    c as (select s.node_id, s.p, s.source_row_id, {', '.join(f'{_cusum_step(m, d, "0.0::double")} as c_{m}' for m, d in _CUSUM.items())}
        from s join w on s.node_id = w.node_id where p = 1
    union all select s.node_id, s.p, s.source_row_id, {', '.join(_cusum_step(m, d, f'c.c_{m}') for m, d in _CUSUM.items())}
        from c join s on s.node_id = c.node_id and s.p = c.p + 1 join w on w.node_id = s.node_id)
    select c.source_row_id, {', '.join(f'round(abs(c_{m}), 3) as {m}_cusum, case when abs(c_{m}) > 5 * sd_{m} then 1 else 0 end as {m}_cusum_flag' for m in _CUSUM)}
    from c join w on c.node_id = w.node_id""")
def _(spark, sf):
    s = _series(spark, sf, *_CUSUM, halo=0)
    out = s.finish(R.cusum(s, R.warmup_statistics(s, s.rows, list(_CUSUM)), _CUSUM))
    return out.select("source_row_id", *[F.round(F.abs(f"{m}_cusum"), 3).alias(f"{m}_cusum") for m in _CUSUM],
                      *[f"{m}_cusum_flag" for m in _CUSUM])


_FLAGS = {**K.JAM_FLAG_TARGETS, **K.DOS_FLAG_TARGETS}


@query("d6_confirmed_flags", f"""{_T}, q as (select {', '.join(f'quantile_cont({m}, {q}) as q_{m}' for m, (q, _) in _FLAGS.items())} from t where label = 'normal')
    select source_row_id, {', '.join(f"case when sum(case when {m} {'<' if side == 'below' else '>'} q_{m} then 1 else 0 end) over {_frame(3)} >= 3 then 1 else 0 end as {m}_flag" for m, (_, side) in _FLAGS.items())} from t, q""")
def _(spark, sf):
    s = _series(spark, sf, "label", *_FLAGS, halo=3)
    limits = normal_quantiles(telemetry(spark, sf, "label", *_FLAGS), {m: (m, q) for m, (q, _) in _FLAGS.items()})
    flags = R.threshold_flags(s, _FLAGS, limits)
    return s.finish(s.rows.withColumns(flags)).select("source_row_id", *flags)


@query("d7_noise_floor_drift", f"""{_NUM}, w as (select node_id, avg(noise_floor_dbm) filter (where {_WARM}) mu,
    stddev_pop(noise_floor_dbm) filter (where {_WARM}) sd from s group by 1),
    r as (select s.*, max(noise_floor_dbm) over (partition by s.node_id order by ts, source_row_id rows between 30 preceding and current row) - mu as rise, greatest(3, sd * 2.5) as lim from s join w on s.node_id = w.node_id)
    select source_row_id, round(greatest(rise, 0), 6) as noise_floor_drift_db,
    case when sum(case when round(rise - lim, 9) > 0 then 1 else 0 end) over {_frame(5)} >= 5 then 1 else 0 end as noise_floor_drift_flag from r""")
def _(spark, sf):
    s = _series(spark, sf, "noise_floor_dbm")
    out = s.finish(R.noise_drift(s, R.warmup_statistics(s, s.rows, ["noise_floor_dbm"])))
    return out.select("source_row_id", F.round("noise_floor_drift_db", 6).alias("noise_floor_drift_db"), "noise_floor_drift_flag")


@query("d9_attack_run_length", f"""{_NUM}, b as (select *, coalesce(max(case when label = 'normal' then p end) over {_W}, 0) as last_normal from s)
    select source_row_id, cast(p - last_normal as integer) as run_length from b""")
def _(spark, sf):
    s = _series(spark, sf, "label", halo=0)
    return s.finish(R.run_length(s, s.rows, F.col("label") != "normal", "run_length")).select("source_row_id", "run_length")


def _sessions_sql(days):
    """Gaps and islands: a session starts where the last alarm of the node is more than ``days`` back."""
    return f"""{_T}, a as (select node_id, ts, ts - lag(ts) over (partition by node_id order by ts) > interval {days} day as far from t where label <> 'normal'),
    i as (select *, sum(case when far then 1 else 0 end) over (partition by node_id order by ts range unbounded preceding) as session from a)
    select node_id, epoch_us(min(ts)) as session_start, epoch_us(max(ts)) as session_end, count(*) as "rows" from i group by node_id, session"""


def _micros(sessions):
    return sessions.select("node_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "rows")


@query("d9_alarm_sessions", _sessions_sql(20))
def _(spark, sf):
    return _micros(R.alarm_sessions(telemetry(spark, sf, "node_id", "ts", "label"), F.col("label") != "normal", "20 days"))


_P = f"with p as ({packets_sql()})"
_PF = "(partition by node_id order by ts, packet_id rows between 19 preceding and current row)"


@query("d15_rolling_sources", f"{_P} select packet_id, count(distinct ip_src) over {_PF}::double as unique_source_count from p")
def _(spark, sf):
    p = packets(spark, sf)
    return T.rolling_packet_context(W.packet_samples(p)).select("packet_id", "unique_source_count")


@query("d16_packet_rates", f"""{_P} select packet_id, round(1 / (avg(iat_s) over {_PF} + 1e-6), 4) as packets_per_second,
    round(1 / (avg(iat_s) over {_PF} + 1e-6) * avg(frame_len) over {_PF}, 3) as bytes_per_second,
    round(coalesce(stddev_samp(ant_signal_dbm) over {_PF}, 0), 6) as rssi_roll_std, sum(retry) over {_PF} as retry_roll_sum,
    round(avg(bad_fcs) over {_PF}, 6) as badfcs_roll_mean, round(avg(arp) over {_PF}, 6) as arp_roll_rate,
    round(coalesce(stddev_samp(coalesce(ip_ttl, 0)) over {_PF}, 0), 6) as ttl_roll_std from p""")
def _(spark, sf):
    c = T.rolling_packet_context(W.packet_samples(packets(spark, sf)))
    return c.select("packet_id", F.round("packets_per_second", 4).alias("packets_per_second"),
                    F.round("bytes_per_second", 3).alias("bytes_per_second"), F.round("rssi_roll_std", 6).alias("rssi_roll_std"),
                    "retry_roll_sum", F.round("badfcs_roll_mean", 6).alias("badfcs_roll_mean"),
                    F.round("arp_roll_rate", 6).alias("arp_roll_rate"), F.round("ttl_roll_std", 6).alias("ttl_roll_std"))


_TRAFFIC = [f"{m}{x}" for m in K.BURST_METRICS for x in ("_burst_index", "_roll_std_10s", "_roll_mean_5s")]
_D17_SQL = ', '.join(f"""round(least({m} / (avg({m}) over {_frame(30)} + 1e-9), 1000), 6) as {m}_burst_index,
    round(coalesce(stddev_samp({m}) over {_frame(10)}, 0), 3) as {m}_roll_std_10s,
    round(avg({m}) over {_frame(5)}, 6) as {m}_roll_mean_5s""" for m in K.BURST_METRICS)


def _traffic(spark, sf):
    t = telemetry(spark, sf, "node_id", "ts", "label", *K.DOS_METRICS)
    return T.traffic_features(t)


@query("d17_burst_index", f"{_T} select source_row_id, {_D17_SQL} from t")
def _(spark, sf):
    places = {n: 6 if n.endswith("index") else 3 if "std" in n else 6 for n in _TRAFFIC}
    return _traffic(spark, sf).select("source_row_id", *[F.round(n, p).alias(n) for n, p in places.items()])


@query("d18_entropy_dynamics", f"""{_T}, q as (select quantile_cont(src_ip_entropy, 0.1) lo, quantile_cont(src_ip_entropy, 0.99) hi from t where label = 'normal'),
    d as (select *, coalesce(src_ip_entropy - lag(src_ip_entropy) over {_W}, 0) as sd, coalesce(dst_ip_entropy - lag(dst_ip_entropy) over {_W}, 0) as dd,
        avg(src_ip_entropy) over {_frame(5)} as m5, min(src_ip_entropy) over {_frame(10)} as m10 from t, q)
    select source_row_id, round(sd, 6) as src_entropy_delta, round(abs(least(sd, 0)), 6) as src_entropy_drop, round(greatest(sd, 0), 6) as src_entropy_spike,
    m10 as src_entropy_roll_min_10s, case when m5 < lo then 1 else 0 end as low_src_entropy_flag, case when m5 > hi then 1 else 0 end as high_src_entropy_flag,
    round(dd, 6) as dst_entropy_delta, round(src_ip_entropy - dst_ip_entropy, 6) as entropy_asymmetry from d""")
def _(spark, sf):
    rounded = ("src_entropy_delta", "src_entropy_drop", "src_entropy_spike", "dst_entropy_delta", "entropy_asymmetry")
    return _traffic(spark, sf).select("source_row_id", "src_entropy_roll_min_10s", "low_src_entropy_flag",
                                      "high_src_entropy_flag", *[F.round(n, 6).alias(n) for n in rounded])


@query("b12_protocol_shares", f"""{_T} select source_row_id, {', '.join(
    f'round(coalesce(least({m} / (nullif(packets_per_second, 0) + 1e-9), 1), 0), 6) as {n}' for n, m in
    (("syn_fraction", "syn_packet_rate"), ("icmp_fraction", "icmp_packet_rate"), ("udp_fraction", "udp_packet_rate"), ("fin_rst_fraction", "fin_rst_rate")))} from t""")
def _(spark, sf):
    names = ("syn_fraction", "icmp_fraction", "udp_fraction", "fin_rst_fraction")
    return _traffic(spark, sf).select("source_row_id", *[F.round(n, 6).alias(n) for n in names])


@query("d19_connection_exhaustion", f"""{_T}, q as (select quantile_cont(error_response_rate, 0.99) hi from t where label = 'normal'),
    f as (select *, least(syn_packet_rate / (packets_per_second + 1e-9), 1) as syn from t, q)
    select source_row_id, round(abs(coalesce(syn - lag(syn) over {_W}, 0)), 6) as syn_fraction_delta, round(max(syn) over {_frame(5)}, 6) as syn_dominance,
    round(coalesce(half_open_connections - lag(half_open_connections) over {_W}, 0), 4) as half_open_accel, round(avg(half_open_connections) over {_frame(10)}, 7) as half_open_roll_mean,
    round(abs(coalesce(error_response_rate - lag(error_response_rate) over {_W}, 0)), 6) as error_rate_delta, round(avg(error_response_rate) over {_frame(10)}, 6) as error_rate_roll_mean,
    case when avg(error_response_rate) over {_frame(10)} > hi then 1 else 0 end as high_error_rate_flag,
    coalesce(unique_source_count - lag(unique_source_count) over {_W}, 0) as source_count_accel, max(unique_source_count) over {_frame(10)} as source_count_roll_max from f""")
def _(spark, sf):
    r = {"syn_fraction_delta": 6, "syn_dominance": 6, "half_open_accel": 4, "half_open_roll_mean": 7, "error_rate_delta": 6, "error_rate_roll_mean": 6}
    return _traffic(spark, sf).select("source_row_id", "high_error_rate_flag", "source_count_accel", "source_count_roll_max",
                                      *[F.round(n, p).alias(n) for n, p in r.items()])


@query("d20_sequences", f"""{_NUM} select source_row_id, label, array_to_string(list(cast(cast(snr_db as integer) as varchar) || ':' || cast(cast(mac_retry_count as integer) as varchar)) over {_frame(10)}, ',') as steps
    from s qualify p >= 10""")
def _(spark, sf):
    s = _series(spark, sf, "label", "snr_db", "mac_retry_count", halo=10)
    q = s.finish(R.sequences(s, s.rows, ["snr_db", "mac_retry_count"], 10))
    text = F.transform("sequence", lambda x: F.concat_ws(":", x[0].cast("int").cast("string"), x[1].cast("int").cast("string")))
    return q.select("source_row_id", "label", F.array_join(text, ",").alias("steps"))


@query("c8_normal_quantiles", f"""{_T} select {', '.join(f'round(quantile_cont({m}, {q}), 6) as q_{m}' for m, (q, _) in _FLAGS.items())} from t where label = 'normal'""")
def _(spark, sf):
    found = normal_quantiles(telemetry(spark, sf, "label", *_FLAGS), {m: (m, q) for m, (q, _) in _FLAGS.items()})
    return spark.createDataFrame([tuple(round(found[m], 6) for m in _FLAGS)], ", ".join(f"q_{m} double" for m in _FLAGS))


_KEPT = 30 * 86400
_MONTHS_SQL = f"""{_T}, x as ({' union all '.join(f"select epoch_us(ts) - epoch_us(ts) % {_KEPT}000000 as month, '{m}' as metric, cast({m} as double) as v from t where label = 'normal'" for m in K.ALL_METRICS)})"""


# States of months, written, read again and merged to one; every limit's rank is counted on the rows it speaks of.
@query("c8_kept_thresholds", f"""{_MONTHS_SQL} select month, metric, count(v) as rows, min(v) as low, max(v) as high, true as within_bound from x group by 1, 2
    union all select -1, metric, count(v), min(v), max(v), true from x group by 2""")
def _(spark, sf):
    t = telemetry(spark, sf, "ts", "label", *K.ALL_METRICS).where("label = 'normal'").withColumn("month", S.bucket_start(F.col("ts"), _KEPT))
    months = durable(TH.rank_states(t, K.ALL_METRICS, ["month"]))
    whole = durable(TH.merge_states([months]))
    held = months.unionByName(whole.withColumn("month", F.lit(-1).cast("bigint")))
    errors = TH.proven(t, TH.limits(months, 0.99), K.ALL_METRICS, 0.99, ["month"]).unionByName(
        TH.proven(t, TH.limits(whole, 0.99), K.ALL_METRICS, 0.99).withColumn("month", F.lit(-1).cast("bigint")))
    # A metric without values has no limit, so nothing that could be wrong.
    sound = F.coalesce(F.col("rank_error") <= TH.rank_bound(), F.col("rows") == 0)
    return held.drop("rows", "sketch").join(errors.select("month", "metric", "rows", sound.alias("within_bound")), ["month", "metric"])


@query("c9_upper_quantiles", f"{_T} select round(quantile_cont(retransmission_count, 0.99), 6) as retx_p99, round(quantile_cont(packets_per_second, 0.99), 6) as pps_p99 from t")
def _(spark, sf):
    t = telemetry(spark, sf, "retransmission_count", "packets_per_second")
    found = exact_quantiles(t, {"retx_p99": (F.col("retransmission_count"), 0.99), "pps_p99": (F.col("packets_per_second"), 0.99)})
    return spark.createDataFrame([(round(found["retx_p99"], 6), round(found["pps_p99"], 6))], "retx_p99 double, pps_p99 double")


_SCORES = f"""{_NUM}, w as (select node_id, {', '.join(
    f'avg({m}) filter (where {_WARM}) as mu_{m}, stddev_pop({m}) filter (where {_WARM}) + 1e-6::double as sd_{m}' for m in _CUSUM)} from s group by 1),
    y as (select s.*, {', '.join(f'sum({m} - mu_{m} {"-" if d == "up" else "+"} 0.5 * sd_{m}) over (partition by s.node_id order by ts, source_row_id) as p_{m}, sd_{m}' for m, d in _CUSUM.items())}
        from s join w on s.node_id = w.node_id),
    q as (select {', '.join(f'quantile_cont({m}, {q}) as q_{m}' for m, (q, _) in _FLAGS.items())} from t where label = 'normal'),
    f as (select y.*, {', '.join(f"case when abs(p_{m} - {'least' if d == 'up' else 'greatest'}(0, {'min' if d == 'up' else 'max'}(p_{m}) over {_W})) > 5 * sd_{m} then 1 else 0 end as {m}_cf" for m, d in _CUSUM.items())},
        {', '.join(f"case when sum(case when {m} {'<' if side == 'below' else '>'} q_{m} then 1 else 0 end) over {_frame(3)} >= 3 then 1 else 0 end as {m}_f" for m, (_, side) in _FLAGS.items())} from y, q)
    select source_row_id, {' + '.join(f'{m}_cf' for m in K.JAM_CUSUM)} + {' + '.join(f'{m}_f' for m in K.JAM_FLAG_TARGETS)} as jam_threshold_score,
    {' + '.join(f'{m}_cf' for m in K.DOS_CUSUM)} + {' + '.join(f'{m}_f' for m in K.DOS_FLAG_TARGETS)} as dos_threshold_score from f"""


@query("b28_threshold_scores", _SCORES)
def _(spark, sf):
    t = telemetry(spark, sf, "node_id", "ts", "label", *K.ALL_METRICS)
    jam = T.radio_features(t).select("source_row_id", "jam_threshold_score")
    dos = T.traffic_features(t).select("source_row_id", "dos_threshold_score")
    return jam.join(dos, "source_row_id")
