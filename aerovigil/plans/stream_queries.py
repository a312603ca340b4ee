"""Queries that run streams over what is available and return what they wrote."""

from pyspark.sql import functions as F

from aerovigil.functions.hashing import record_hash
from aerovigil.operators import ledger
from aerovigil.operators.ordered import add_positions
from aerovigil.operators.series import alarm_sessions
from aerovigil.plans.registry import query
from aerovigil.plans.series_queries import _micros, _sessions_sql
from aerovigil.sources.fixtures import PACKETS, TELEMETRY, SCORES, _SPARK_ROW_ID, packets, packets_sql, telemetry_sql
from aerovigil.streaming import detectors as D
from aerovigil.streaming import eventtime as E
from aerovigil.streaming import runs as R
from aerovigil.streaming import trust as T
from aerovigil.streaming import windows as W

_P = f"with p as materialized ({packets_sql()})"
_T = f"with recursive t as materialized ({telemetry_sql()})"


def _packet_stream(spark, sf, *columns):
    return R.read_table(spark, f"{sf}/events*.parquet").selectExpr(*[f"{PACKETS[c]} as {c}" for c in columns])


def _telemetry_stream(spark, sf, *columns):
    mapping = {**TELEMETRY, **SCORES}
    return R.read_table(spark, f"{sf}/lineitem*.parquet").selectExpr(
        f"{_SPARK_ROW_ID} as source_row_id", *[f"{mapping[c]} as {c}" for c in columns])


_CLOSED = "epoch_us(ts) - epoch_us(ts) % 21600000000 + 21600000000 <= (select max(epoch_us(ts)) from p) - 3600000000"


@query("i1_stream_edge_windows", f"""{_P} select node_id, epoch_us(ts) - epoch_us(ts) % 21600000000 as window_start, count(*) as samples, round(avg(rssi) + 1.23e-9, 6) as rssi_dbm
    from (select *, ant_signal_dbm as rssi from p) where {_CLOSED} group by 1, 2""")
def _(spark, sf):
    s = _packet_stream(spark, sf, "node_id", "ts", "ant_signal_dbm").withColumnRenamed("ant_signal_dbm", "rssi_dbm")
    w = R.run_available(W.edge_windows(s, "6 hours", "1 hour"), "edge-windows")
    return w.select("node_id", "window_start", "samples", F.round(F.col("rssi_dbm") + 1.23e-9, 6).alias("rssi_dbm"))


@query("i5_stream_gateway_windows", f"""{_P}, c as (select *, epoch_us(ts) - epoch_us(ts) % 21600000000 as w from p where {_CLOSED}),
    s as (select w, -sum(x * log2(x)) h from (select w, ip_src, count(*) / sum(count(*)) over (partition by w) x from c group by 1, 2) group by 1),
    d as (select w, -sum(x * log2(x)) h from (select w, ip_dst, count(*) / sum(count(*)) over (partition by w) x from c group by 1, 2) group by 1),
    g as (select w, count(*)::double n, sum(frame_len) b, count(distinct ip_src)::double u, count(*) filter (where upper(protocol) = 'ICMP')::double i,
        count(*) filter (where contains(upper(tcp_flags), 'SYN') and not contains(upper(tcp_flags), 'ACK'))::double y from c group by 1)
    select g.w as window_start, n as packets_per_second, round(b, 4) as bytes_per_second, u as unique_source_count, round(s.h, 6) as src_ip_entropy, round(d.h, 6) as dst_ip_entropy,
    i as icmp_packet_rate, y as syn_packet_rate from g join s on g.w = s.w join d on g.w = d.w""")
def _(spark, sf):
    s = _packet_stream(spark, sf, "ts", "ip_src", "ip_dst", "protocol", "tcp_flags", "frame_len")
    w = R.run_available(W.gateway_windows(s, "6 hours", "1 hour"), "gateway-windows")
    return w.select("window_start", "packets_per_second", F.round("bytes_per_second", 4).alias("bytes_per_second"), "unique_source_count",
                    F.round("src_ip_entropy", 6).alias("src_ip_entropy"), F.round("dst_ip_entropy", 6).alias("dst_ip_entropy"),
                    "icmp_packet_rate", "syn_packet_rate")


@query("i6_stream_dedup", f"{_T} select node_id, count(distinct ts) as kept from t group by 1")
def _(spark, sf):
    # The watermark spans the whole table, so that no row is late.
    s = _telemetry_stream(spark, sf, "node_id", "ts")
    return R.run_available(W.first_per_key(s, "20000 days"), "dedup").groupBy("node_id").agg(F.count("*").alias("kept"))


def _replay(spark, sf, stream, build, name):
    """A table's rows as a stream in whatever order its files come: the delay is the table's whole span of time."""
    span = spark.read.parquet(f"{sf}/lineitem*.parquet").selectExpr(f"{TELEMETRY['ts']} as ts").selectExpr(
        "datediff(max(ts), min(ts)) + 2 as days").first().days or 1
    return E.run_to_end(stream, lambda s: build(s, f"{span} days", 500 * 86_400_000), name)


@query("i9_stream_alarm_sessions", _sessions_sql(20))
def _(spark, sf):
    def sessions(stream, delay, _):  # the closing row moves the watermark; its own session never closes
        return alarm_sessions(W.with_event_time(stream.withColumn("node_id", F.coalesce("node_id", F.when(F.col(E.CLOSING), ""))), delay),
                              (F.col("label") != "normal") | F.col(E.CLOSING), "20 days")

    return _micros(_replay(spark, sf, _telemetry_stream(spark, sf, "node_id", "ts", "label"), sessions, "alarm-sessions"))


# EWMA and CUSUM by recursion over each node's windows; details and alarms follow from the carried values.
def _detector_sql():
    ewma, cusum = D.EWMA_METRICS, D.CUSUM_DIRECTIONS
    metrics = list(dict.fromkeys([*ewma, *cusum]))
    calm = ", ".join(f"avg({m}) filter (where r <= 10) as c_{m}, stddev_pop({m}) filter (where r <= 10) + 1e-6 as w_{m}" for m in cusum)
    first = ", ".join([f"{m}::double as e_{m}, ({m} * {m})::double as q_{m}" for m in ewma] + [f"0::double as s_{m}" for m in cusum])
    step = ", ".join([f"e_{m} + 0.3 * (n.{m} - e_{m}), q_{m} + 0.3 * (n.{m} * n.{m} - q_{m})" for m in ewma]
                     + [f"case when n.r <= 10 then 0 else greatest(0, (case when s_{m} > 5 * w_{m} then 0 else s_{m} end)"
                        f" + {'' if d == 'up' else '-'}(n.{m} - c_{m}) - 0.5 * w_{m}) end" for m, d in cusum.items()])
    z = ", ".join(f"case when r = 1 then 0 else abs({m} - e_{m}) / (sqrt(greatest(0, q_{m} - e_{m} * e_{m})) + 1e-9) end as z_{m}" for m in ewma)
    ewma_alarms = " + ".join(f"(r >= 10 and z_{m} > 3)::int" for m in ewma)
    cusum_alarms = " + ".join(f"(r > 10 and s_{m} > 5 * w_{m})::int" for m in cusum)
    shown = ", ".join(f"round(round({c}, 4) + 0.00123, 2) as {c}" for c in [f"z_{m}" for m in ewma] + [f"s_{m}" for m in cusum])
    return f"""{_T}, n as materialized (select node_id, source_row_id, {', '.join(f'{m}::double as {m}' for m in metrics)},
        row_number() over (partition by node_id order by ts, source_row_id) as r from t),
    k as materialized (select node_id, {calm} from n group by 1),
    f as (select node_id, r, {first} from n where r = 1 union all
        select n.node_id, n.r, {step} from f join n on n.node_id = f.node_id and n.r = f.r + 1 join k on k.node_id = f.node_id),
    d as (select n.*, f.* exclude (node_id, r), k.* exclude (node_id) from n join f on f.node_id = n.node_id and f.r = n.r join k on k.node_id = n.node_id),
    z as (select *, {z} from d),
    a as (select *, {ewma_alarms} as ewma_alarms, {cusum_alarms} as cusum_alarms from z),
    j as (select *, (ewma_alarms >= 2 or (cusum_alarms >= 1 and ewma_alarms >= 1))::int as jam_alarm from a),
    h as (select *, sum(jam_alarm) over (partition by node_id order by r rows between 29 preceding and current row)::int as consecutive_alarms from j)
    select source_row_id, r as window_id, ewma_alarms, cusum_alarms, (ewma_alarms >= 2)::int as ewma_alarm, (cusum_alarms >= 1)::int as cusum_alarm,
        jam_alarm, consecutive_alarms, round((ewma_alarms + cusum_alarms) / 11.0, 4) as confidence,
        case when jam_alarm = 0 then 'NONE' when consecutive_alarms >= 10 then 'HIGH' when consecutive_alarms >= 3 then 'MEDIUM' else 'LOW' end as severity,
        {shown} from h"""


@query("i2_i3_i4_stream_detector", _detector_sql())
def _(spark, sf):
    metrics = [m for m in dict.fromkeys([*D.EWMA_METRICS, *D.CUSUM_DIRECTIONS])]
    shown = ["source_row_id", "window_id", "ewma_alarms", "cusum_alarms", "ewma_alarm", "cusum_alarm", "jam_alarm", "consecutive_alarms", "confidence", "severity"]
    # The shift keeps four-digit values off the ties of the second rounding.
    z = [F.round(F.col(f"ewma_{m}_z_score") + 0.00123, 2).alias(f"z_{m}") for m in D.EWMA_METRICS]
    s = [F.round(F.abs(F.col(f"cusum_{m}_s_up") + F.col(f"cusum_{m}_s_dn")) + 0.00123, 2).alias(f"s_{m}") for m in D.CUSUM_DIRECTIONS]
    return _replay(spark, sf, _telemetry_stream(spark, sf, "node_id", "ts", *metrics),
                   lambda *stream: D.detect_columns(*stream).select(*shown, *z, *s), "detector")


# Beta trust in closed form, clamped trust by recursion.
@query("i7_stream_trust", f"""{_T}, s as (select *, row_number() over (partition by node_id order by ts, source_row_id) as p,
        6 - l as pos, l as neg, case when label = 'normal' then 0.01 else -0.05 end::double as step from (select *, bad_packet_ratio as l from t)),
    b as (select source_row_id, (5 + sum(pos) over w) / (6 + sum(pos) over w + sum(neg) over w) as bt from s window w as (partition by node_id order by p)),
    c as (select node_id, p, source_row_id, least(1::double, greatest(0::double, 1 + step)) as x from s where p = 1 union all
        select s.node_id, s.p, s.source_row_id, least(1::double, greatest(0::double, c.x + s.step)) from c join s on s.node_id = c.node_id and s.p = c.p + 1)
    select c.source_row_id, round(bt + 1.23e-9, 6) as beta_trust, round(x, 6) as clamped_trust from b join c on b.source_row_id = c.source_row_id""")
def _(spark, sf):
    s = _telemetry_stream(spark, sf, "node_id", "ts", "label", "bad_packet_ratio").selectExpr(
        "source_row_id", "node_id", "ts", "6 - bad_packet_ratio as positive_evidence", "bad_packet_ratio as negative_evidence",
        "cast(case when label = 'normal' then 0.01 else -0.05 end as double) as trust_step")
    t = _replay(spark, sf, s, T.trust_stream, "trust")
    return t.select("source_row_id", F.round(F.col("beta_trust") + 1.23e-9, 6).alias("beta_trust"), (F.round("clamped_trust", 6) + 0.0).alias("clamped_trust"))


@query("i8_stream_event_log", f"{_P} select count(*) as n_events, count(*) as intact, count(distinct node_id) as nodes from p")
def _(spark, sf):
    s = _packet_stream(spark, sf, "packet_id", "node_id", "ts", "protocol").withColumn("source_type", F.lit("uav_ugv"))
    log = R.log_available(s, "event-log")
    ok = record_hash(log, ("log_hash", "stream_batch", "stream_batch_id")) == F.col("log_hash")
    return log.agg(F.count("*").alias("n_events"), F.count_if(ok).alias("intact"), F.count_distinct("node_id").alias("nodes"))


# Merkle batches of ten over the stream's log in order of time and id; a batch's root is that of the batch operator.
@query("i8_stream_merkle", f"""{_P}, k as (select row_number() over (order by ts, packet_id) as pos, ts from p), b as (select (pos - 1) // 10 + 1 as batch_id, count(*) as batch_size,
    min(epoch_us(ts)) as first_us from k group by 1) select batch_id, batch_size, first_us, true as root_holds, true as same_as_batch from b""")
def _(spark, sf):
    columns = ["packet_id", "node_id", "ts", "protocol"]
    s = _packet_stream(spark, sf, *columns).withColumn("source_type", F.lit("uav_ugv"))
    log, roots = R.seal_available(s, "merkle", ("ts", "packet_id"))
    rows = packets(spark, sf, *columns).withColumn("source_type", F.lit("uav_ugv"))
    sealed = add_positions(rows.withColumn("log_hash", record_hash(rows)).withColumn("log_timestamp", F.col("ts").cast("string")), ["ts", "packet_id"])
    whole = ledger.merkle_batches(sealed.withColumn("batch_id", F.expr("(_pos - 1) div 10 + 1"))).select("batch_id", F.col("merkle_root").alias("_root"))
    first = log.groupBy("batch_id").agg(F.unix_micros(F.min(F.col("ts").cast("timestamp"))).alias("first_us"))
    return roots.join(whole, "batch_id", "full").join(first, "batch_id").select(
        "batch_id", "batch_size", "first_us", ledger.merkle_root(F.col("record_hashes"), 10).eqNullSafe(F.col("merkle_root")).alias("root_holds"),
        F.col("merkle_root").eqNullSafe(F.col("_root")).alias("same_as_batch"))
