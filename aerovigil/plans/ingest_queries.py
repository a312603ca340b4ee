"""Queries over packets: labels, buckets, windows, entropies, tiers, per-packet context."""

from pyspark.sql import functions as F

from aerovigil.constants import JAM_METRICS
from aerovigil.functions import scalars as S
from aerovigil.operators import windows as W
from aerovigil.plans.registry import query
from aerovigil.sources.fixtures import packets, packets_sql, telemetry, telemetry_sql

HOURS_6 = 6 * 3600
_P = f"with packets as materialized ({packets_sql()})"
_T = f"with telemetry as materialized ({telemetry_sql()})"
# The label rules once more, as SQL.
_LABEL = """case replace(replace(lower(trim(label_raw)), ' ', '_'), '-', '_')
    when 'normal' then 'normal' when 'benign' then 'normal' when 'background' then 'normal' when '' then 'normal'
    when 'gps_jamming' then 'jamming' when 'udp_flood' then 'dos' else 'suspicious' end"""
_POINT = "case when label = 'jamming' then 'edge' when label in ('dos', 'ddos') then 'gcc' else 'edge_gcc' end"
_START = f"epoch_us(ts) - epoch_us(ts) % {HOURS_6}000000"
_LABELLED = f"""{_P}, labelled as (select *, {_LABEL} as label, {_START} as window_start from packets),
    pointed as (select *, {_POINT} as collection_point from labelled)"""
_WINDOW_LABEL = """{base}, cnt as (select node_id, window_start, count(*) n,
        count(*) filter (where label <> 'normal') bad from pointed group by all),
    attacks as (select node_id, window_start, label, row_number() over (partition by node_id, window_start
        order by count(*) desc, label) r from pointed where label <> 'normal' group by node_id, window_start, label),
    points as (select node_id, window_start, collection_point, row_number() over (partition by node_id, window_start
        order by count(*) desc, collection_point) r from pointed group by node_id, window_start, collection_point),
    labels as (select cnt.node_id, cnt.window_start, n, case when bad * 1.0 / n >= 0.2 then attacks.label
        else 'normal' end as label, points.collection_point from cnt
        left join attacks on cnt.node_id = attacks.node_id and cnt.window_start = attacks.window_start and attacks.r = 1
        join points on cnt.node_id = points.node_id and cnt.window_start = points.window_start and points.r = 1)
""".format(base=_LABELLED)


def _labelled(spark, sf, *columns):
    wanted = columns and ["node_id", "ts", "label_raw", *columns]
    p = packets(spark, sf, *wanted) if wanted else packets(spark, sf)
    return W.label_packets(p)


@query("b1_normalise_label", f"{_P} select label_raw, {_LABEL} as label, count(*) as packets from packets group by 1, 2")
def _(spark, sf):
    p = packets(spark, sf, "label_raw")
    return (p.select("label_raw", S.normalise_label(F.col("label_raw")).alias("label"))
            .groupBy("label_raw", "label").agg(F.count("*").alias("packets")))


@query("b2_labels_in_schema", f"""{_T}, p as ({_P[len('with packets as materialized '):]}) select
    (select bool_and(lower(label) in ('normal','jamming','dos','ddos','suspicious')) from telemetry) as telemetry_in_schema,
    (select bool_and(lower(trim(label_raw)) in ('normal','jamming','dos','ddos','suspicious')) from p) as packets_in_schema""")
def _(spark, sf):
    one = W.labels_in_schema(telemetry(spark, sf, "label"), "label").withColumnRenamed("in_schema", "telemetry_in_schema")
    return one.crossJoin(W.labels_in_schema(packets(spark, sf, "label_raw"), "label_raw").withColumnRenamed("in_schema", "packets_in_schema"))


@query("b5_b6_time_buckets", f"""{_P} select {_START} as window_start,
    strftime(make_timestamp({_START} + {HOURS_6}000000 // 2), '%Y-%m-%d %H:%M:%S') as middle, count(*) as packets
    from packets group by 1, 2""")
def _(spark, sf):
    p = packets(spark, sf, "ts")
    start = S.bucket_start(F.col("ts"), HOURS_6)
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    again = S.epoch_to_timestamp(seconds)
    return (p.withColumn("window_start", S.bucket_start(again, HOURS_6)).where(F.col("window_start") == start)
            .groupBy("window_start").agg(F.count("*").alias("packets"))
            .select("window_start", F.date_format(S.bucket_middle(F.col("window_start"), HOURS_6),
                                                  "yyyy-MM-dd HH:mm:ss").alias("middle"), "packets"))


@query("b7_collection_point", f"{_LABELLED} select label, collection_point, count(*) as packets from pointed group by 1, 2")
def _(spark, sf):
    return _labelled(spark, sf, "packet_id").groupBy("label", "collection_point").agg(F.count("*").alias("packets"))


@query("b8_tier_split", f"""{_T} select 'edge' as tier, label, count(*) as n from telemetry
    where collection_point in ('edge','edge_gcc') group by 2 union all
    select 'gateway', label, count(*) from telemetry where collection_point in ('gcc','edge_gcc') group by 2""")
def _(spark, sf):
    edge, gateway = W.split_tiers(telemetry(spark, sf, "label", "collection_point"))
    return (edge.withColumn("tier", F.lit("edge")).unionByName(gateway.withColumn("tier", F.lit("gateway")))
            .groupBy("tier", "label").agg(F.count("*").alias("n")))


@query("b11_packet_samples", f"""{_P} select packet_id, round(ant_signal_dbm, 6) as rssi_dbm,
    round(coalesce(signal_dbm, 0), 6) as snr_db, round(ant_signal_dbm - coalesce(signal_dbm, 0), 6) as noise_floor_dbm,
    1 - bad_fcs as packet_delivery_ratio, round(least(greatest(duration_us / 1000, 0), 100), 6) as channel_occupancy_pct,
    coalesce(ip_ttl, 0) as ip_ttl, case when udp_len > 0 then 1.0 else 0.0 end::double as is_udp, tcp_ack as is_tcp,
    case when ip_proto = 1 then 1.0 else 0.0 end::double as is_icmp from packets""")
def _(spark, sf):
    s = W.packet_samples(packets(spark, sf))
    return s.select("packet_id", *[F.round(c, 6).alias(c) for c in (
        "rssi_dbm", "snr_db", "noise_floor_dbm", "packet_delivery_ratio", "channel_occupancy_pct",
        "ip_ttl", "is_udp", "is_tcp", "is_icmp")])


def _entropy_sql(field, value, alias):
    return f"""{alias} as (select node_id, window_start, -sum(p * log2(p)) as h, count(*) filter (where v is not null) as dv
        from (select node_id, window_start, {value} as v, count(*) * 1.0 /
        sum(count(*)) over (partition by node_id, window_start) as p from pointed group by 1, 2, 3) group by 1, 2)"""


_C1_SQL = _WINDOW_LABEL + f""",
    {_entropy_sql('ip_src', "coalesce(ip_src, '0.0.0.0')", 'es')}, {_entropy_sql('ip_dst', "coalesce(ip_dst, '0.0.0.0')", 'ed')},
    {_entropy_sql('udp_dstport', "coalesce(udp_dstport, '0')", 'ep')},
    m as (select node_id, window_start, count(*) n,
        case when count(*) > 1 then greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1e-6) else 1.0 end as d,
        avg(ant_signal_dbm) rssi, coalesce(avg(signal_dbm), 0) snr, sum(retry) retries, avg(bad_fcs) bad,
        sum(duration_us) air, sum(frame_len) bytes, avg(frame_len) mean_len, coalesce(avg(ip_ttl), 64) ttl,
        coalesce(stddev_samp(ip_ttl), 0) ttl_sd, coalesce(stddev_samp(ant_signal_dbm), 0) rssi_sd,
        coalesce(stddev_samp(seq), 0) seq_sd, avg(iat_s) iat, coalesce(stddev_samp(iat_s), 0) iat_sd, avg(arp) arp,
        avg(data_rate) rate, count(*) filter (where udp_len > 0) udp, count(*) filter (where tcp_ack > 0) tcp,
        count(*) filter (where ip_proto = 1) icmp, avg(ofdm) ofdm, avg(cck) cck, count(distinct ip_src) src
        from pointed group by 1, 2)
    select m.node_id, m.window_start // {HOURS_6}000000 as window_id, labels.label, labels.collection_point,
        strftime(make_timestamp(m.window_start + {HOURS_6}000000 // 2), '%Y-%m-%d %H:%M:%S') as mid,
        round(rssi, 8) as rssi_dbm, round(snr, 8) as snr_db, round(snr, 8) as sinr_db,
        round(case when snr <> 0 then rssi - snr else -90 end, 8) as noise_floor_dbm, round(bad, 8) as bit_error_rate,
        round(bad, 8) as bad_packet_ratio, round(1 - bad, 8) as packet_delivery_ratio, retries as mac_retry_count,
        retries as retransmission_count, round(least(air / (d * 1e6 + 1e-9), 1) * 100, 6) as channel_occupancy_pct,
        case when bad > 0.1 then retries else 0 end as cca_failure_count, round(seq_sd, 6) as backoff_count,
        round(m.n / d, 6) as packets_per_second, round(bytes / d, 4) as bytes_per_second,
        src::double as unique_source_count, round(es.h, 6) + 0.0 as src_ip_entropy, round(ed.h, 6) + 0.0 as dst_ip_entropy,
        round(icmp / d, 6) as icmp_packet_rate, round(tcp / d, 6) as connection_attempts_per_sec,
        round(tcp / d / (m.n / d + 1e-9) * m.n, 4) as half_open_connections,
        round(case when bad > 0.05 then tcp / d else 0 end, 6) as tcp_retransmission_rate,
        round(udp / d, 6) as udp_packet_rate, round(tcp / d, 6) as syn_packet_rate, round(ep.h, 6) + 0.0 as port_scan_score,
        round(rssi_sd, 6) as rssi_dbm_std, round(rate, 8) as data_rate_mbps, round(mean_len, 8) as mean_packet_size_bytes,
        round(ttl, 8) as ip_ttl_mean, round(ttl_sd, 6) as ip_ttl_std, round(iat, 8) as iat_mean_s,
        round(iat_sd, 6) as iat_std_s, round(arp, 8) as arp_ratio,
        case when ofdm > 0 then 1.0 else 0.0 end::double as modulation_ofdm_flag,
        case when cck > 0 then 1.0 else 0.0 end::double as modulation_cck_flag
    from m join labels on m.node_id = labels.node_id and m.window_start = labels.window_start
        join es on m.node_id = es.node_id and m.window_start = es.window_start
        join ed on m.node_id = ed.node_id and m.window_start = ed.window_start
        join ep on m.node_id = ep.node_id and m.window_start = ep.window_start"""
_EIGHT = ("rssi_dbm", "snr_db", "sinr_db", "noise_floor_dbm", "mean_packet_size_bytes", "bit_error_rate",
          "bad_packet_ratio", "packet_delivery_ratio", "data_rate_mbps", "ip_ttl_mean", "iat_mean_s", "arp_ratio")


@query("c1_packet_windows", _C1_SQL)
def _(spark, sf):
    w = W.packet_windows(_labelled(spark, sf), HOURS_6)
    skip = ("source_row_id", "node_id", "node_type", "ts", "window_id", "label", "collection_point")
    return w.select("node_id", "window_id", "label", "collection_point",
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("mid"),
                    *[(F.round(c, 8 if c in _EIGHT else 4 if c in ("half_open_connections", "bytes_per_second") else 6) + 0.0).alias(c)
                      for c in w.columns if c not in skip])


@query("c2_entropy", f"""{_LABELLED}, {_entropy_sql('ip_src', 'ip_src', 'es')}, {_entropy_sql('ip_dst', 'ip_dst', 'ed')}
    select es.node_id, es.window_start, round(es.h, 6) + 0.0 as src_entropy, round(ed.h, 6) + 0.0 as dst_entropy
    from es join ed on es.node_id = ed.node_id and es.window_start = ed.window_start""")
def _(spark, sf):
    p = packets(spark, sf, "node_id", "ts", "ip_src", "ip_dst")
    keyed = p.withColumn("window_start", S.bucket_start(F.col("ts"), HOURS_6))
    e = W.value_entropy(keyed, ["node_id", "window_start"], {"ip_src": None, "ip_dst": None})
    return e.select("node_id", "window_start", (F.round("ip_src_entropy", 6) + 0.0).alias("src_entropy"),
                    (F.round("ip_dst_entropy", 6) + 0.0).alias("dst_entropy"))


@query("c3_window_label", _WINDOW_LABEL + " select node_id, window_start, n as packets, label from labels")
def _(spark, sf):
    p = _labelled(spark, sf, "packet_id")
    return W.label_windows(p, HOURS_6).select("node_id", "window_start", "packets", "label")


@query("c4_modal_collection_point", _WINDOW_LABEL + " select node_id, window_start, collection_point from labels")
def _(spark, sf):
    p = _labelled(spark, sf, "packet_id")
    return W.label_windows(p, HOURS_6).select("node_id", "window_start", "collection_point")


@query("c5_distinct_sources", f"""{_LABELLED} select node_id, window_start, count(distinct ip_src) as sources
    from pointed group by 1, 2""")
def _(spark, sf):
    p = packets(spark, sf, "node_id", "ts", "ip_src")
    keyed = p.withColumn("window_start", S.bucket_start(F.col("ts"), HOURS_6))
    return keyed.groupBy("node_id", "window_start").agg(F.count_distinct("ip_src").alias("sources"))


@query("c6_edge_windows", f"""{_T} select node_id, epoch_us(ts) - epoch_us(ts) % 2592000000000 as window_start,
    {', '.join(f'round(avg({m}), 8) as {m}' for m in JAM_METRICS)}, count(packets_per_second) * 0 as dos_values
    from telemetry group by 1, 2""")
def _(spark, sf):
    w = W.edge_windows(telemetry(spark, sf, "node_id", "ts", *JAM_METRICS), 30 * 86400)
    return w.select("node_id", "window_start", *[F.round(m, 8).alias(m) for m in JAM_METRICS],
                    F.when(F.col("packets_per_second").isNull(), 0).otherwise(1).cast("bigint").alias("dos_values"))


@query("c7_gateway_windows", f"""{_LABELLED}, g as (select window_start, count(*) n, sum(frame_len) bytes,
    count(distinct ip_src) src, count(*) filter (where upper(protocol) = 'ICMP') icmp,
    count(*) filter (where upper(protocol) = 'UDP') udp,
    count(*) filter (where contains(upper(tcp_flags), 'SYN') and not contains(upper(tcp_flags), 'ACK')) syn,
    count(*) filter (where contains(upper(tcp_flags), 'RST') or contains(upper(tcp_flags), 'FIN')) fin
    from pointed group by 1),
    s as (select window_start, -sum(p * log2(p)) h from (select window_start, ip_src, count(*) * 1.0 /
        sum(count(*)) over (partition by window_start) p from pointed group by 1, 2) group by 1),
    t as (select window_start, -sum(p * log2(p)) h from (select window_start, ip_dst, count(*) * 1.0 /
        sum(count(*)) over (partition by window_start) p from pointed group by 1, 2) group by 1)
    select 'gcc_001' as node_id, g.window_start, n::double as packets_per_second, round(bytes, 4) as bytes_per_second,
        src::double as unique_source_count, round(s.h, 6) + 0.0 as src_ip_entropy, round(t.h, 6) + 0.0 as dst_ip_entropy,
        icmp::double as icmp_packet_rate, syn::double as connection_attempts_per_sec, 0.0::double as half_open_connections,
        udp::double as udp_packet_rate, syn::double as syn_packet_rate, fin::double as fin_rst_rate
    from g join s on g.window_start = s.window_start join t on g.window_start = t.window_start""")
def _(spark, sf):
    w = W.gateway_windows(packets(spark, sf, "ts", "ip_src", "ip_dst", "protocol", "tcp_flags", "frame_len"), HOURS_6)
    return w.select("node_id", "window_start", "packets_per_second", F.round("bytes_per_second", 4).alias("bytes_per_second"),
                    "unique_source_count", (F.round("src_ip_entropy", 6) + 0.0).alias("src_ip_entropy"),
                    (F.round("dst_ip_entropy", 6) + 0.0).alias("dst_ip_entropy"), "icmp_packet_rate",
                    "connection_attempts_per_sec", "half_open_connections", "udp_packet_rate", "syn_packet_rate",
                    "fin_rst_rate")


@query("c13_label_distribution", f"{_T} select label, count(*) as n, round(count(*) * 1.0 / sum(count(*)) over (), 6) as share from telemetry group by 1")
def _(spark, sf):
    t = telemetry(spark, sf, "label").groupBy("label").agg(F.count("*").alias("n"))
    rows = t.agg(F.sum("n").alias("all_rows"))
    return t.crossJoin(F.broadcast(rows)).select("label", "n", F.round(F.col("n") / F.col("all_rows"), 6).alias("share"))
