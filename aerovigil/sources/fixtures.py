"""Telemetry and packet views derived from the generic test tables.

The mappings are plain SQL expressions, so the same definition serves Spark and the SQL oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ROW_KEY = ("concat_ws('|', cast(l_orderkey as string), cast(l_linenumber as string), "
            "cast(l_partkey as string), cast(l_suppkey as string), "
            "cast(cast(round(l_extendedprice * 100) as bigint) as string))")
_SPARK_ROW_ID = f"cast(conv(substring(md5({_ROW_KEY}), 1, 15), 16, 10) as bigint)"
_DUCK_ROW_ID = f"cast(('0x' || substring(md5({_ROW_KEY}), 1, 15)) as bigint)"

TELEMETRY = {
    "node_id": "concat('uav_', cast(l_suppkey as string))",
    "node_type": "'uav'",
    "ts": "l_shipdate",
    "label": "case l_returnflag when 'N' then 'normal' when 'A' then 'jamming' "
             "else case when l_linenumber >= 6 then 'ddos' else 'dos' end end",
    "collection_point": "case l_linestatus when 'F' then 'edge' else "
                        "case when l_linenumber >= 5 then 'edge_gcc' else 'gcc' end end",
    "rssi_dbm": "-40 - l_quantity",
    "snr_db": "35 - l_quantity",
    "sinr_db": "32 - l_quantity",
    "noise_floor_dbm": "-95 + 250 * (l_tax + 0.0)",
    "bit_error_rate": "l_tax * 5 + 0.0",
    "bad_packet_ratio": "l_discount + 0.0",
    "packet_delivery_ratio": "1 - l_discount",
    "mac_retry_count": "l_quantity + 0.0",
    "retransmission_count": "l_quantity * (1 + l_linenumber % 3)",
    "channel_occupancy_pct": "2 * l_quantity",
    "cca_failure_count": "cast(l_linenumber * 10 as double)",
    "backoff_count": "cast(l_partkey % 50 as double)",
    "packets_per_second": "l_extendedprice + 0.0",
    "bytes_per_second": "l_extendedprice * 500",
    "unique_source_count": "cast(l_partkey % 64 as double)",
    "src_ip_entropy": "cast(l_partkey % 90 as double) / 10",
    "dst_ip_entropy": "cast(l_orderkey % 70 as double) / 10",
    "icmp_packet_rate": "l_extendedprice * (l_tax + 0.0)",
    "connection_attempts_per_sec": "l_quantity * 40",
    "half_open_connections": "l_extendedprice * (l_discount + 0.0)",
    "tcp_retransmission_rate": "l_quantity * 3",
    "udp_packet_rate": "l_quantity * 100",
    "syn_packet_rate": "l_quantity * 25 * (l_linenumber % 4)",
    "fin_rst_rate": "l_quantity * 7",
    "port_scan_score": "cast(l_partkey % 100 as double)",
    "api_request_rate": "l_quantity * 20",
    "error_response_rate": "l_tax * 10 + 0.0",
    "command_frequency": "cast(l_linenumber * 5 as double)",
}

# Model scores and feature flags as later stages see them.
SCORES = {
    "jam_threshold_score": "l_linenumber % 5",
    "dos_threshold_score": "cast(l_partkey % 5 as int)",
    "noise_floor_drift_db": "(l_tax + 0.0) * 100",
    "packets_per_second_burst_index": "1 + (l_discount + 0.0) * 90",
    "noise_floor_drift_flag": "case when l_partkey % 9 = 0 then 1 else 0 end",
    "jamming_conf_attack": "case when l_returnflag = 'A' then 0.95 else l_quantity / 60 end + 0.0",
    "dos_conf_attack": "case when l_returnflag = 'R' then 0.9 else cast(l_partkey % 60 as double) / 100 end + 0.0",
    "hybrid_conf_attack": "cast(l_orderkey % 100 as double) / 100",
    "edge_alarm": "case when l_returnflag = 'A' and l_linenumber % 4 > 0 then 1 else 0 end",
    "gru_jam_flag": "case when l_returnflag = 'A' and l_partkey % 3 = 0 then 1 else 0 end",
    "jamming_ae_flag": "case when l_returnflag = 'A' and l_orderkey % 5 > 1 then 1 else 0 end",
    "dos_ae_flag": "case when l_returnflag = 'R' and l_orderkey % 4 > 0 then 1 else 0 end",
    "traffic_outlier": "case when l_returnflag = 'R' and l_partkey % 3 > 0 then 1 else 0 end",
    "coordinated_flood_flag": "case when l_partkey % 25 = 0 then 1 else 0 end",
    "cross_layer_attack_flag": "case when l_orderkey % 6 = 0 then 1 else 0 end",
    "cross_layer_anomaly_score": "cast(l_partkey % 77 as double) / 100",
    "swarm_consensus_anomaly_score": "cast(l_orderkey % 91 as double) / 100",
}

# Same rows with gaps, out-of-range values and inconsistent counts, before cleaning.
RAW_TELEMETRY = {
    **TELEMETRY,
    "snr_db": "case when l_partkey % 11 = 0 then null else 35 - l_quantity end",
    "rssi_dbm": "case when l_partkey % 13 = 0 then -150.0 - l_quantity else -40 - l_quantity end",
    "packets_per_second": "case when l_partkey % 17 = 0 then null when l_partkey % 19 = 0 "
                          "then l_extendedprice * 1000 else l_extendedprice end",
    "mac_retry_count": "case when l_partkey % 23 = 0 then null else l_quantity end",
    "cca_failure_count": "case when l_partkey % 101 = 0 then 2500.0 else l_linenumber * 10.0 end",
    "bit_error_rate": "case when l_partkey % 29 = 0 then 1.5 else l_tax * 5 + 0.0 end",
}

PACKETS = {
    "packet_id": "event_id",
    "node_id": "concat('uav_', lpad(cast(user_id % 10 + 1 as string), 3, '0'))",
    "ts": "ts",
    "ip_src": "cast(user_id as string)",
    "ip_dst": "regexp_extract(props, '([0-9]+)', 1)",
    "udp_dstport": "cast(event_id % 7 as string)",
    "frame_len": "value + 0.0",
    "ant_signal_dbm": "-40 - value / 10",
    "signal_dbm": "case when event_id % 9 = 0 then null else 30 - value / 20 end",
    "data_rate": "cast(event_id % 54 as double)",
    "retry": "cast(event_id % 3 as double)",
    "bad_fcs": "case when event_id % 8 = 0 then 1.0 else 0.0 end",
    "duration_us": "value * 10",
    "seq": "cast(event_id % 100 as double)",
    "ip_ttl": "case when event_id % 5 = 0 then null else cast(event_id % 64 as double) end",
    "ip_proto": "case when event_type = 'purchase' then 1.0 else 6.0 end",
    "arp": "case when event_id % 20 = 0 then 1.0 else 0.0 end",
    "udp_len": "case when event_type = 'view' then value else 0.0 end",
    "tcp_ack": "case when event_type = 'click' then 1.0 else 0.0 end",
    "ofdm": "case when event_id % 2 = 0 then 1.0 else 0.0 end",
    "cck": "case when event_type = 'signup' then 1.0 else 0.0 end",
    "iat_s": "cast(event_id % 10 as double) / 10",
    "protocol": "case event_type when 'signup' then 'TCP' when 'click' then 'tcp' when 'view' then 'UDP' "
                "when 'purchase' then 'icmp' else 'TCP' end",
    "tcp_flags": "case event_type when 'signup' then 'SYN' when 'click' then 'SYN,ACK' when 'error' then 'rst' "
                 "else '' end",
    "label_raw": "case event_type when 'error' then case when cast(regexp_extract(props, '([0-9]+)', 1) as int) "
                 "< 50 then 'UDP-Flood' else 'GPS Jamming' end when 'signup' then ' Normal' "
                 "when 'click' then 'benign' when 'view' then '' else "
                 "case when event_id % 40 = 0 then 'Evil Twin' else 'Background' end end",
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _view(df: DataFrame, mapping: dict[str, str], columns: list[str] | None) -> DataFrame:
    wanted = columns or list(mapping)
    return df.selectExpr(*[f"{mapping[c]} as {c}" for c in wanted])


def telemetry(spark: SparkSession, sf_dir: str, *columns: str, raw: bool = False,
              scores: bool = False) -> DataFrame:
    """One row per lineitem; unique ``source_row_id``; the named columns, or all."""
    mapping = {"source_row_id": _SPARK_ROW_ID, **(RAW_TELEMETRY if raw else TELEMETRY),
               **(SCORES if scores else {})}
    return _view(load(spark, sf_dir, "lineitem"), mapping, ["source_row_id", *columns] if columns else None)


def packets(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per event."""
    return _view(load(spark, sf_dir, "events"), PACKETS, list(columns) or None)


def telemetry_sql(raw: bool = False, scores: bool = False) -> str:
    """The telemetry view as one DuckDB select."""
    mapping = {"source_row_id": _DUCK_ROW_ID, **(RAW_TELEMETRY if raw else TELEMETRY),
               **(SCORES if scores else {})}
    return "select " + ", ".join(f"{e} as {n}" for n, e in mapping.items()) + " from lineitem"


def packets_sql() -> str:
    return "select " + ", ".join(f"{e} as {n}" for n, e in PACKETS.items()) + " from events"
