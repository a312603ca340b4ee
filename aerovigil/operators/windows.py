"""Packets to per-node time windows: rates, entropies, distinct sources, window labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerovigil.constants import DOS_METRICS, JAM_METRICS, LABEL_CODES, PACKET_WINDOW_BOUNDS, SCHEMA_LABELS
from aerovigil.functions import scalars as S

_LABELS = sorted([*LABEL_CODES, "suspicious"])
_POINTS = ["edge", "edge_gcc", "gcc"]


def stable_id(*columns: Column) -> Column:
    """A 60-bit row id from the key of the row."""
    text = F.concat_ws("|", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def value_entropy(df: DataFrame, keys: list[str], columns: dict[str, str | None]) -> DataFrame:
    """Shannon entropy (bits) and distinct non-null values per group, for several columns at once.

    ``columns`` maps a column to the value that stands for null, or None to leave nulls out. Values
    are counted per (group, column, value) first, so a group's values are never gathered.
    """
    pairs = [F.struct(F.lit(c).alias("field"),
                      (F.col(c) if null is None else F.coalesce(F.col(c), F.lit(null))).alias("value"),
                      F.col(c).isNotNull().alias("known"))
             for c, null in columns.items()]
    counts = (df.select(*keys, F.explode(F.array(*pairs)).alias("p"))
              .where(F.col("p.value").isNotNull())
              .groupBy(*keys, "p.field", "p.value")
              .agg(F.count("*").alias("n"), F.max(F.col("p.known").cast("int")).alias("known")))
    aggs = []
    for c in columns:
        n = F.when(F.col("field") == c, F.col("n"))
        aggs += [F.sum(n).alias(f"_n_{c}"), F.sum(n * F.log2(n)).alias(f"_nlogn_{c}"),
                 F.sum(F.when(F.col("field") == c, F.col("known"))).alias(f"{c}_distinct")]
    sums = counts.groupBy(*keys).agg(*aggs)
    return sums.select(*keys, *[
        F.coalesce(F.log2(F.col(f"_n_{c}")) - F.col(f"_nlogn_{c}") / F.col(f"_n_{c}"), F.lit(0.0))
        .alias(f"{c}_entropy") for c in columns],
        *[F.coalesce(F.col(f"{c}_distinct"), F.lit(0)).alias(f"{c}_distinct") for c in columns])


def most_frequent(counts: list[tuple[str, Column]]) -> Column:
    """Name with the highest count; the earlier name wins a tie."""
    entries = [F.struct(n.alias("n"), F.lit(-i).alias("rank"), F.lit(name).alias("name"))
               for i, (name, n) in enumerate(counts)]
    return F.array_max(F.array(*entries))["name"]


def attack_label(attack_share: float, counts: dict[str, Column], rows: Column) -> Column:
    """The most frequent attack label once attacks reach ``attack_share`` of the rows."""
    attacks = [(name, counts[name]) for name in sorted(counts) if name != "normal"]
    share = (rows - counts["normal"]) / rows
    return F.when(share >= attack_share, most_frequent(attacks)).otherwise(F.lit("normal"))


def label_windows(packets: DataFrame, seconds: float = 1.0, attack_share: float = 0.20) -> DataFrame:
    """Window label, modal collection point and packet count; ``packets`` carries ``label``."""
    keyed = packets.withColumn("window_start", S.bucket_start(F.col("ts"), seconds))
    grouped = keyed.groupBy("node_id", "window_start").agg(F.count("*").alias("packets"), *_label_counts())
    return grouped.select("node_id", "window_start", "packets", *_label_outputs(attack_share, F.col("packets")))


def _label_counts() -> list[Column]:
    return [F.count_if(F.col("label") == name).alias(f"_n_{name}") for name in _LABELS]


def _label_outputs(attack_share: float, rows: Column) -> list[Column]:
    counts = {name: F.col(f"_n_{name}") for name in _LABELS}
    edge, gcc = counts["jamming"], counts["dos"] + counts["ddos"]
    points = [("edge", edge), ("edge_gcc", rows - edge - gcc), ("gcc", gcc)]
    return [attack_label(attack_share, counts, rows).alias("label"),
            most_frequent(points).alias("collection_point")]


def packet_windows(packets: DataFrame, seconds: float = 1.0, attack_share: float = 0.20) -> DataFrame:
    """All window metrics of a wireless capture, one row per (node, window)."""
    keyed = packets.withColumn("window_start", S.bucket_start(F.col("ts"), seconds))
    num = lambda c: S.to_number(S.with_default(packets, c, None), None)
    zero = lambda c: S.to_number(S.with_default(packets, c, 0.0))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    keys = ["node_id", "window_start"]
    base = keyed.groupBy(*keys).agg(
        F.count("*").alias("n"),
        ((F.max(micros) - F.min(micros)) / 1e6).alias("span"),
        F.avg(num("ant_signal_dbm")).alias("rssi"), F.stddev_samp(num("ant_signal_dbm")).alias("rssi_sd"),
        F.avg(num("signal_dbm")).alias("snr"), F.avg(num("data_rate")).alias("rate"),
        F.sum(zero("retry")).alias("retries"), F.avg(zero("bad_fcs")).alias("bad"),
        F.sum(zero("duration_us")).alias("airtime"),
        F.sum(num("frame_len")).alias("total_bytes"), F.avg(num("frame_len")).alias("mean_len"),
        F.avg(num("ip_ttl")).alias("ttl"), F.stddev_samp(num("ip_ttl")).alias("ttl_sd"),
        F.avg(zero("arp")).alias("arp_share"), F.count_if(zero("udp_len") > 0).alias("udp_n"),
        F.count_if(zero("tcp_ack") > 0).alias("tcp_n"), F.count_if(zero("ip_proto") == 1).alias("icmp_n"),
        F.avg(num("iat_s")).alias("iat"), F.stddev_samp(num("iat_s")).alias("iat_sd"),
        F.stddev_samp(num("seq")).alias("seq_sd"),
        F.avg(zero("ofdm")).alias("ofdm_share"), F.avg(zero("cck")).alias("cck_share"),
        *_label_counts())
    spread = value_entropy(keyed, keys, {"ip_src": "0.0.0.0", "ip_dst": "0.0.0.0", "udp_dstport": "0"})
    col = F.col
    duration = F.when(col("n") > 1, F.greatest(col("span"), F.lit(1e-6))).otherwise(F.lit(1.0))
    d = base.join(spread, keys).withColumn("d", duration)
    or_value = lambda c, v: F.coalesce(col(c), F.lit(float(v)))
    tcp_rate, pps = col("tcp_n") / col("d"), col("n") / col("d")
    snr, rssi = or_value("snr", 0), or_value("rssi", -90)
    out = {
        "rssi_dbm": rssi, "snr_db": snr, "sinr_db": snr,
        "noise_floor_dbm": F.when(snr != 0, rssi - snr).otherwise(F.lit(-90.0)),
        "bit_error_rate": col("bad"), "bad_packet_ratio": col("bad"),
        "packet_delivery_ratio": 1.0 - col("bad"), "mac_retry_count": col("retries"),
        "retransmission_count": col("retries"),
        "channel_occupancy_pct": F.least(col("airtime") / (col("d") * 1e6 + S.EPS), F.lit(1.0)) * 100.0,
        "cca_failure_count": col("retries") * S.as_double(col("bad") > 0.1),
        "backoff_count": or_value("seq_sd", 0),
        "packets_per_second": pps, "bytes_per_second": or_value("total_bytes", 0) / col("d"),
        "unique_source_count": col("ip_src_distinct").cast("double"),
        "src_ip_entropy": col("ip_src_entropy"), "dst_ip_entropy": col("ip_dst_entropy"),
        "icmp_packet_rate": col("icmp_n") / col("d"), "connection_attempts_per_sec": tcp_rate,
        "half_open_connections": tcp_rate / (pps + S.EPS) * col("n"),
        "tcp_retransmission_rate": tcp_rate * S.as_double(col("bad") > 0.05),
        "udp_packet_rate": col("udp_n") / col("d"), "syn_packet_rate": tcp_rate,
        "port_scan_score": col("udp_dstport_entropy"),
        "rssi_dbm_std": or_value("rssi_sd", 0), "data_rate_mbps": or_value("rate", 0),
        "mean_packet_size_bytes": or_value("mean_len", 0), "ip_ttl_mean": or_value("ttl", 64),
        "ip_ttl_std": or_value("ttl_sd", 0), "iat_mean_s": or_value("iat", 0),
        "iat_std_s": or_value("iat_sd", 0), "arp_ratio": col("arp_share"),
        "modulation_ofdm_flag": S.as_double(col("ofdm_share") > 0),
        "modulation_cck_flag": S.as_double(col("cck_share") > 0),
    }
    bounded = {k: (S.clip(v, *PACKET_WINDOW_BOUNDS[k]) if k in PACKET_WINDOW_BOUNDS else v)
               for k, v in out.items()}
    width = int(round(seconds * 1_000_000))
    return d.select(
        stable_id(col("node_id"), col("window_start")).alias("source_row_id"), "node_id",
        F.lit("uav").alias("node_type"), S.bucket_middle(col("window_start"), seconds).alias("ts"),
        (col("window_start") / width).cast("bigint").alias("window_id"),
        *_label_outputs(attack_share, col("n")), *[v.alias(k) for k, v in bounded.items()])


def edge_windows(samples: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Mean of the radio metrics per (node, window); gateway metrics stay null."""
    keyed = samples.withColumn("window_start", S.bucket_start(F.col("ts"), seconds))
    means = keyed.groupBy("node_id", "window_start").agg(
        *[F.avg(S.with_default(samples, m, None).cast("double")).alias(m) for m in JAM_METRICS])
    return means.select("node_id", "window_start", F.lit("edge").alias("collection_point"), *JAM_METRICS,
                        *[F.lit(None).cast("double").alias(m) for m in DOS_METRICS])


def gateway_windows(packets: DataFrame, seconds: float = 1.0, gateway: str = "gcc_001") -> DataFrame:
    """Traffic metrics of the packets that pass the gateway in each window; radio metrics stay null."""
    keyed = packets.withColumn("window_start", S.bucket_start(F.col("ts"), seconds))
    base = keyed.groupBy("window_start").agg(*gateway_counts())
    spread = value_entropy(keyed, ["window_start"], {"ip_src": "", "ip_dst": ""})
    return gateway_columns(base.join(spread, ["window_start"]), gateway)


def gateway_counts() -> list[Column]:
    protocol, flags = F.upper(F.coalesce("protocol", F.lit(""))), F.upper(F.coalesce("tcp_flags", F.lit("")))
    return [F.count("*").alias("n"), F.sum(F.coalesce("frame_len", F.lit(0.0))).alias("total_bytes"),
            F.count_if(protocol == "ICMP").alias("icmp"), F.count_if(protocol == "UDP").alias("udp"),
            F.count_if(flags.contains("SYN") & ~flags.contains("ACK")).alias("syn"),
            F.count_if(flags.contains("FIN") | flags.contains("RST")).alias("fin_rst"),
            F.max(F.col("ip_src").isNull().cast("int")).alias("_src_null")]


def gateway_columns(d: DataFrame, gateway: str) -> DataFrame:
    values = {
        "packets_per_second": F.col("n"), "bytes_per_second": F.col("total_bytes"),
        # A missing source counts as one more source.
        "unique_source_count": F.col("ip_src_distinct") + F.col("_src_null"),
        "src_ip_entropy": F.col("ip_src_entropy"), "dst_ip_entropy": F.col("ip_dst_entropy"),
        "icmp_packet_rate": F.col("icmp"), "connection_attempts_per_sec": F.col("syn"),
        "half_open_connections": F.lit(0), "tcp_retransmission_rate": F.lit(0),
        "udp_packet_rate": F.col("udp"), "syn_packet_rate": F.col("syn"), "fin_rst_rate": F.col("fin_rst"),
        "port_scan_score": F.lit(0),
    }
    return d.select(F.lit(gateway).alias("node_id"), "window_start", F.lit("gcc").alias("collection_point"),
                    *[F.coalesce(values[m].cast("double") if m in values else F.lit(None).cast("double"))
                      .alias(m) for m in DOS_METRICS],
                    *[F.lit(None).cast("double").alias(m) for m in JAM_METRICS])


def packet_samples(packets: DataFrame) -> DataFrame:
    """One sample per packet with radio and protocol features, before any rolling context."""
    zero = lambda c: S.to_number(S.with_default(packets, c, 0.0))
    signal = zero("signal_dbm") if "signal_dbm" in packets.columns else zero("ant_signal_dbm")
    out = {
        "rssi_dbm": zero("ant_signal_dbm"), "snr_db": signal,
        "noise_floor_dbm": zero("ant_signal_dbm") - signal,
        "bad_packet_ratio": zero("bad_fcs"), "bit_error_rate": zero("bad_fcs"),
        "packet_delivery_ratio": 1.0 - zero("bad_fcs"),
        "mac_retry_count": zero("retry"), "retransmission_count": zero("retry"),
        "data_rate_mbps": zero("data_rate"),
        "channel_occupancy_pct": S.clip(zero("duration_us") / 1000.0, 0, 100),
        "frame_len": zero("frame_len"), "udp_length": zero("udp_len"), "ip_ttl": zero("ip_ttl"),
        "iat_s": zero("iat_s"), "arp_flag": zero("arp"),
        "modulation_ofdm_flag": S.as_double(zero("ofdm") > 0),
        "modulation_cck_flag": S.as_double(zero("cck") > 0),
        "is_udp": S.as_double(zero("udp_len") > 0), "is_tcp": S.as_double(zero("tcp_ack") > 0),
        "is_icmp": S.as_double(zero("ip_proto") == 1),
    }
    keep = [c for c in ("packet_id", "node_id", "ts", "label", "ip_src") if c in packets.columns]
    return packets.select(*keep, *[v.alias(k) for k, v in out.items()])


def labels_in_schema(df: DataFrame, raw: str) -> DataFrame:
    """One row: whether every label that is there is one of the schema's, whatever its case and blanks; null without labels."""
    return df.agg(F.bool_and(F.lower(F.trim(raw)).isin(SCHEMA_LABELS)).alias("in_schema"))


def label_packets(packets: DataFrame, raw: str = "label_raw") -> DataFrame:
    """Adds ``label`` and ``collection_point``. Labels already in the schema are only lower-cased."""
    S.require_columns(packets, [raw])
    known = labels_in_schema(packets, raw).first()["in_schema"]
    label = F.lower(F.trim(raw)) if known else S.normalise_label(F.coalesce(F.col(raw), F.lit("nan")))
    return (packets.withColumn("label", label)
            .withColumn("collection_point", S.collection_point(F.col("label"))))


def split_tiers(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edge rows, gateway rows); rows seen by both are in both; an empty tier becomes all rows."""
    if "collection_point" not in df.columns:
        return df, df
    edge = F.col("collection_point").isin("edge", "edge_gcc")
    gateway = F.col("collection_point").isin("gcc", "edge_gcc")
    some_edge, some_gateway = df.agg(F.bool_or(edge), F.bool_or(gateway)).first()
    return df.where(edge) if some_edge else df, df.where(gateway) if some_gateway else df
