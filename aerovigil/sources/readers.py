"""Packet captures from CSV: tolerant of absent columns, strict about the label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerovigil.functions import scalars as S

# Capture columns and their names here. Text columns are listed separately.
CAPTURE_COLUMNS = {
    "frame.time_epoch": "time_epoch", "frame.time_relative": "time_relative", "frame.time_delta_displayed": "iat_s",
    "frame.len": "frame_len", "radiotap.dbm_antsignal": "ant_signal_dbm", "wlan_radio.signal_dbm": "signal_dbm",
    "radiotap.datarate": "data_rate", "radiotap.channel.flags.ofdm": "ofdm", "radiotap.channel.flags.cck": "cck",
    "wlan.fc.retry": "retry", "wlan.fcs.bad_checksum": "bad_fcs", "wlan.duration": "duration_us", "wlan.seq": "seq",
    "ip.ttl": "ip_ttl", "ip.proto": "ip_proto", "arp": "arp", "udp.length": "udp_len", "tcp.ack": "tcp_ack",
}
CAPTURE_TEXT = {"wlan.bssid": "node_id", "ip.src": "ip_src", "ip.dst": "ip_dst", "udp.dstport": "udp_dstport"}


def read_capture(spark: SparkSession, *paths: str, label: str = "Label", node: str = "wlan.bssid",
                 max_rows: int | None = None) -> DataFrame:
    """Packets of one or more CSV files or folders, by column name.

    Files are grouped by their header, so a folder may mix captures with different columns. Columns stay text until they are
    parsed, so unparsable numbers become null rather than dropping the row.
    """
    if not paths:
        raise ValueError("at least one path is needed")
    reader = spark.read.option("header", True).option("enforceSchema", False)
    parts = [_one(reader.csv(files), label, node) for p in paths for files in _alike(spark, p)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.limit(max_rows) if max_rows is not None else out


def _alike(spark: SparkSession, path: str) -> list[list[str]]:
    """The files under a path, grouped by their first line; a single file is not looked into."""
    if len(spark.read.text(path).inputFiles()) < 2:
        return [[path]]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                         F.monotonically_increasing_id().alias("at")).where("start = 0")
    heads = lines.groupBy("file").agg(F.min_by("value", "at").alias("head"))
    # One row per file; the driver lists the files of a read in any case.
    return [sorted(r["files"]) for r in heads.groupBy("head").agg(F.collect_list("file").alias("files")).orderBy("head").collect()]


def _one(raw: DataFrame, label: str, node: str) -> DataFrame:
    S.require_columns(raw, [label])
    numbers = [S.to_number(F.col(f"`{c}`"), None).alias(n) for c, n in CAPTURE_COLUMNS.items()
               if c in raw.columns and n != "time_epoch"]
    texts = [F.col(f"`{c}`").alias(n) for c, n in CAPTURE_TEXT.items() if c in raw.columns and n != "node_id"]
    epoch = S.to_number(S.with_default(raw, "frame.time_epoch", 0.0))
    name = F.coalesce(F.nullif(F.trim(F.col(f"`{node}`")), F.lit("nan")), F.lit("unknown")) if node in raw.columns else F.lit("uav_001")
    return raw.select(name.alias("node_id"), S.epoch_to_timestamp(epoch).alias("ts"), epoch.alias("time_epoch"),
                      *numbers, *texts, F.coalesce(f"`{label}`", F.lit("")).alias("label_raw"))
