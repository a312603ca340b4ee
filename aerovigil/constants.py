"""Fixed values of the telemetry domain (names, bounds, weights, rule tables)."""

# --- Fixed values: metric names -------------------------------------------------
JAM_METRICS = [
    "rssi_dbm", "snr_db", "sinr_db", "noise_floor_dbm", "bit_error_rate", "bad_packet_ratio",
    "packet_delivery_ratio", "mac_retry_count", "retransmission_count", "channel_occupancy_pct",
    "cca_failure_count", "backoff_count",
]
DOS_METRICS = [
    "packets_per_second", "bytes_per_second", "unique_source_count", "src_ip_entropy",
    "dst_ip_entropy", "icmp_packet_rate", "connection_attempts_per_sec", "half_open_connections",
    "tcp_retransmission_rate", "udp_packet_rate", "syn_packet_rate", "fin_rst_rate",
    "port_scan_score", "api_request_rate", "error_response_rate", "command_frequency",
]
ALL_METRICS = JAM_METRICS + DOS_METRICS
ID_COLUMNS = ["source_row_id", "node_id", "node_type", "ts", "collection_point", "window_id", "label"]

# --- Fixed values: validity bounds per metric ------------------------------------
BOUNDS = {
    "rssi_dbm": (-120.0, -10.0), "snr_db": (-30.0, 60.0), "sinr_db": (-20.0, 50.0),
    "noise_floor_dbm": (-130.0, -50.0), "bit_error_rate": (0.0, 1.0), "bad_packet_ratio": (0.0, 1.0),
    "packet_delivery_ratio": (0.0, 1.0), "mac_retry_count": (0.0, 1000.0),
    "retransmission_count": (0.0, 5000.0), "channel_occupancy_pct": (0.0, 100.0),
    "cca_failure_count": (0.0, 2000.0), "backoff_count": (0.0, 2000.0),
    "packets_per_second": (0.0, 1e6), "bytes_per_second": (0.0, 1.25e9),
    "unique_source_count": (0.0, 65535.0), "src_ip_entropy": (0.0, 16.0), "dst_ip_entropy": (0.0, 16.0),
    "icmp_packet_rate": (0.0, 500000.0), "connection_attempts_per_sec": (0.0, 500000.0),
    "half_open_connections": (0.0, 100000.0), "tcp_retransmission_rate": (0.0, 50000.0),
    "udp_packet_rate": (0.0, 500000.0), "syn_packet_rate": (0.0, 500000.0),
    "fin_rst_rate": (0.0, 500000.0), "port_scan_score": (0.0, 65535.0),
    "api_request_rate": (0.0, 10000.0), "error_response_rate": (0.0, 1.0),
    "command_frequency": (0.0, 1000.0),
}
# Bounds applied to windows derived from packets.
PACKET_WINDOW_BOUNDS = {
    "rssi_dbm": (-120.0, 0.0), "snr_db": (-30.0, 50.0), "packets_per_second": (0.0, 1e6),
    "bytes_per_second": (0.0, 1e9), "channel_occupancy_pct": (0.0, 100.0),
    "packet_delivery_ratio": (0.0, 1.0), "bit_error_rate": (0.0, 1.0), "bad_packet_ratio": (0.0, 1.0),
}
# (left, comparison, right, slack, tag)
CONSISTENCY_RULES = [
    ("retransmission_count", "<=", "mac_retry_count", 2.0, "RETX_EXCEEDS_RETRIES"),
    ("half_open_connections", "<=", "connection_attempts_per_sec", 1.0, "HALF_OPEN_EXCEEDS_ATTEMPTS"),
    ("syn_packet_rate", "<=", "connection_attempts_per_sec", 1.5, "SYN_EXCEEDS_CONN_ATTEMPTS"),
]
ESSENTIAL_EDGE = ["rssi_dbm", "snr_db", "packet_delivery_ratio", "mac_retry_count"]
ESSENTIAL_GATEWAY = ["packets_per_second", "bytes_per_second", "unique_source_count",
                     "connection_attempts_per_sec"]
QUALITY_WEIGHTS = {
    "missing_essential_flag": 0.40, "out_of_range_flag": 0.25, "consistency_flag": 0.15,
    "duplicate_flag": 0.10, "spike_flag": 0.10,
}
ZERO_FILLED_COUNTS = ["mac_retry_count", "retransmission_count", "cca_failure_count", "backoff_count",
                      "half_open_connections", "port_scan_score"]
RATIO_COLUMNS = ["retx_per_retry", "channel_busy_frac", "syn_flood_ratio", "half_open_ratio",
                 "src_concentration", "pps_per_source", "sinr_negative_flag", "ber_severe"]

# --- Fixed values: labels ---------------------------------------------------------
LABEL_CODES = {"normal": 0, "jamming": 1, "dos": 2, "ddos": 3, "hybrid": 4}
SCHEMA_LABELS = ["normal", "jamming", "dos", "ddos", "suspicious"]
RAW_LABELS = {
    "normal": ["normal", "benign", "background", ""],
    "jamming": ["gps_jamming", "jamming", "gps_spoofing", "wlan_jamming"],
    "dos": ["dos", "flooding", "dos_flooding", "icmp_flood", "udp_flood", "syn_flood", "tcp_flood"],
    "ddos": ["ddos", "ddos_flooding", "distributed_flooding"],
}
ATTACK_FINAL_LABELS = ["JAMMING", "DOS", "DDOS", "HYBRID_ATTACK"]
FINAL_LABELS = ["NORMAL", "SUSPICIOUS"] + ATTACK_FINAL_LABELS

# --- Fixed values: feature targets --------------------------------------------------
EWMA_METRICS = ["rssi_dbm", "snr_db", "sinr_db", "packet_delivery_ratio", "channel_occupancy_pct"]
ROLLING_TARGETS = {
    "rssi_dbm": [5, 10], "snr_db": [5, 10], "sinr_db": [5], "bit_error_rate": [5, 10],
    "bad_packet_ratio": [5], "mac_retry_count": [5, 10], "retransmission_count": [5],
    "channel_occupancy_pct": [5, 30], "cca_failure_count": [5], "packet_delivery_ratio": [10, 30],
}
DELTA_METRICS = ["rssi_dbm", "snr_db", "sinr_db", "packet_delivery_ratio", "channel_occupancy_pct",
                 "mac_retry_count", "cca_failure_count"]
DROP_COLUMNS = {"rssi_drop": "rssi_dbm", "snr_drop": "snr_db", "pdr_drop": "packet_delivery_ratio"}
JAM_CUSUM = {"snr_db": "down", "sinr_db": "down", "mac_retry_count": "up", "cca_failure_count": "up",
             "channel_occupancy_pct": "up"}
DOS_CUSUM = {"syn_packet_rate": "up", "half_open_connections": "up",
             "connection_attempts_per_sec": "up", "packets_per_second": "up"}
JAM_FLAG_TARGETS = {
    "rssi_dbm": (0.05, "below"), "snr_db": (0.05, "below"), "sinr_db": (0.05, "below"),
    "bit_error_rate": (0.99, "above"), "bad_packet_ratio": (0.99, "above"),
    "mac_retry_count": (0.99, "above"), "cca_failure_count": (0.99, "above"),
    "channel_occupancy_pct": (0.99, "above"),
}
DOS_FLAG_TARGETS = {m: (0.99, "above") for m in
                    ["packets_per_second", "bytes_per_second", "unique_source_count",
                     "half_open_connections", "syn_packet_rate", "connection_attempts_per_sec"]}
BURST_METRICS = ["packets_per_second", "bytes_per_second", "connection_attempts_per_sec",
                 "syn_packet_rate", "icmp_packet_rate", "udp_packet_rate"]
PEER_METRICS = ["rssi_dbm", "snr_db", "channel_occupancy_pct", "mac_retry_count",
                "packets_per_second", "unique_source_count", "src_ip_entropy", "half_open_connections"]
PEER_SCORE_METRICS = ["rssi_dbm", "snr_db", "packets_per_second", "src_ip_entropy"]
DENSITY_METRICS = ["packets_per_second", "src_ip_entropy", "half_open_connections"]

# --- Fixed values: response ---------------------------------------------------------
RF_ACTIONS = ["CONTINUE_NORMAL_OPERATION", "INCREASE_MONITORING", "SWITCH_TO_BACKUP_CHANNEL",
              "ACTIVATE_FREQUENCY_HOPPING", "REDUCE_TX_POWER_AND_REPOSITION", "SWITCH_TO_LTE_FALLBACK"]
NETWORK_ACTIONS = ["ALLOW_NORMAL_TRAFFIC", "FLAG_AND_RATE_LIMIT", "BLOCK_SUSPICIOUS_SOURCES",
                   "ACTIVATE_SYN_COOKIE_DEFENSE", "SHED_NON_CRITICAL_LOAD", "REROUTE_THROUGH_BACKUP_RELAY"]
ACTIONS = RF_ACTIONS + NETWORK_ACTIONS
DESIRED_ACTIONS = {
    "NORMAL": ["CONTINUE_NORMAL_OPERATION", "ALLOW_NORMAL_TRAFFIC"],
    "SUSPICIOUS": ["INCREASE_MONITORING", "FLAG_AND_RATE_LIMIT"],
    "JAMMING": ["SWITCH_TO_BACKUP_CHANNEL", "ACTIVATE_FREQUENCY_HOPPING", "SWITCH_TO_LTE_FALLBACK"],
    "DOS": ["BLOCK_SUSPICIOUS_SOURCES", "ACTIVATE_SYN_COOKIE_DEFENSE", "FLAG_AND_RATE_LIMIT"],
    "DDOS": ["SHED_NON_CRITICAL_LOAD", "BLOCK_SUSPICIOUS_SOURCES", "REROUTE_THROUGH_BACKUP_RELAY"],
    "HYBRID_ATTACK": ["SWITCH_TO_BACKUP_CHANNEL", "ACTIVATE_FREQUENCY_HOPPING",
                      "SHED_NON_CRITICAL_LOAD", "REROUTE_THROUGH_BACKUP_RELAY"],
}
DISRUPTIVE_ACTIONS = ["SWITCH_TO_BACKUP_CHANNEL", "BLOCK_SUSPICIOUS_SOURCES",
                      "ACTIVATE_FREQUENCY_HOPPING", "SHED_NON_CRITICAL_LOAD"]
PASSIVE_ACTIONS = ["CONTINUE_NORMAL_OPERATION", "ALLOW_NORMAL_TRAFFIC"]
RESPONSE_DEFAULTS = {
    "jam_risk_score": 0.0, "dos_risk_score": 0.0, "hybrid_risk_score": 0.0, "fusion_confidence": 0.0,
    "edge_alarm": 0.0, "cross_layer_anomaly_score": 0.0, "snr_db": 10.0, "channel_occupancy_pct": 20.0,
    "packet_delivery_ratio": 1.0, "half_open_connections": 0.0, "src_ip_entropy": 0.0,
    "error_response_rate": 0.0, "consecutive_attack_count": 0.0, "packets_per_second": 50.0,
    "syn_packet_rate": 0.0, "rssi_dbm": -70.0,
}

# --- Fixed values: management game ----------------------------------------------------
ATTACKER_STRATEGIES = ["JAM_CHANNEL", "FLOOD_NETWORK", "HYBRID_ATTACK"]
DEFENDER_STRATEGIES = ["NORMAL_OPS", "LIGHT_DEFENSE", "FULL_DEFENSE", "EMERGENCY_MODE"]
BASE_PAYOFF = [
    [-0.8, 0.3, 0.7, 0.4],
    [-0.6, 0.5, 0.6, 0.3],
    [-1.0, -0.1, 0.5, 0.6],
]
ALLOCATIONS = {
    "hop_budget": [0.00, 0.20, 0.60, 1.00],
    "rate_limit": [0.0, 0.3, 0.7, 1.0],
    "relay_factor": [1.0, 1.2, 1.5, 2.0],
    "energy_save": [0.20, 0.10, 0.00, 0.00],
}
KPI_ROWS = 30
LEDGER_ROWS = 10
