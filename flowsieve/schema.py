"""Canonical flow schema, name maps and the fixed values that define results.

All column names inside the library are snake_case; each source renames its
own header convention once, at the scan.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical flow record: (name, Spark type, default when absent).
FLOW_FIELDS = [
    ("flow_ts", T.TimestampNTZType(), None),
    ("src_ip", T.StringType(), None),
    ("dst_ip", T.StringType(), None),
    ("src_port", T.IntegerType(), None),
    ("dst_port", T.IntegerType(), None),
    ("protocol", T.StringType(), "TCP"),
    ("flow_duration", T.DoubleType(), 0.0),
    ("total_fwd_packets", T.LongType(), 0),
    ("total_backward_packets", T.LongType(), 0),
    ("total_length_fwd_packets", T.LongType(), 0),
    ("total_length_bwd_packets", T.LongType(), 0),
    ("fwd_packet_length_max", T.DoubleType(), 0.0),
    ("fwd_packet_length_min", T.DoubleType(), 0.0),
    ("fwd_packet_length_mean", T.DoubleType(), 0.0),
    ("flow_bytes_s", T.DoubleType(), 0.0),
    ("flow_packets_s", T.DoubleType(), 0.0),
    ("flow_iat_mean", T.DoubleType(), 0.0),
    ("flow_iat_std", T.DoubleType(), 0.0),
    ("source", T.StringType(), "real_traffic"),
]

FLOW_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t, _ in FLOW_FIELDS])
FLOW_DEFAULTS = {n: d for n, _, d in FLOW_FIELDS if d is not None}
REQUIRED_FIELDS = ["src_ip", "dst_ip", "src_port", "dst_port"]

# Columns that are targets, never features.
TARGET_COLUMNS = ["label", "binary_label", "original_label"]

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being matched).
# ---------------------------------------------------------------------------

# Dataset header aliases, first present alias wins (label, duration, packets).
COLUMN_ALIASES = {
    "label": ["Label", "label", "class", "Class", "attack_type"],
    "flow_duration": ["Flow Duration", "flow_duration", "duration"],
    "total_fwd_packets": ["Total Fwd Packets", "fwd_packets", "tot_fwd_pkts"],
    "total_backward_packets": ["Total Backward Packets", "bwd_packets", "tot_bwd_pkts"],
}

# Other dataset headers mapped to snake_case names.
DATASET_HEADER_MAP = {
    "Total Length of Fwd Packets": "total_length_fwd_packets",
    "Total Length of Bwd Packets": "total_length_bwd_packets",
    "Flow IAT Mean": "flow_iat_mean",
    "Flow IAT Std": "flow_iat_std",
    "Fwd PSH Flags": "fwd_psh_flags",
    "Bwd PSH Flags": "bwd_psh_flags",
    "Fwd URG Flags": "fwd_urg_flags",
    "Protocol": "protocol",
    "Destination Port": "destination_port",
    "Source Port": "source_port",
}

# Labels that mean "benign" after trim + upper.
BENIGN_LABELS = ["BENIGN", "NORMAL", "0", "LEGITIMATE"]

# Flow-exporter CSV header -> record key.
CIC_HEADER_MAP = {
    "Flow Duration": "flow_duration",
    "Total Fwd Packets": "total_fwd_packets",
    "Total Backward Packets": "total_backward_packets",
    "Total Length of Fwd Packets": "total_length_fwd_packets",
    "Total Length of Bwd Packets": "total_length_bwd_packets",
    "Fwd Packet Length Max": "fwd_packet_length_max",
    "Fwd Packet Length Min": "fwd_packet_length_min",
    "Fwd Packet Length Mean": "fwd_packet_length_mean",
    "Flow Bytes/s": "flow_bytes_s",
    "Flow Packets/s": "flow_packets_s",
    "Flow IAT Mean": "flow_iat_mean",
    "Flow IAT Std": "flow_iat_std",
    "Src IP": "src_ip",
    "Src Port": "src_port",
    "Dst IP": "dst_ip",
    "Dst Port": "dst_port",
    "Protocol": "protocol",
}

# Severity / action cuts on confidence (>= cut), highest first.
SEVERITY_CUTS = [(0.9, "CRITICAL", "BLOCK_IMMEDIATELY"),
                 (0.8, "HIGH", "INVESTIGATE_URGENT"),
                 (0.7, "MEDIUM", "MONITOR_CLOSELY")]
SEVERITY_FLOOR = ("LOW", "LOG_AND_REVIEW")

# Zeek log kinds: minimum field count and the default port for '-'.
ZEEK_MIN_FIELDS = {"conn": 15, "dns": 10, "http": 15, "ssl": 10, "weird": 6}
ZEEK_DEFAULT_PORT = {"conn": 0, "dns": 53, "http": 80, "ssl": 443, "weird": 0}

# Constant flow measures per Zeek log kind, in canonical field order:
# duration us, fwd pkts, bwd pkts, fwd bytes, bwd bytes, len mean, len max,
# len min, bytes/s, packets/s, iat mean, iat std.
ZEEK_CONSTANTS = {
    "dns": (100000, 1, 1, 64, 128, 64, 64, 64, 1920, 20, 50000, 10000),
    "ssl": (2000000, 4, 4, 800, 3000, 200, 400, 100, 1900, 4, 250000, 100000),
    "weird": (10000, 1, 0, 40, 0, 40, 40, 40, 4000, 100, 10000, 1000),
}
# http: request bytes = len(uri) + 200, response 1500 bytes, 0.5 s,
# 3 / 5 packets, mean = request / 3, max = request, min 64, 16 packets/s,
# iat mean 62500, iat std 20000.
HTTP_REQUEST_OVERHEAD = 200
HTTP_RESPONSE_BYTES = 1500
HTTP_DURATION_US = 500000

# Metric field names of the flow measures above.
MEASURE_FIELDS = ["flow_duration", "total_fwd_packets", "total_backward_packets",
                  "total_length_fwd_packets", "total_length_bwd_packets",
                  "fwd_packet_length_mean", "fwd_packet_length_max",
                  "fwd_packet_length_min", "flow_bytes_s", "flow_packets_s",
                  "flow_iat_mean", "flow_iat_std"]

# Zeek file names that are parsed; others in a log folder are ignored.
ZEEK_LOG_KINDS = ["conn", "dns", "http", "ssl", "weird"]
