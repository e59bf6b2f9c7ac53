"""Column lists and schemas of packets, flows, labelled flows and alerts."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and their order are part of the data format.
FLOW_KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]

FEATURES_MINIMAL = [
    "bidirectional_packets",
    "bidirectional_bytes",
    "mean_packet_size",
    "std_packet_size",
    "flow_duration",
]

FEATURES_EXTENDED = FEATURES_MINIMAL + [
    "tcp_syn_count",
    "tcp_fin_count",
    "tcp_rst_count",
    "iat_mean",
    "iat_std",
    "bytes_per_packet",
    "packets_per_second",
]

# Order of the columns of a normalised labelled flow.
LABELLED_COLUMNS = [
    "src_ip",
    "dst_ip",
    "src_port",
    "dst_port",
    "protocol",
    "flow_duration",
    "bidirectional_packets",
    "bidirectional_bytes",
    "mean_packet_size",
    "std_packet_size",
    "tcp_syn_count",
    "tcp_fin_count",
    "tcp_rst_count",
    "iat_mean",
    "iat_std",
    "bytes_per_packet",
    "packets_per_second",
    "label",
]

_TYPES = {
    "window": T.LongType(),
    "src_ip": T.StringType(),
    "dst_ip": T.StringType(),
    "src_port": T.IntegerType(),
    "dst_port": T.IntegerType(),
    "protocol": T.StringType(),
    "bidirectional_packets": T.LongType(),
    "bidirectional_bytes": T.LongType(),
    "tcp_syn_count": T.LongType(),
    "tcp_fin_count": T.LongType(),
    "tcp_rst_count": T.LongType(),
    "label": T.IntegerType(),
}


def _schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES.get(n, T.DoubleType())) for n in names])


PACKET = T.StructType(
    [
        T.StructField("ts_us", T.LongType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("frame_len", T.IntegerType()),
        T.StructField("syn", T.IntegerType()),
        T.StructField("fin", T.IntegerType()),
        T.StructField("rst", T.IntegerType()),
    ]
)

FLOW_MINIMAL = _schema(["window", *FLOW_KEY, *FEATURES_MINIMAL])
FLOW_EXTENDED = _schema(["window", *FLOW_KEY, *FEATURES_EXTENDED])
FLOW_LABELLED = _schema(["window", *FLOW_KEY, *FEATURES_EXTENDED, "label"])
FLOW_NORMALISED = _schema(LABELLED_COLUMNS)

ALERT = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("level", T.StringType()),
    ]
)


def feature_columns(feature_set: str = "extended") -> list[str]:
    """Ordered feature names of a feature set; any name but ``extended`` means minimal."""
    return list(FEATURES_EXTENDED if feature_set == "extended" else FEATURES_MINIMAL)


def present_features(columns: list[str]) -> list[str]:
    """The five base features plus every extended one that the table has."""
    extra = [c for c in FEATURES_EXTENDED if c not in FEATURES_MINIMAL and c in columns]
    return FEATURES_MINIMAL + extra
