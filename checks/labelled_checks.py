"""Labelled data sets: normalising, mixed headers, quotas, synthetic flows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.schemas import FLOW_KEY, LABELLED_COLUMNS
from flowtide.sources.labelled import normalise_labelled, quota_sample, quotas, read_labelled, skipped_files
from flowtide.sources.synthetic import SERVICE_PORTS, synthetic_kind
from flowtide.operators.sampling import row_hash, seeded_shuffle
from flowtide.storage import fresh_dir, materialise

from .adapters import NORMALISED, RAW, RAW_COLUMNS, raw_labelled, table
from .registry import check, rounded, sql_hash60, sql_uniform

LABELLED_ROUNDED = ["flow_duration", "mean_packet_size", "std_packet_size", "iat_mean", "iat_std", "bytes_per_packet", "packets_per_second"]
LABELLED_SELECT = ", ".join(f"floor({c} * 1e4 + 0.5) / 1e4 AS {c}" if c in LABELLED_ROUNDED else c for c in LABELLED_COLUMNS)


@check("cic_normalise", f"WITH {RAW}, {NORMALISED} SELECT row_key, {LABELLED_SELECT} FROM normalised")
def cic_normalise(spark, sf):
    return rounded(normalise_labelled(raw_labelled(spark, sf), keep=["row_key"]), LABELLED_ROUNDED)


# Header layouts of the files: other names, other order, no addresses, and one without the label (not usable).
LONG_NAMES = {
    "Src Port": "Source Port", " Dst Port": "Destination Port", "Tot Fwd Pkts": "Total Fwd Packets", "Tot Bwd Pkts": "Total Backward Packets",
    "TotLen Fwd Pkts": "Total Length of Fwd Packets", "TotLen Bwd Pkts": "Total Length of Bwd Packets",
    "SYN Flag Cnt": "SYN Flag Count", "FIN Flag Cnt": "FIN Flag Count", "RST Flag Cnt": "RST Flag Count", "Pkt  Len/Std": "Packet Length Std",
}


def write_layouts(spark, sf) -> str:
    """lineitem as CSV files in three usable layouts, by return flag, and one layout without a label column."""
    folder = fresh_dir(spark, "labelled")
    li = table(spark, sf, "lineitem")
    layouts = {
        "A": [(n, n) for n in RAW_COLUMNS],
        "N": [(n, LONG_NAMES.get(n, n)) for n in reversed(RAW_COLUMNS)],
        "R": [(n, n.upper()) for n in RAW_COLUMNS if n != "Flow ID"],
    }
    for flag, names in layouts.items():
        part = li.where(F.col("l_returnflag") == flag)
        part.select(*[F.expr(RAW_COLUMNS[n]).alias(alias) for n, alias in names]).write.option("header", True).csv(f"{folder}/{flag}")
    unlabelled = [n for n in RAW_COLUMNS if n != "Label"]
    li.select(*[F.expr(RAW_COLUMNS[n]).alias(n) for n in unlabelled]).write.option("header", True).csv(f"{folder}/X")
    return folder


MULTI = f"""WITH {RAW}, {NORMALISED}, placed AS (
  SELECT * REPLACE (CASE WHEN split_part(row_key, '-', 6) LIKE 'R%' THEN '0.0.0.0' ELSE src_ip END AS src_ip,
                    CASE WHEN split_part(row_key, '-', 6) LIKE 'R%' THEN '0.0.0.0' ELSE dst_ip END AS dst_ip,
                    CASE WHEN split_part(row_key, '-', 6) LIKE 'R%' THEN CAST(CAST(split_part(row_key, '-', 3) AS BIGINT) % 65536 AS INTEGER) ELSE src_port END AS src_port,
                    CASE WHEN split_part(row_key, '-', 6) NOT LIKE 'R%' THEN dst_port WHEN split_part(row_key, '-', 2) = '7' THEN 0
                         ELSE CAST(CAST(split_part(row_key, '-', 4) AS BIGINT) % 65536 AS INTEGER) END AS dst_port)
  FROM normalised)"""


@check("cic_multi_header", f"{MULTI} SELECT {LABELLED_SELECT} FROM placed")
def cic_multi_header(spark, sf):
    return rounded(read_labelled(spark, f"{write_layouts(spark, sf)}/*/*.csv"), LABELLED_ROUNDED)


# Rows of one file: a compressed one is read by one task.
FILE_ROWS = 250_000


def write_odd_files(spark, sf) -> str:
    """Files in a folder with a blank: a third as text, one compressed, one without a label, each as three files at least."""
    folder = f"{fresh_dir(spark, 'labelled')}/a b"
    li = table(spark, sf, "lineitem")
    rows = {flag: n for flag, n in li.groupBy("l_returnflag").count().collect()}
    for flag, options in {"A": {}, "N": {"compression": "gzip"}, "R": {}}.items():
        names = [n for n in RAW_COLUMNS if n != "Label" or flag != "R"]
        part = li.where(F.col("l_returnflag") == flag).repartition(3 + rows.get(flag, 0) // FILE_ROWS, "l_orderkey")
        part.select(*[F.expr(RAW_COLUMNS[n]).alias(n) for n in names]).write.options(header=True, **options).csv(f"{folder}/part {flag}")
    return f"{folder}/*/*.csv*"


@check(
    "cic_file_limit",
    f"""WITH {RAW}, {NORMALISED}, counts AS (
          SELECT substr(split_part(row_key, '-', 6), 1, 1) AS source, count(*) AS n FROM normalised GROUP BY 1)
        SELECT CAST(sum(least(n, 500)) AS BIGINT) AS n FROM counts WHERE source IN ('A', 'N')""",
)
def cic_file_limit(spark, sf):
    """A limit shares out over the usable files, whatever their paths and codecs."""
    return read_labelled(spark, write_odd_files(spark, sf), limit=1000).agg(F.count(F.lit(1)).alias("n"))


@check(
    "cic_skipped_files",
    "SELECT 'R' AS part, 'missing required columns: [''label_raw'']' AS reason FROM lineitem WHERE l_returnflag = 'R' LIMIT 1",
)
def cic_skipped_files(spark, sf):
    part = F.regexp_extract("path", "part(?: |%20)([A-Z])/", 1).alias("part")
    return skipped_files(spark, write_odd_files(spark, sf)).select(part, "reason").distinct()


QUOTA = 1000


@check(
    "cic_quota_sample",
    f"""WITH {RAW}, {NORMALISED}, ranked AS (
          SELECT *, substr(split_part(row_key, '-', 6), 1, 1) AS source,
                 row_number() OVER (PARTITION BY substr(split_part(row_key, '-', 6), 1, 1) ORDER BY {sql_hash60("'42'", "row_key")}, row_key) AS rank
          FROM normalised)
        SELECT source, row_key, label, bidirectional_packets FROM ranked
        WHERE rank <= {QUOTA} // 3 + CASE WHEN source = 'A' THEN {QUOTA} % 3 ELSE 0 END""",
)
def cic_quota_sample(spark, sf):
    flows = normalise_labelled(raw_labelled(spark, sf), keep=["row_key"])
    source = F.substring(F.split_part("row_key", F.lit("-"), F.lit(6)), 1, 1).alias("source")
    wanted = ["row_key", "label", "bidirectional_packets"]
    # The sample reads its input three times.
    sourced = materialise(flows.select(source, *wanted, row_hash(42, ["row_key"]).alias("row_hash")), "sourced")
    picked = quota_sample(sourced, quotas(QUOTA, ["A", "N", "R"]), "source", 42, ["row_key"], "row_hash")
    return picked.select("source", *wanted)


def _kinds(spark, sf) -> DataFrame:
    """One synthetic flow per event: purchases are floods, errors are scans, all else is benign."""
    ev = table(spark, sf, "events")
    kinds = {"syn_flood": F.col("event_type") == "purchase", "port_scan": F.col("event_type") == "error"}
    kinds["benign"] = ~(kinds["syn_flood"] | kinds["port_scan"])
    parts = [synthetic_kind(ev.where(test), kind, ident="event_id").withColumn("kind", F.lit(kind)) for kind, test in kinds.items()]
    return reduce(DataFrame.unionByName, parts)


def _u(name: str) -> str:
    return sql_uniform("'42'", "CAST(event_id AS VARCHAR)", f"'{name}'")


def _int(name: str, low, high) -> str:
    return f"(CAST(floor({_u(name)} * CAST(({high}) - ({low}) + 1 AS DOUBLE)) AS BIGINT) + ({low}))"


def _real(name: str, low: str, high: str) -> str:
    return f"({low} + {_u(name)} * ({high} - {low}))"


def _ip(name: str, private: bool) -> str:
    if not private:
        return " || '.' || ".join(_int(f"{name}{i}", 0, 255) for i in range(4))
    tail = f"'.' || {_int(name + '2', 0, 255)} || '.' || {_int(name + '3', 1, 254)}"
    return f"""CASE {_int(name + 'block', 0, 2)} WHEN 0 THEN '10.' || {_int(name + '1', 0, 255)} || {tail}
      WHEN 1 THEN '172.' || {_int(name + '1', 16, 31)} || {tail} ELSE '192.168' || {tail} END"""


SYNTHETIC = f"""draws AS (
  SELECT event_id, kind, {_int('src_port', 1025, 65535)} AS src_port,
    {_ip('inside', True)} AS inside, {_ip('outside', False)} AS outside,
    CASE kind WHEN 'benign' THEN CASE WHEN {_u('common')} < 0.8 THEN [{', '.join(map(str, SERVICE_PORTS))}][{_int('service', 1, 6)}] ELSE {_int('dst_port', 1, 65535)} END
              WHEN 'syn_flood' THEN {_int('dst_port', 1, 1024)} ELSE {_int('dst_port', 1, 65535)} END AS dst_port,
    CASE WHEN kind <> 'benign' OR {_u('protocol')} < 0.5 THEN 'tcp' ELSE 'udp' END AS protocol,
    CASE kind WHEN 'benign' THEN {_int('packets', 1, 50)} WHEN 'syn_flood' THEN {_int('packets', 1000, 5000)} ELSE {_int('packets', 1, 3)} END AS packets,
    CASE kind WHEN 'benign' THEN {_int('size', 40, 1500)} WHEN 'syn_flood' THEN {_int('size', 40, 80)} ELSE {_int('size', 40, 200)} END AS size,
    CASE kind WHEN 'benign' THEN {_real('duration', '0.001', '5.0')} WHEN 'syn_flood' THEN {_real('duration', '0.01', '1.0')} ELSE {_real('duration', '0.0001', '0.01')} END AS duration,
    {_real('std', '0.1', '0.5')} AS std_part, {_real('std', '0.0', '5.0')} AS std_flood, {_real('iat_std', '0.1', '0.5')} AS iat_part
  FROM (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'syn_flood' WHEN 'error' THEN 'port_scan' ELSE 'benign' END AS kind FROM events)
), synthetic AS (
  SELECT event_id, kind, CASE WHEN kind = 'benign' THEN inside ELSE outside END AS src_ip, CASE WHEN kind = 'benign' THEN outside ELSE inside END AS dst_ip,
    CAST(src_port AS INTEGER) AS src_port, CAST(dst_port AS INTEGER) AS dst_port, protocol, packets AS bidirectional_packets, packets * size AS bidirectional_bytes,
    CASE kind WHEN 'benign' THEN size * std_part WHEN 'syn_flood' THEN std_flood ELSE 0.0 END AS std_packet_size, duration AS flow_duration,
    CASE WHEN kind = 'benign' THEN 0 ELSE packets END AS tcp_syn_count, duration / packets AS iat_mean,
    CASE WHEN kind = 'benign' THEN duration / packets * iat_part ELSE 0.0 END AS iat_std, packets / duration AS packets_per_second,
    CAST(kind <> 'benign' AS INTEGER) AS label FROM draws
)"""
SYN_PLAIN = ["event_id", "kind", *FLOW_KEY, "bidirectional_packets", "bidirectional_bytes", "tcp_syn_count", "label"]
SYN_ROUNDED = ["std_packet_size", "flow_duration", "iat_mean", "iat_std", "packets_per_second"]


@check(
    "synthetic_flows",
    f"WITH {SYNTHETIC} SELECT {', '.join(SYN_PLAIN)}, {', '.join(f'floor({c} * 1e4 + 0.5) / 1e4 AS {c}' for c in SYN_ROUNDED)} FROM synthetic",
)
def synthetic_flows(spark, sf):
    mixed = seeded_shuffle(_kinds(spark, sf), 42, ["event_id"])
    return rounded(mixed.select(*SYN_PLAIN, *SYN_ROUNDED), SYN_ROUNDED)


BOUNDED = ["bidirectional_packets", "dst_port", "src_port"]


@check(
    "synthetic_class_bounds",
    f"WITH {SYNTHETIC} SELECT kind, count(*) AS n, "
    + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in BOUNDED)
    + ", CAST(sum(tcp_syn_count) AS BIGINT) AS syn FROM synthetic GROUP BY kind",
)
def synthetic_class_bounds(spark, sf):
    ends = [f(c).alias(f"{n}_{c}") for c in BOUNDED for n, f in (("min", F.min), ("max", F.max))]
    return _kinds(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *ends, F.sum("tcp_syn_count").alias("syn"))
