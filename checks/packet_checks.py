"""Packets and flows: parsing, keys, windows, gaps, flow features, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.functions.addresses import parse_flow_id
from flowtide.functions.coerce import flag_to_int
from flowtide.operators.flows import (
    active_flows,
    bounded,
    canonicalise,
    flow_states,
    flows,
    merge_flow_states,
    packet_gaps,
    state_features,
    with_window,
)
from flowtide.schemas import FLOW_KEY
from flowtide.sources.packets import ingest_stats, parse_packets, read_packet_lines, read_packets, transport_packets
from flowtide.sources.tables import read_flows, write_flows
from flowtide.storage import fresh_dir

from .adapters import (
    CANONICAL,
    ENDS_BI,
    FLOW_SELECT,
    KEY,
    LINES,
    PACKETS,
    ROUNDED,
    UNI,
    UNI_SQL,
    WINDOW,
    flow_id_sql,
    flows_cte,
    packet_files,
    packets,
    raw_labelled,
    uni_flows,
    windowed,
)
from .adapters import RAW
from .registry import check, r4, rounded

PACKET_COLUMNS = ["ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "frame_len", "syn", "fin", "rst"]


@check("packet_parse", f"WITH {LINES} SELECT {', '.join(PACKET_COLUMNS)} FROM judged WHERE valid")
def packet_parse(spark, sf):
    """Lines written as text files and read back as packets."""
    return read_packets(spark, packet_files(spark, sf)).select(*PACKET_COLUMNS)


@check(
    "packet_ingest_stats",
    f"""WITH {LINES} SELECT count(*) AS total_lines, CAST(sum(CAST(valid AS BIGINT)) AS BIGINT) AS parsed,
        CAST(sum(CAST(NOT valid AS BIGINT)) AS BIGINT) AS skipped FROM judged""",
)
def packet_ingest_stats(spark, sf):
    return ingest_stats(parse_packets(read_packet_lines(spark, packet_files(spark, sf))))


@check(
    "flag_to_int",
    """SELECT event_id, text, CAST(CASE WHEN lower(trim(text)) IN ('1', 'true', 't', 'yes', 'y') THEN 1
         WHEN regexp_matches(lower(trim(text)), '^[+-]?[0-9]+$') AND TRY_CAST(trim(text) AS HUGEINT) <> 0 THEN 1 ELSE 0 END AS INTEGER) AS flag
       FROM (SELECT event_id, CASE event_type WHEN 'view' THEN ' True ' WHEN 'click' THEN 'no' WHEN 'error' THEN NULL
                    WHEN 'purchase' THEN CAST(user_id % 3 AS VARCHAR) ELSE concat('0x', CAST(user_id AS VARCHAR)) END AS text FROM events)""",
)
def flag_query(spark, sf):
    text = """CASE event_type WHEN 'view' THEN ' True ' WHEN 'click' THEN 'no' WHEN 'error' THEN NULL
              WHEN 'purchase' THEN CAST(user_id % 3 AS STRING) ELSE concat('0x', CAST(user_id AS STRING)) END"""
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.expr(text).alias("text"))
    return ev.withColumn("flag", flag_to_int(F.col("text")))


@check("canonical_5tuple", f"WITH {PACKETS}, {CANONICAL} SELECT seq, a_ip, a_port, b_ip, b_port, protocol FROM canonical")
def canonical_5tuple(spark, sf):
    return canonicalise(packets(spark, sf)).select("seq", "a_ip", "a_port", "b_ip", "b_port", "protocol")


@check("window_index", f"""WITH {PACKETS}, {windowed('packets', 300)} SELECT seq, "window" FROM windowed""")
def window_index(spark, sf):
    return with_window(packets(spark, sf), 300).select("seq", "window")


@check(
    "packet_iat",
    f"""WITH {PACKETS}, {windowed('packets')} SELECT seq, "window",
        ts_us - lag(ts_us) OVER (PARTITION BY "window", {KEY} ORDER BY ts_us, seq) AS iat_us FROM windowed""",
)
def packet_iat(spark, sf):
    return packet_gaps(with_window(packets(spark, sf), WINDOW), ["window", *FLOW_KEY], "seq").select("seq", "window", "iat_us")


@check("flows_unidirectional", UNI_SQL)
def flows_unidirectional(spark, sf):
    return rounded(uni_flows(spark, sf), ROUNDED)


@check("flows_short_windows", f"WITH {PACKETS}, {windowed('packets', 5)}, {flows_cte()} {FLOW_SELECT}")
def flows_short_windows(spark, sf):
    return rounded(flows(packets(spark, sf)), ROUNDED)


BI_SOURCE = f"""{windowed('canonical', name='cw')}, windowed AS (SELECT "window", {ENDS_BI} FROM cw)"""


@check("flows_bidirectional", f"WITH {PACKETS}, {CANONICAL}, {BI_SOURCE}, {flows_cte()} {FLOW_SELECT}")
def flows_bidirectional(spark, sf):
    return rounded(flows(packets(spark, sf), WINDOW, "bi"), ROUNDED)


MINIMAL_ROUNDED = ["mean_packet_size", "std_packet_size", "flow_duration"]


@check(
    "flows_minimal",
    f"""{UNI} SELECT "window", {KEY}, bidirectional_packets, bidirectional_bytes,
        {", ".join(f"floor({c} * 1e4 + 0.5) / 1e4 AS {c}" for c in MINIMAL_ROUNDED)} FROM flows""",
)
def flows_minimal(spark, sf):
    return rounded(flows(packets(spark, sf), WINDOW, feature_set="minimal"), MINIMAL_ROUNDED)


@check(
    "flow_transport_only",
    f"WITH {PACKETS}, {windowed('packets')}, {flows_cte()} SELECT protocol, count(*) AS n, CAST(sum(bidirectional_bytes) AS BIGINT) AS bytes FROM flows GROUP BY protocol",
)
def flow_transport_only(spark, sf):
    table = flows(transport_packets(packets(spark, sf)), WINDOW, feature_set="minimal")
    return table.groupBy("protocol").agg(F.count(F.lit(1)).alias("n"), F.sum("bidirectional_bytes").alias("bytes"))


@check(
    "flow_state_merge",
    f"""WITH {PACKETS}, {windowed('packets', 86400, 'days')}, gaps AS (
          SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY "window", {KEY} ORDER BY ts_us, seq) AS gap FROM days)
        SELECT "window" // 7 AS week, {KEY}, count(*) AS packets, CAST(sum(frame_len) AS BIGINT) AS bytes, count(gap) AS gaps,
               floor(coalesce(stddev_pop(gap), 0) / 1e6 * 1e4 + 0.5) / 1e4 AS iat_std,
               floor(stddev_pop(frame_len) * 1e4 + 0.5) / 1e4 AS std_packet_size, min(ts_us) AS first_us, max(ts_us) AS last_us
        FROM gaps GROUP BY "window" // 7, {KEY}""",
)
def flow_state_merge(spark, sf):
    """Daily partial states rolled up into weeks; the gaps are those inside the days."""
    days = flow_states(with_window(packets(spark, sf), WINDOW), WINDOW)
    keys = ["week", *FLOW_KEY]
    merged = merge_flow_states(days.withColumn("week", F.expr("window div 7")).drop("window"), keys)
    features = state_features(merged, keys=keys).select(*keys, "std_packet_size", "iat_std")
    both = merged.join(features, keys).select(*keys, "packets", "bytes", "gaps", "iat_std", "std_packet_size", "first_us", "last_us")
    return rounded(both, ["iat_std", "std_packet_size"])


@check("capture_bounded", f"WITH {PACKETS} SELECT seq, ts_us FROM packets WHERE ts_us < (SELECT min(ts_us) FROM packets) + 604800000000")
def capture_bounded(spark, sf):
    return bounded(packets(spark, sf), 7 * 24 * 60).select("seq", "ts_us")


@check(
    "flows_csv_roundtrip",
    f"""{UNI} SELECT "window", {KEY}, bidirectional_packets, bidirectional_bytes, tcp_syn_count,
        floor(iat_std * 1e4 + 0.5) / 1e4 AS iat_std, floor(mean_packet_size * 1e4 + 0.5) / 1e4 AS mean_packet_size, CAST(1 AS INTEGER) AS label FROM flows""",
)
def flows_csv_roundtrip(spark, sf):
    path = fresh_dir(spark, "flows-csv")
    write_flows(uni_flows(spark, sf), path, label=1, fmt="csv")
    back = read_flows(spark, path, "csv")
    return back.select(
        "window", *FLOW_KEY, "bidirectional_packets", "bidirectional_bytes", "tcp_syn_count",
        r4("iat_std").alias("iat_std"), r4("mean_packet_size").alias("mean_packet_size"), "label",
    )


@check(
    "flows_csv_any_order",
    f"""{UNI} SELECT "window", {KEY}, bidirectional_packets, tcp_syn_count, CAST(1 AS INTEGER) AS label,
        floor(iat_std * 1e4 + 0.5) / 1e4 AS iat_std FROM flows""",
)
def flows_csv_any_order(spark, sf):
    """Columns of a CSV file are found by name: label first, the rest backwards, and one that is not known."""
    path = fresh_dir(spark, "flows-any-order")
    table = uni_flows(spark, sf)
    table.select(F.lit(1).alias("label"), F.lit("x").alias("note"), *reversed(table.columns)).write.csv(path, header=True)
    back = read_flows(spark, path, "csv")
    return back.select("window", *FLOW_KEY, "bidirectional_packets", "tcp_syn_count", "label", r4("iat_std").alias("iat_std"))


@check(
    "packet_active_flows",
    f"""WITH {PACKETS}, {windowed('packets')} SELECT count(*) AS active_flows FROM (
          SELECT DISTINCT {KEY} FROM windowed WHERE "window" = (SELECT max("window") FROM windowed))""",
)
def packet_active_flows(spark, sf):
    return active_flows(with_window(packets(spark, sf), WINDOW))


@check("cic_flow_id", f"WITH {RAW} SELECT row_key, {flow_id_sql('c0')} FROM raw")
def cic_flow_id(spark, sf):
    return parse_flow_id(raw_labelled(spark, sf).select("row_key", "Flow ID"), "Flow ID")
