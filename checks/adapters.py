"""Test tables seen as packets, packet lines, labelled flow text and alerts; each in Spark and in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.operators.features import Scaler
from flowtide.operators.forest import Forest
from flowtide.operators.flows import flows
from flowtide.plans.detect import score_flows
from flowtide.schemas import ALERT, FLOW_KEY
from flowtide.sources.registry import Model
from flowtide.storage import fresh_dir

WINDOW = 86_400
AS_OF = "2024-02-01T00:00:00.000000+00:00"
RED, YELLOW = -0.25, 0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> packets; every third event is an answer of the server."""
    u = F.col("user_id")
    ends = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.expr("concat('10.0.', user_id div 256, '.', user_id % 256)").alias("c_ip"),
        (u + 1024).cast("int").alias("c_port"),
        F.lit("192.168.1.10").alias("s_ip"),
        F.expr("CASE user_id % 4 WHEN 0 THEN 53 WHEN 1 THEN 80 WHEN 2 THEN 443 ELSE 22 END").alias("s_port"),
        F.when(u % 4 == 0, "udp").otherwise("tcp").alias("protocol"),
        (F.lit(40) + F.floor(F.col("value") * 10) % 1460).cast("int").alias("frame_len"),
        *[(F.col("event_type") == kind).cast("int").alias(f) for f, kind in [("syn", "signup"), ("fin", "purchase"), ("rst", "error")]],
    )
    answer = F.col("seq") % 3 == 0

    def side(a, b):
        return F.when(answer, F.col(a)).otherwise(F.col(b))

    return ends.select(
        "seq", "ts_us",
        side("s_ip", "c_ip").alias("src_ip"), side("c_ip", "s_ip").alias("dst_ip"),
        side("s_port", "c_port").alias("src_port"), side("c_port", "s_port").alias("dst_port"),
        "protocol", "frame_len", "syn", "fin", "rst",
    )


PACKETS = """packets AS (
  SELECT seq, ts_us,
         CASE WHEN seq % 3 = 0 THEN s_ip ELSE c_ip END AS src_ip,
         CASE WHEN seq % 3 = 0 THEN c_ip ELSE s_ip END AS dst_ip,
         CASE WHEN seq % 3 = 0 THEN s_port ELSE c_port END AS src_port,
         CASE WHEN seq % 3 = 0 THEN c_port ELSE s_port END AS dst_port,
         protocol, frame_len, syn, fin, rst
  FROM (SELECT event_id AS seq, epoch_us(ts) AS ts_us,
               '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS c_ip,
               CAST(user_id + 1024 AS INTEGER) AS c_port,
               '192.168.1.10' AS s_ip,
               CASE user_id % 4 WHEN 0 THEN 53 WHEN 1 THEN 80 WHEN 2 THEN 443 ELSE 22 END AS s_port,
               CASE WHEN user_id % 4 = 0 THEN 'udp' ELSE 'tcp' END AS protocol,
               CAST(40 + CAST(floor(value * 10) AS BIGINT) % 1460 AS INTEGER) AS frame_len,
               CAST(event_type = 'signup' AS INTEGER) AS syn,
               CAST(event_type = 'purchase' AS INTEGER) AS fin,
               CAST(event_type = 'error' AS INTEGER) AS rst
        FROM events)
)"""

CANONICAL = """canonical AS (
  SELECT *, CASE WHEN swap THEN dst_ip ELSE src_ip END AS a_ip, CASE WHEN swap THEN dst_port ELSE src_port END AS a_port,
         CASE WHEN swap THEN src_ip ELSE dst_ip END AS b_ip, CASE WHEN swap THEN src_port ELSE dst_port END AS b_port
  FROM (SELECT *, (src_num > dst_num) OR (src_num = dst_num AND src_port > dst_port) AS swap
        FROM (SELECT *,
                list_reduce(list_transform(string_split(src_ip, '.'), lambda x: x::BIGINT), lambda a, x: a * 256 + x) AS src_num,
                list_reduce(list_transform(string_split(dst_ip, '.'), lambda x: x::BIGINT), lambda a, x: a * 256 + x) AS dst_num
              FROM packets))
)"""


def windowed(source: str, window: int = WINDOW, name: str = "windowed") -> str:
    return f"""{name} AS (
  SELECT *, (ts_us - (SELECT min(ts_us) FROM {source})) // {window * 1_000_000} AS "window" FROM {source}
)"""


KEY = ", ".join(FLOW_KEY)
ENDS_BI = 'a_ip AS src_ip, b_ip AS dst_ip, a_port AS src_port, b_port AS dst_port, protocol, ts_us, seq, frame_len, syn, fin, rst'


def flows_cte(source: str = "windowed", name: str = "flows", key: str = KEY) -> str:
    """Unrounded flow features of a windowed packet relation."""
    return f"""{name} AS (
  SELECT "window", {key}, packets AS bidirectional_packets, bytes AS bidirectional_bytes, bytes / packets AS mean_packet_size,
         std AS std_packet_size, dur AS flow_duration, tcp_syn_count, tcp_fin_count, tcp_rst_count, iat_mean, iat_std,
         bytes / packets AS bytes_per_packet, packets / dur AS packets_per_second
  FROM (SELECT "window", {key}, count(*) AS packets, CAST(sum(frame_len) AS BIGINT) AS bytes, stddev_pop(frame_len) AS std,
               greatest(1e-6, (max(ts_us) - min(ts_us)) / 1e6) AS dur,
               CAST(sum(CASE WHEN protocol = 'tcp' THEN syn ELSE 0 END) AS BIGINT) AS tcp_syn_count,
               CAST(sum(CASE WHEN protocol = 'tcp' THEN fin ELSE 0 END) AS BIGINT) AS tcp_fin_count,
               CAST(sum(CASE WHEN protocol = 'tcp' THEN rst ELSE 0 END) AS BIGINT) AS tcp_rst_count,
               coalesce(CAST(sum(gap) AS BIGINT) / count(gap) / 1e6, 0.0) AS iat_mean,
               coalesce(stddev_pop(gap), 0.0) / 1e6 AS iat_std
        FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY "window", {key} ORDER BY ts_us, seq) AS gap FROM {source})
        GROUP BY "window", {key})
)"""


ROUNDED = ["mean_packet_size", "std_packet_size", "flow_duration", "iat_mean", "iat_std", "bytes_per_packet", "packets_per_second"]
FLOW_SELECT = f"""SELECT "window", {KEY}, bidirectional_packets, bidirectional_bytes, tcp_syn_count, tcp_fin_count, tcp_rst_count,
  {", ".join(f"floor({c} * 1e4 + 0.5) / 1e4 AS {c}" for c in ROUNDED)} FROM flows"""

UNI = f"WITH {PACKETS}, {windowed('packets')}, {flows_cte()}"
UNI_SQL = f"{UNI} {FLOW_SELECT}"


def uni_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(packets(spark, sf_dir), WINDOW)


# A literal forest of two trees; features in the order below; fitted on 256 rows.
FIXED_FEATURES = ["bidirectional_packets", "mean_packet_size", "flow_duration"]
FIXED_NODES = [
    # tree, node, feature, threshold, left, right, size, depth
    (0, 0, 1, 600.0, 1, 2, 256, 0),
    (0, 1, 0, 1.5, 3, 4, 200, 1),
    (0, 2, -1, 0.0, -1, -1, 56, 1),
    (0, 3, -1, 0.0, -1, -1, 150, 2),
    (0, 4, 2, 3600.0, 5, 6, 50, 2),
    (0, 5, -1, 0.0, -1, -1, 2, 3),
    (0, 6, -1, 0.0, -1, -1, 48, 3),
    (1, 0, 2, 10.0, 1, 2, 256, 0),
    (1, 1, 1, 1000.0, 3, 4, 180, 1),
    (1, 2, 0, 3.5, 5, 6, 76, 1),
    (1, 3, -1, 0.0, -1, -1, 179, 2),
    (1, 4, -1, 0.0, -1, -1, 1, 2),
    (1, 5, -1, 0.0, -1, -1, 70, 2),
    (1, 6, -1, 0.0, -1, -1, 6, 2),
]
FIXED_OFFSET = -0.55
FIXED_RED, FIXED_YELLOW = -0.07, 0.0


def fixed_model() -> Model:
    names = ["tree", "node", "feature", "threshold", "left", "right", "size", "depth"]
    forest = Forest.from_nodes(pd.DataFrame(FIXED_NODES, columns=names), FIXED_FEATURES, 256)
    scaler = Scaler(FIXED_FEATURES, [0.0] * 3, [1.0] * 3)
    return Model(scaler, forest, FIXED_OFFSET, FIXED_RED, FIXED_YELLOW)


def _path(size: int, depth: int) -> str:
    if size > 2:
        return f"({depth} + 2 * (ln({size} - 1) + 0.5772156649) - 2.0 * ({size} - 1) / {size})"
    return f"({depth} + {1 if size == 2 else 0})"


def _tree_sql(tree: int, node: int) -> str:
    _, _, feature, threshold, left, right, size, depth = next(n for n in FIXED_NODES if n[0] == tree and n[1] == node)
    if feature < 0:
        return _path(size, depth)
    return f"CASE WHEN {FIXED_FEATURES[feature]} <= {threshold} THEN {_tree_sql(tree, left)} ELSE {_tree_sql(tree, right)} END"


SCORED = f"""scored AS (
  SELECT *, -pow(2, -(({_tree_sql(0, 0)}) + ({_tree_sql(1, 0)})) / 2 / {_path(256, 0)}) - ({FIXED_OFFSET}) AS score FROM flows
)"""


def scored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_flows(uni_flows(spark, sf_dir), fixed_model())


# Labels for the training queries: a reset was seen, or the client is one of the first of each fifty.
LABEL_SQL = "CASE WHEN tcp_rst_count > 0 OR greatest(src_port, dst_port) % 50 = 24 THEN 1 ELSE 0 END"
LABELLED = f"labelled AS (SELECT *, {LABEL_SQL} AS label FROM scored)"


def with_label(table: DataFrame) -> DataFrame:
    return table.withColumn("label", F.expr(LABEL_SQL))


def alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> alert rows: the score falls with the value; some time stamps have no offset."""
    ev = table(spark, sf_dir, "events")
    score = (F.lit(50.0) - F.col("value")) / F.lit(400.0)
    ts = F.col("ts").cast("timestamp")
    rows = ev.select(
        F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("event_type") == "view", "").otherwise("+00:00")).alias("timestamp"),
        F.expr("concat('10.0.', user_id div 256, '.', user_id % 256)").alias("src_ip"),
        F.expr("concat('192.168.1.', user_id % 4)").alias("dst_ip"),
        (F.col("user_id") + 1024).cast("int").alias("src_port"),
        F.expr("CASE user_id % 4 WHEN 0 THEN 53 WHEN 1 THEN 80 WHEN 2 THEN 443 ELSE 22 END").alias("dst_port"),
        F.when(F.col("user_id") % 4 == 0, "udp").otherwise("tcp").alias("protocol"),
        score.alias("score"),
        F.when(score < RED, "RED").otherwise("YELLOW").alias("level"),
    ).where(score < YELLOW)
    return rows.select([F.col(f.name).cast(f.dataType) for f in ALERT])


ALERTS = f"""alerts AS (
  SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || CASE WHEN event_type = 'view' THEN '' ELSE '+00:00' END AS "timestamp",
         '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS src_ip, '192.168.1.' || (user_id % 4) AS dst_ip,
         CAST(user_id + 1024 AS INTEGER) AS src_port,
         CASE user_id % 4 WHEN 0 THEN 53 WHEN 1 THEN 80 WHEN 2 THEN 443 ELSE 22 END AS dst_port,
         CASE WHEN user_id % 4 = 0 THEN 'udp' ELSE 'tcp' END AS protocol,
         (50.0 - value) / 400.0 AS score,
         CASE WHEN (50.0 - value) / 400.0 < {RED} THEN 'RED' ELSE 'YELLOW' END AS level,
         epoch_us(ts) AS ts_us
  FROM events WHERE (50.0 - value) / 400.0 < {YELLOW}
)"""


LINE_EXPR_SPARK = """
CASE WHEN event_id % 31 = 0 THEN 'Capturing on ''eth0'''
     WHEN event_id % 37 = 0 THEN 'tshark: note'
     WHEN event_id % 41 = 0 THEN '   '
     WHEN event_id % 17 = 0 THEN concat_ws(',', secs, src_ip, dst_ip)
     ELSE concat_ws(',', CASE event_id % 59 WHEN 1 THEN '99999999999999.0' WHEN 2 THEN '1e400' WHEN 3 THEN '-' WHEN 4 THEN 'nan'
                              WHEN 5 THEN '123456789012345678901234567890' ELSE secs END, CASE WHEN event_id % 19 = 0 THEN '' ELSE src_ip END, dst_ip,
          CASE WHEN protocol = 'udp' OR event_id % 29 = 0 THEN '' ELSE sp END,
          CASE WHEN protocol = 'udp' OR event_id % 29 = 0 OR event_id % 43 = 0 THEN '' ELSE dp END,
          CASE WHEN protocol = 'tcp' OR event_id % 29 = 0 THEN '' ELSE sp END,
          CASE WHEN protocol = 'tcp' OR event_id % 29 = 0 THEN '' ELSE dp END,
          CASE WHEN event_id % 23 = 0 THEN 'x' WHEN event_id % 47 = 0 THEN '' WHEN event_id % 53 = 0 THEN '99999999999' ELSE len END,
          CASE WHEN syn = 1 THEN 'True' ELSE 'False' END,
          CASE WHEN fin = 1 THEN ' 42 ' ELSE '' END,
          CASE WHEN rst = 1 THEN 'y' ELSE '0xff' END)
END"""


def packet_lines(spark: SparkSession, sf_dir: str, wanted: str = "TRUE") -> DataFrame:
    """packets (or those ``wanted``) -> decoded text lines with rejects and status lines among them."""
    p = packets(spark, sf_dir).where(wanted).withColumnRenamed("seq", "event_id")
    secs = F.expr("concat(ts_us div 1000000, '.', lpad(cast(ts_us % 1000000 as string), 6, '0'))")
    text = p.withColumns({"secs": secs, "sp": F.col("src_port").cast("string"), "dp": F.col("dst_port").cast("string"), "len": F.col("frame_len").cast("string")})
    return text.select(F.expr(LINE_EXPR_SPARK).alias("value"))


def packet_files(spark: SparkSession, sf_dir: str) -> str:
    """The lines as text files in the shared folder."""
    path = fresh_dir(spark, "packet-lines")
    packet_lines(spark, sf_dir).write.text(path)
    return path


LINES = f"""{PACKETS}, lines AS (
  SELECT event_id AS seq, {LINE_EXPR_SPARK} AS value
  FROM (SELECT *, seq AS event_id, (ts_us // 1000000) || '.' || lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0') AS secs,
               CAST(src_port AS VARCHAR) AS sp, CAST(dst_port AS VARCHAR) AS dp, CAST(frame_len AS VARCHAR) AS len FROM packets)
), fields AS (
  SELECT seq, string_split(trim(value), ',') AS f FROM lines
  WHERE trim(value) <> '' AND NOT starts_with(trim(value), 'Capturing on') AND NOT starts_with(trim(value), 'tshark:')
), parsed AS (
  SELECT seq, CASE WHEN regexp_full_match(f[1], '[0-9]{{1,11}}[.][0-9]{{6}}') THEN CAST(CAST(f[1] AS DECIMAL(24,6)) * 1000000 AS BIGINT) END AS ts_us, nullif(f[2], '') AS src_ip, nullif(f[3], '') AS dst_ip,
         CASE WHEN f[4] <> '' OR f[5] <> '' THEN 'tcp' WHEN f[6] <> '' OR f[7] <> '' THEN 'udp' END AS protocol,
         CASE WHEN f[4] <> '' OR f[5] <> '' THEN TRY_CAST(coalesce(nullif(f[4], ''), '0') AS INTEGER) ELSE TRY_CAST(coalesce(nullif(f[6], ''), '0') AS INTEGER) END AS src_port,
         CASE WHEN f[4] <> '' OR f[5] <> '' THEN TRY_CAST(coalesce(nullif(f[5], ''), '0') AS INTEGER) ELSE TRY_CAST(coalesce(nullif(f[7], ''), '0') AS INTEGER) END AS dst_port,
         TRY_CAST(coalesce(nullif(f[8], ''), '0') AS INTEGER) AS frame_len,
         CAST(f[9] = 'True' AS INTEGER) AS syn, CAST(trim(f[10]) = '42' AS INTEGER) AS fin, CAST(f[11] = 'y' AS INTEGER) AS rst,
         len(f) >= 11 AS enough
  FROM fields
), judged AS (
  SELECT *, coalesce(enough AND ts_us IS NOT NULL AND src_ip IS NOT NULL AND dst_ip IS NOT NULL AND protocol IS NOT NULL
                     AND src_port IS NOT NULL AND dst_port IS NOT NULL AND frame_len IS NOT NULL, FALSE) AS valid
  FROM parsed
)"""

# lineitem -> text columns of a labelled flow data set.
RAW_COLUMNS = {
    "Flow ID": """CASE l_orderkey % 3 WHEN 0 THEN concat('10.1.', l_partkey % 256, '.', l_suppkey % 256, ':', l_partkey % 60000, '-192.168.0.', l_suppkey % 250, ':', l_suppkey % 1000, '-6')
      WHEN 1 THEN concat('172.16.', l_partkey % 256, '.', l_suppkey % 256, '-192.168.1.', l_suppkey % 250, '-', l_partkey % 60000, '-', l_suppkey % 1000, '-17')
      ELSE 'unreadable' END""",
    "Src Port": "concat('', l_partkey % 65536)",
    " Dst Port": "CASE WHEN l_linenumber = 7 THEN 'x' ELSE concat('', l_suppkey % 65536) END",
    "Protocol": "CASE l_linenumber % 4 WHEN 0 THEN '0' WHEN 1 THEN '6' WHEN 2 THEN '17' ELSE ' TCP ' END",
    "Flow Duration": "CASE WHEN l_tax = 0 THEN 'NaN' WHEN l_tax = 0.01 THEN 'bad' ELSE concat('', CAST(l_quantity AS BIGINT) * 100000) END",
    "Tot Fwd Pkts": "concat('', l_linenumber - 1)",
    "Tot Bwd Pkts": "CASE WHEN l_discount = 0 THEN 'Infinity' WHEN l_discount = 0.01 THEN NULL ELSE concat('', CAST(l_quantity AS BIGINT)) END",
    "TotLen Fwd Pkts": "concat('', CAST(floor(l_extendedprice) AS BIGINT))",
    "TotLen Bwd Pkts": "concat('', CAST(floor(l_extendedprice / 2) AS BIGINT) - 20000)",
    "Flow IAT Mean": "concat('', CAST(floor(l_extendedprice * 10) AS BIGINT))",
    "Flow IAT Std": "CASE WHEN l_linenumber = 5 THEN NULL ELSE concat('', CAST(floor(l_extendedprice) AS BIGINT)) END",
    "SYN Flag Cnt": "CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '0' ELSE '2.9' END",
    "FIN Flag Cnt": "CASE l_returnflag WHEN 'A' THEN '' ELSE '1' END",
    "RST Flag Cnt": "CASE l_linestatus WHEN 'O' THEN '1' ELSE 'n/a' END",
    "Pkt  Len/Std": "concat('', CAST(l_quantity AS BIGINT) * 3)",
    "Label": "CASE l_returnflag WHEN 'N' THEN ' Benign ' WHEN 'R' THEN 'DDoS' END",
}
ROW_KEY = """concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT), '-', l_returnflag, l_linestatus, '-', {day})"""


def raw_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    key = F.expr(ROW_KEY.format(day="date_format(l_shipdate, 'yyyyMMdd')")).alias("row_key")
    return li.select(key, *[F.expr(e).alias(n) for n, e in RAW_COLUMNS.items()])


RAW = "raw AS (SELECT {key} AS row_key, {cols} FROM lineitem)".format(
    key=ROW_KEY.format(day="strftime(l_shipdate, '%Y%m%d')"),
    cols=", ".join(f'{e} AS c{i}' for i, e in enumerate(RAW_COLUMNS.values())),
)


def _num(c: str) -> str:
    """A number or 0; garbage, NaN and null are 0."""
    return f"coalesce(CASE WHEN isnan(TRY_CAST({c} AS DOUBLE)) THEN NULL ELSE TRY_CAST({c} AS DOUBLE) END, 0.0)"


def _count(e: str) -> str:
    return f"coalesce(TRY_CAST(CASE WHEN isinf({e}) THEN NULL ELSE trunc({e}) END AS BIGINT), 0)"


_P1 = r"'^([^:]+):(\d+)-([^:]+):(\d+)-(.+)$'"
_P2 = r"'^([^-]+)-([^-]+)-(\d+)-(\d+)-(.+)$'"


def flow_id_sql(c: str) -> str:
    def either(a, b):
        return f"coalesce(nullif(regexp_extract({c}, {_P1}, {a}), ''), nullif(regexp_extract({c}, {_P2}, {b}), ''))"

    return f"""coalesce({either(1, 1)}, '0.0.0.0') AS src_ip, coalesce({either(3, 2)}, '0.0.0.0') AS dst_ip,
       coalesce(TRY_CAST({either(2, 3)} AS INTEGER), 0) AS src_port, coalesce(TRY_CAST({either(4, 4)} AS INTEGER), 0) AS dst_port"""


NORMALISED = f"""normalised AS (
  SELECT row_key, src_ip, dst_ip, src_port, dst_port, protocol, flow_duration, bidirectional_packets, bidirectional_bytes,
         bidirectional_bytes / bidirectional_packets AS mean_packet_size, std_packet_size, tcp_syn_count, tcp_fin_count, tcp_rst_count,
         iat_mean, iat_std, bidirectional_bytes / bidirectional_packets AS bytes_per_packet,
         bidirectional_packets / flow_duration AS packets_per_second, label
  FROM (SELECT row_key, {flow_id_sql('c0')},
               CASE WHEN lower(trim(c3)) IN ('tcp', '6') THEN 'tcp' WHEN lower(trim(c3)) IN ('udp', '17') THEN 'udp' ELSE 'other' END AS protocol,
               greatest(1e-6, {_num('c4')} / 1e6) AS flow_duration,
               greatest(1, {_count(_num('c5') + ' + ' + _num('c6'))}) AS bidirectional_packets,
               greatest(0, {_count(_num('c7') + ' + ' + _num('c8'))}) AS bidirectional_bytes,
               {_num('c14')} AS std_packet_size, {_count(_num('c11'))} AS tcp_syn_count, {_count(_num('c12'))} AS tcp_fin_count,
               {_count(_num('c13'))} AS tcp_rst_count, {_num('c9')} / 1e6 AS iat_mean, {_num('c10')} / 1e6 AS iat_std,
               CAST(coalesce(upper(trim(c15)), 'NAN') <> 'BENIGN' AS INTEGER) AS label
        FROM raw)
  WHERE protocol IN ('tcp', 'udp')
)"""
