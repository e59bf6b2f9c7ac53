"""Alert logs and the questions asked of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.operators import rollup
from flowtide.operators.dashboards import (
    alert_rate,
    avg_score_series,
    by_level,
    last_alerts,
    newest,
    level_series,
    level_values,
    rate_series,
    top_ips,
)
from flowtide.schemas import ALERT
from flowtide.sources.tables import (
    parse_alert_lines,
    read_alert_store,
    read_alerts,
    store_alerts,
    with_alert_time,
    write_alerts,
    write_alerts_by_level,
)
from flowtide.storage import fresh_dir
from flowtide.streaming.alert_tail import read_rollup, start_alert_tail, tail_alerts

from .adapters import ALERTS, alert_rows
from .registry import check, r4, rounded, sql_r4

DAY = 86_400
PLAIN = '"timestamp", src_ip, dst_ip, src_port, dst_port, protocol, level, ts_us'
ALL = f"WITH {ALERTS} SELECT {PLAIN}, {sql_r4('score', 'score')} FROM alerts"


def _alerts(spark, sf):
    return with_alert_time(alert_rows(spark, sf))


def _stored(spark, sf):
    """The alerts in the store by day and level, and the time of the newest."""
    path = fresh_dir(spark, "alert-store")
    store_alerts(alert_rows(spark, sf), path)
    log = read_alert_store(spark, path)
    return log, newest(log)


def _shown(alerts):
    return rounded(alerts.withColumn("ts_us", F.unix_micros("ts")).drop("ts"), ["score"])


@check("alerts_parse", ALL)
def alerts_parse(spark, sf):
    lines = alert_rows(spark, sf).select(F.to_json(F.struct(*ALERT.names)).alias("value"))
    return _shown(parse_alert_lines(lines))


@check("alerts_csv_roundtrip", ALL)
def alerts_csv_roundtrip(spark, sf):
    path = fresh_dir(spark, "alerts-csv")
    write_alerts(alert_rows(spark, sf), path, "csv")
    return _shown(read_alerts(spark, path, "csv"))


@check("alerts_jsonl_roundtrip", ALL)
def alerts_jsonl_roundtrip(spark, sf):
    path = fresh_dir(spark, "alerts-json")
    for batch_id in (0, 0):  # a batch that is run again replaces its rows
        write_alerts(alert_rows(spark, sf), path, "json", batch_id)
    return _shown(read_alerts(spark, path, "json"))


@check("alerts_by_level_partition", f"WITH {ALERTS} SELECT level, count(*) AS n, min(ts_us) AS first_us, {sql_r4('avg(score)', 'avg_score')} FROM alerts GROUP BY level")
def alerts_by_level_partition(spark, sf):
    path = fresh_dir(spark, "alerts-level")
    write_alerts_by_level(alert_rows(spark, sf), path)
    back = with_alert_time(spark.read.parquet(path))
    return back.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.unix_micros("ts")).alias("first_us"), r4(F.avg("score")).alias("avg_score")
    )


def trailing(seconds: int) -> str:
    return f"ts_us > (SELECT max(ts_us) FROM alerts) - {seconds * 1_000_000}"


@check("dash_alert_rate", f"WITH {ALERTS} SELECT count(*) / 300.0 AS rate FROM alerts WHERE {trailing(300)}")
def dash_alert_rate(spark, sf):
    log, now = _stored(spark, sf)
    return alert_rate(log, as_of=now)


@check("dash_red_rate", f"WITH {ALERTS} SELECT count(*) FILTER (level = 'RED') / {DAY}.0 AS rate FROM alerts WHERE {trailing(DAY)}")
def dash_red_rate(spark, sf):
    log, now = _stored(spark, sf)
    return alert_rate(log, DAY, "RED", as_of=now)


@check("dash_level_series", f"WITH {ALERTS} SELECT ts_us // 3600000000 * 3600 AS step, level, count(*) AS n FROM alerts GROUP BY 1, 2")
def dash_level_series(spark, sf):
    return level_series(_alerts(spark, sf), 3600).withColumn("step", F.unix_seconds("step"))


@check("dash_avg_score", f"WITH {ALERTS} SELECT ts_us // 3600000000 * 3600 AS step, {sql_r4('avg(score)', 'avg_score')} FROM alerts GROUP BY 1")
def dash_avg_score(spark, sf):
    return rounded(avg_score_series(_alerts(spark, sf), 3600).withColumn("step", F.unix_seconds("step")), ["avg_score"])


@check(
    "dash_avg_score_by_label",
    f"WITH {ALERTS} SELECT ts_us // {DAY}000000 * {DAY} AS step, level, src_ip, dst_ip, {sql_r4('avg(score)', 'avg_score')} FROM alerts GROUP BY 1, 2, 3, 4",
)
def dash_avg_score_by_label(spark, sf):
    series = avg_score_series(_alerts(spark, sf), DAY, ["level", "src_ip", "dst_ip"])
    return rounded(series.withColumn("step", F.unix_seconds("step")), ["avg_score"])


@check("dash_top_src", f"WITH {ALERTS} SELECT src_ip, count(*) AS n FROM alerts WHERE {trailing(DAY)} GROUP BY src_ip ORDER BY n DESC, src_ip LIMIT 10")
def dash_top_src(spark, sf):
    log, now = _stored(spark, sf)
    return top_ips(log, "src_ip", DAY, as_of=now)


@check("dash_top_dst", f"WITH {ALERTS} SELECT dst_ip, count(*) AS n FROM alerts WHERE {trailing(DAY)} GROUP BY dst_ip ORDER BY n DESC, dst_ip LIMIT 10")
def dash_top_dst(spark, sf):
    log, now = _stored(spark, sf)
    return top_ips(log, "dst_ip", DAY, as_of=now)


@check(
    "dash_rate_series",
    f"""WITH {ALERTS}, seconds AS (SELECT level, ts_us // 1000000 AS second, count(*) AS n FROM alerts GROUP BY 1, 2)
        SELECT level, second, sum(n) OVER (PARTITION BY level ORDER BY second RANGE BETWEEN 6999 PRECEDING AND CURRENT ROW) / 7000.0 AS rate FROM seconds""",
)
def dash_rate_series(spark, sf):
    return rate_series(_alerts(spark, sf), 7000)


@check(
    "dash_last_200",
    f"""WITH {ALERTS} SELECT "timestamp", level, src_ip, split_part("timestamp", '+', 1) AS at,
          "timestamp" || ' ' || level || ' ' || src_ip || ':' || src_port || ' -> ' || dst_ip || ':' || dst_port AS head, protocol FROM alerts
        WHERE {trailing(6 * 3600)} ORDER BY ts_us DESC, src_ip, dst_ip, src_port, dst_port, protocol, score LIMIT 200""",
)
def dash_last_200(spark, sf):
    """The lines without the score, whose text form differs between engines."""
    log, now = _stored(spark, sf)
    last = last_alerts(log, as_of=now)
    head = F.substring_index("line", " score=", 1).alias("head")
    return last.select("timestamp", "level", "src_ip", F.split_part("timestamp", F.lit("+"), F.lit(1)).alias("at"), head, "protocol")


@check("dash_levels", f"WITH {ALERTS} SELECT DISTINCT level FROM alerts")
def dash_levels(spark, sf):
    return level_values(_alerts(spark, sf))


@check("dash_level_filter", f"WITH {ALERTS} SELECT src_ip, count(*) AS n FROM alerts WHERE level IN ('RED') GROUP BY src_ip")
def dash_level_filter(spark, sf):
    return by_level(_alerts(spark, sf), ["RED"]).groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"))


def rolled(spark, sf):
    """The rollup that a stream over the growing log keeps, in two runs with a restart between them."""
    log, out, checkpoint = (fresh_dir(spark, f"tail-{n}") for n in ("log", "out", "checkpoint"))
    rows = alert_rows(spark, sf)
    for step, part in enumerate((rows.where("src_port % 2 = 0"), rows.where("src_port % 2 = 1"))):
        write_alerts(part, f"{log}/step={step}")
        start_alert_tail(tail_alerts(spark, f"{log}/step=*"), out, checkpoint, {"availableNow": True}).awaitTermination()
    return read_rollup(spark, out)


NOW = "(SELECT (max(ts_us) + 999999) // 1000000 * 1000000 FROM alerts)"


@check("rollup_alert_rate", f"WITH {ALERTS} SELECT count(*) / {DAY}.0 AS rate FROM alerts WHERE ts_us > {NOW} - {DAY}000000")
def rollup_alert_rate(spark, sf):
    return rollup.alert_rate(rolled(spark, sf), DAY)


@check("rollup_red_rate", f"WITH {ALERTS} SELECT count(*) FILTER (level = 'RED') / 300.0 AS rate FROM alerts WHERE ts_us > {NOW} - 300000000")
def rollup_red_rate(spark, sf):
    return rollup.alert_rate(rolled(spark, sf), 300, "RED")


@check("rollup_level_series", f"WITH {ALERTS} SELECT ts_us // 3600000000 * 3600 AS step, level, count(*) AS n FROM alerts GROUP BY 1, 2")
def rollup_level_series(spark, sf):
    return rollup.level_series(rolled(spark, sf), 3600).withColumn("step", F.unix_seconds("step"))


@check(
    "rollup_avg_score_by_label",
    f"WITH {ALERTS} SELECT ts_us // {DAY}000000 * {DAY} AS step, level, src_ip, dst_ip, {sql_r4('avg(score)', 'avg_score')} FROM alerts GROUP BY 1, 2, 3, 4",
)
def rollup_avg_score_by_label(spark, sf):
    series = rollup.avg_score_series(rolled(spark, sf), DAY, ["level", "src_ip", "dst_ip"])
    return rounded(series.withColumn("step", F.unix_seconds("step")), ["avg_score"])


@check("rollup_top_src", f"WITH {ALERTS} SELECT src_ip, count(*) AS n FROM alerts WHERE ts_us > {NOW} - {DAY}000000 GROUP BY src_ip ORDER BY n DESC, src_ip LIMIT 10")
def rollup_top_src(spark, sf):
    return rollup.top_ips(rolled(spark, sf), "src_ip", DAY)


@check(
    "rollup_rate_series",
    f"""WITH {ALERTS}, seconds AS (SELECT level, ts_us // 1000000 AS second, count(*) AS n FROM alerts GROUP BY 1, 2)
        SELECT level, second, sum(n) OVER (PARTITION BY level ORDER BY second RANGE BETWEEN 6999 PRECEDING AND CURRENT ROW) / 7000.0 AS rate FROM seconds""",
)
def rollup_rate_series(spark, sf):
    return rollup.rate_series(rolled(spark, sf), 7000)
