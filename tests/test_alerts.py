from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowtide.operators.alerts import iso_utc, level_column, log_line, resolve_threshold, score_stats, threshold_columns, to_alerts
from flowtide.operators.dashboards import alert_rate, avg_score_series, by_level, last_alerts, level_series, rate_series, top_ips
from flowtide.schemas import ALERT
from flowtide.sources.tables import (
    parse_alert_lines,
    read_alerts,
    read_flows,
    with_alert_time,
    write_alerts,
    write_alerts_by_level,
    write_flows,
)

FLOWS = [
    ("172.20.0.4", "10.9.0.11", 40100, 25, "udp", -0.31),
    ("172.20.0.5", "10.9.0.12", 40200, 993, "tcp", -0.08),
    ("172.20.0.6", "10.9.0.13", 40300, 161, "udp", 0.15),
]
DDL = "src_ip string, dst_ip string, src_port bigint, dst_port bigint, protocol string, score double"
AS_OF = "2023-03-04T05:06:07.000008"


@pytest.fixture
def scored(spark):
    return spark.createDataFrame(FLOWS, DDL)


def test_levels_and_fields(scored):
    rows = to_alerts(scored, -0.1, -0.05, AS_OF).orderBy("score").collect()
    assert [tuple(r) for r in rows] == [
        (AS_OF, "172.20.0.4", "10.9.0.11", 40100, 25, "udp", -0.31, "RED"),
        (AS_OF, "172.20.0.5", "10.9.0.12", 40200, 993, "tcp", -0.08, "YELLOW"),
    ]
    assert [(f.name, f.dataType) for f in to_alerts(scored, -0.1, -0.05).schema] == [(f.name, f.dataType) for f in ALERT]


def test_thresholds_are_strict(spark):
    table = spark.createDataFrame([(-0.1,), (-0.05,), (-0.100001,)], "s double")
    assert [r[0] for r in table.select(level_column(F.col("s"), -0.1, -0.05)).collect()] == ["YELLOW", None, "RED"]


def test_no_alerts(spark, scored):
    assert to_alerts(scored.where("score > 0"), -0.1, -0.05).count() == 0
    assert to_alerts(scored.limit(0), -0.1, -0.05).count() == 0


def test_detection_time_is_one_and_iso(scored):
    stamps = {r.timestamp for r in to_alerts(scored, 0.0, 1.0).collect()}
    assert len(stamps) == 1
    assert datetime.fromisoformat(stamps.pop()).tzinfo is not None


def test_times_do_not_depend_on_the_session_zone(spark):
    text = ["2024-07-01T12:00:00.250000+00:00", "2024-07-01T12:00:00.25", "2024-07-01T14:00:00.25+02:00", "2024-07-01T12:00:00.25Z"]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        table = with_alert_time(spark.createDataFrame([(t,) for t in text], "timestamp string"))
        assert {r[0] for r in table.select(iso_utc(F.col("ts"))).collect()} == {text[0]}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stats_and_lines(scored):
    r = score_stats(scored).first()
    assert (r.n, r.min_score, r.max_score) == (3, -0.31, 0.15) and r.mean_score == pytest.approx(-0.08)
    lines = [r.line for r in log_line(to_alerts(scored, -0.1, -0.05, AS_OF)).orderBy("score").collect()]
    assert lines[0] == "ANOMALY RED 172.20.0.4:40100 -> 10.9.0.11:25 UDP score=-0.3100"
    assert lines[1].startswith("Anomaly YELLOW 172.20.0.5:40200")


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_sinks_append_and_replace_batches(spark, scored, tmp_path, fmt):
    alerts = to_alerts(scored, -0.1, -0.05, AS_OF)
    write_alerts(alerts, str(tmp_path / "a"), fmt)
    write_alerts(alerts, str(tmp_path / "a"), fmt)
    assert read_alerts(spark, str(tmp_path / "a"), fmt).count() == 4
    for batch in (0, 1, 1):
        write_alerts(alerts, str(tmp_path / "b"), fmt, batch)
    back = read_alerts(spark, str(tmp_path / "b"), fmt)
    assert back.count() == 4
    assert sorted(back.select(*ALERT.names).distinct().collect()) == sorted(alerts.collect())


def test_empty_csv_has_a_header(spark, scored, tmp_path):
    write_alerts(to_alerts(scored.limit(0), 0, 0, AS_OF), str(tmp_path / "a"), "csv")
    text = "".join(p.read_text() for p in (tmp_path / "a").glob("part-*"))
    assert text == "timestamp,src_ip,dst_ip,src_port,dst_port,protocol,score,level\n"


def test_missing_field_is_null(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"timestamp": "2025-08-10T14:56:25", "src_ip": "1.1.1.1", "score": -0.1, "level": "RED"}\n')
    r = read_alerts(spark, str(tmp_path)).first()
    assert r.dst_ip is None and r.src_port is None and r.ts == datetime(2025, 8, 10, 14, 56, 25)


def test_level_partitions(spark, scored, tmp_path):
    path = str(tmp_path / "a")
    write_alerts_by_level(to_alerts(scored, -0.1, -0.05, AS_OF), path)
    assert sorted(p.name for p in (tmp_path / "a").glob("level=*")) == ["level=RED", "level=YELLOW"]
    plan = spark.read.parquet(path).where("level = 'RED'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan


def test_alert_lines_with_garbage(spark):
    lines = spark.createDataFrame([('{"timestamp": "2025-08-10T14:56:25.5+00:00", "level": "RED", "score": -0.5}',), ("garbage",)], "value string")
    rows = parse_alert_lines(lines).collect()
    assert rows[0].ts == datetime(2025, 8, 10, 14, 56, 25, 500000) and rows[0].score == -0.5
    assert rows[1].ts is None and rows[1].level is None


THRESHOLDS = [
    ('{"red_threshold": -0.1, "yellow_threshold": -0.05}', None, None, (-0.1, -0.05)),
    ('{"red_threshold": -0.25, "yellow_threshold": "0.00"}', None, None, (-0.25, 0.0)),
    ('{"red_threshold": -0.1, "yellow_threshold": -0.05}', "-0.2", " -0.15 ", (-0.2, -0.15)),
    ('{"red_threshold": -0.1, "yellow_threshold": -0.05}', "not_a_number", "", (-0.1, -0.05)),
    ('{"yellow_threshold": 0.3}', None, None, (-0.25, 0.3)),
    ('{"red_threshold": -0.1, "yellow_threshold": "low"}', None, None, (-0.25, 0.0)),
    ("no json", None, "0.14", (-0.25, 0.14)),
    (None, None, None, (-0.25, 0.0)),
]


@pytest.mark.parametrize("doc, red, yellow, want", THRESHOLDS)
def test_threshold_columns(spark, doc, red, yellow, want):
    table = spark.createDataFrame([(doc, red, yellow)], "d string, r string, y string")
    assert tuple(table.select(*threshold_columns(F.col("d"), F.col("r"), F.col("y"))).first()) == want


@pytest.mark.parametrize("override, want", [(None, 1.0), ("2", 2.0), (" -3.5 ", -3.5), ("x", 1.0), ("", 1.0), (4, 4.0)])
def test_resolve_threshold(override, want):
    assert resolve_threshold(1.0, override) == want


def alert_table(spark, rows):
    full = [(f"2024-01-01T00:{m:02d}:{s:02d}", src, "d", 1, 2, "tcp", score, level) for m, s, src, score, level in rows]
    return with_alert_time(spark.createDataFrame(full, ALERT))


def test_dashboard_questions(spark):
    rows = [(0, 0, "a", -0.1, "YELLOW"), (5, 0, "a", -0.3, "RED"), (5, 1, "b", -0.4, "RED"), (9, 59, "c", -0.2, "YELLOW"), (10, 0, "c", -0.5, "RED")]
    alerts = alert_table(spark, rows)
    assert alert_rate(alerts).first().rate == 3 / 300
    assert alert_rate(alerts, level="RED").first().rate == 2 / 300
    assert alert_rate(alerts, as_of=datetime(2024, 1, 1, 0, 5, 0)).first().rate == 1 / 300
    assert alert_rate(alerts, as_of=datetime(2025, 1, 1)).first().rate == 0
    series = {(r.step.minute, r.level): r.n for r in level_series(alerts, 300).collect()}
    assert series == {(0, "YELLOW"): 1, (5, "RED"): 2, (5, "YELLOW"): 1, (10, "RED"): 1}
    assert {r.step.minute: round(r.avg_score, 6) for r in avg_score_series(alerts, 300).collect()} == {0: -0.1, 5: -0.3, 10: -0.5}
    assert [tuple(r) for r in top_ips(alerts, "src_ip", 600).collect()] == [("c", 2), ("a", 1), ("b", 1)]
    assert [tuple(r) for r in top_ips(alerts, "src_ip", 600, k=1).collect()] == [("c", 2)]
    lines = [r.line for r in last_alerts(alerts, n=2).collect()]
    assert lines[0] == "2024-01-01T00:10:00 RED c:1 -> d:2 score=-0.5 protocol=tcp" and len(lines) == 2
    assert by_level(alerts, ["RED"]).count() == 3 and by_level(alerts).count() == 5


def test_rate_series_equals_brute_force(spark):
    import random

    rnd = random.Random(4)
    seconds = [rnd.randrange(20_000) for _ in range(1500)]
    rows = [(s, "RED" if rnd.random() < 0.8 else "YELLOW") for s in seconds]
    alerts = spark.createDataFrame(rows, "s bigint, level string").select(F.timestamp_seconds("s").alias("ts"), "level")
    for span in (300, 5000):
        got = {(r.level, r.second): r.rate for r in rate_series(alerts, span).collect()}
        want = {(lv, s): sum(l2 == lv and s - span < s2 <= s for s2, l2 in rows) / span for s, lv in set(rows)}
        assert got == pytest.approx(want)


def test_flow_tables(spark, tmp_path):
    from flowtide.sources.synthetic import synthetic_flows

    flows = synthetic_flows(spark, 5, 1, 1).drop("label")
    for fmt in ("csv", "parquet"):
        write_flows(flows, str(tmp_path / fmt), label=1, fmt=fmt)
        back = read_flows(spark, str(tmp_path / fmt), fmt)
        assert back.columns == [*flows.columns, "label"] and {r.label for r in back.collect()} == {1}
    write_flows(flows.limit(0), str(tmp_path / "none"), label=0)
    with pytest.raises(ValueError):
        read_flows(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("tracked", [8192, 16])
def test_top_addresses_by_sketch_are_exact(spark, monkeypatch, tracked):
    """Skewed and flat counts, ties and nulls; with a sketch that is too small all addresses are counted."""
    from flowtide.operators import dashboards

    monkeypatch.setattr(dashboards, "TRACKED", tracked)
    base = spark.range(20_000).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) - F.col("id") % 300))
    skewed = F.concat(F.lit("10.0.0."), F.floor(F.sqrt(F.pmod(F.xxhash64("id"), F.lit(10_000)))).cast("string"))
    kinds = {"skewed": skewed, "flat": F.concat(F.lit("ip"), (F.col("id") % 5000).cast("string")),
             "few": F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string"))}
    for name, ip in kinds.items():
        alerts = base.withColumn("src_ip", ip)
        got = [tuple(r) for r in dashboards.top_ips(alerts, "src_ip", 400, 10).collect()]
        counts = alerts.groupBy("src_ip").count().orderBy(F.desc("count"), "src_ip").limit(10).collect()
        assert got == [tuple(r) for r in counts], name
    assert dashboards.top_ips(base.limit(0).withColumn("src_ip", F.lit("x")), "src_ip").collect() == []


def test_compaction_changes_no_answer_at_any_time(spark, tmp_path, monkeypatch):
    """The same rows before, after the new files are written but not committed, and after; then again with more alerts."""
    from flowtide.sources import tables

    path = str(tmp_path / "store")
    base = spark.range(600).select(
        F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 400), "yyyy-MM-dd'T'HH:mm:ss+00:00").alias("timestamp"),
        F.concat(F.lit("10.0.0."), F.col("id") % 7).alias("src_ip"), F.lit("10.9.9.9").alias("dst_ip"), F.lit(1).alias("src_port"),
        F.lit(2).alias("dst_port"), F.lit("tcp").alias("protocol"), (-F.col("id") / 1000).alias("score"),
        F.when(F.col("id") % 3 == 0, "RED").otherwise("YELLOW").alias("level"))
    for part in range(4):
        tables.store_alerts(base.where(F.col("score") * -1000 % 4 == part), path)

    def shown():
        return sorted(tuple(r) for r in tables.read_alert_store(spark, path).select("ts", "day", "level", "src_ip", "score").collect())

    before = shown()
    days = sorted({r[1] for r in before})
    begun = tables.read_alert_store(spark, path)
    monkeypatch.setattr(tables, "move_into_place", lambda *a: False)
    assert len(before) == 600 and tables.compact_store(spark, path, days[1]) >= 4
    assert shown() == before and tables.replaced_files(spark, path).count() == 0
    monkeypatch.undo()
    n = tables.compact_store(spark, path, days[1])
    assert shown() == before and begun.count() == 600
    assert tables.replaced_files(spark, path).count() == n
    day = tables._store_files(spark, path).where(F.col("day") == F.lit(days[1]))
    assert day.select("_file").distinct().count() < n
    tables.store_alerts(base.where("score = 0"), path)
    assert len(shown()) == 601
    assert tables.compact_store(spark, path, days[1]) >= 0 and tables.compact_store(spark, path, days[0]) >= 2
    assert len(shown()) == 601 and sorted(set(shown())) == sorted(set(before))
