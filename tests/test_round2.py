"""Inputs that used to lose rows, to stop a job or to change its result."""

import gzip
import math

import pytest
from pyspark.sql import functions as F

from flowtide.operators.alerts import threshold_columns
from flowtide.operators.flows import flows
from flowtide.operators.quantiles import exact_quantiles
from flowtide.operators.sampling import number_rows
from flowtide.plans.train import TrainParams, train
from flowtide.schemas import FEATURES_MINIMAL, FLOW_LABELLED
from flowtide.sources.labelled import quota_sample, read_labelled, skipped_files
from flowtide.sources.packets import ingest_stats, parse_packets, read_packets
from flowtide.sources.registry import load_model
from flowtide.sources.tables import read_alerts, read_flows, write_alerts, write_flows
from flowtide.streaming.detect import run_name, start_detection

HEADER = "Protocol,Flow Duration,Tot Fwd Pkts,Tot Bwd Pkts,TotLen Fwd Pkts,TotLen Bwd Pkts,Label\n"


def write_csv(path, rows, header=HEADER):
    path.parent.mkdir(parents=True, exist_ok=True)
    text = header + "".join(f"6,{1000 + i},1,2,{i},40,Benign\n" for i in range(rows))
    path.write_bytes(gzip.compress(text.encode()) if path.suffix == ".gz" else text.encode())


def test_files_with_odd_paths_and_codecs(spark, tmp_path):
    write_csv(tmp_path / "a b" / "f 1.csv", 50)
    write_csv(tmp_path / "a b" / "g[x].csv.gz", 50)
    write_csv(tmp_path / "a b" / "h.csv", 50, HEADER.replace(",Label", ",Other"))
    write_csv(tmp_path / "a b" / "notes.csv", 0, "nothing here\n")
    pattern = str(tmp_path / "a b" / "*.csv*")
    assert read_labelled(spark, pattern).count() == 100
    assert read_labelled(spark, pattern, limit=21).count() == 21
    reasons = {r.path.rsplit("/", 1)[1]: r.reason for r in skipped_files(spark, pattern).collect()}
    assert set(reasons) == {"h.csv", "notes.csv"} and "label_raw" in reasons["h.csv"]


def test_a_source_without_a_quota_is_an_error(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "source string, v int")
    with pytest.raises(ValueError, match="'b'"):
        quota_sample(table, {"a": 1}, "source")


@pytest.mark.parametrize(
    "epoch", ["99999999999999.0", "9" * 14, "9" * 20, "9" * 30, "1e400", "-", "nan", "inf", "-1e30", "253402300800"])
def test_odd_epochs_are_skipped(spark, epoch):
    line = ",10.0.0.1,10.0.0.2,1,2,,,60,0,0,0"
    parsed = parse_packets(spark.createDataFrame([(epoch + line,), ("1.5" + line,)], "value string"))
    assert tuple(ingest_stats(parsed).first()) == (2, 1, 1)


def test_odd_lengths_are_skipped(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1.0,a,b,1,2,,,99999999999,0,0,0\n1.0,a,b,99999999999,2,,,60,0,0,0\n")
    assert read_packets(spark, str(tmp_path / "p.txt")).count() == 0


def test_windows_of_years_with_long_gaps(make_packets):
    day = 86_400_000_000
    times = [0, 1000 * day, 150_000 * day, 2_900_000 * day]
    rows = [(t, "a", "b", 1, 2, "tcp", 100, 0, 0, 0) for t in times]
    row = flows(make_packets(rows), 3_000_000 * 86_400).first()
    gaps = [(b - a) / 1e6 for a, b in zip(times, times[1:])]
    mean = sum(gaps) / 3
    assert row.iat_mean == pytest.approx(mean)
    assert row.iat_std == pytest.approx(math.sqrt(sum((g - mean) ** 2 for g in gaps) / 3))


@pytest.mark.parametrize("direct", [10, 10**9])
def test_quantiles_ignore_nan_in_both_forms(spark, direct):
    rows = [(float(i) if i % 10 else math.nan,) for i in range(1000)] + [(None,)]
    table = spark.createDataFrame(rows, "v double")
    got = exact_quantiles(table, {"v": [0.0, 0.5, 1.0]}, direct_rows=direct, bracket_rows=20)["v"]
    kept = sorted(v for (v,) in rows if v is not None and not math.isnan(v))
    assert got == [kept[0], (kept[449] + kept[450]) / 2, kept[-1]]


def test_one_packet_shuffle(make_packets):
    rows = [(t * 1000, "a", "b", 1, 2, "tcp", 100, 0, 0, 0) for t in range(50)]
    plan = flows(make_packets(rows), 5, base_us=0)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    carrying = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "slice" in x]
    assert len(carrying) == 1


def test_csv_flows_in_any_order_and_without_label(spark, tmp_path, make_packets):
    rows = [(t * 1000, "a", "b", 1, 2, "tcp", 100, 0, 0, 0) for t in range(5)]
    table = flows(make_packets(rows), 5)
    write_flows(table, str(tmp_path / "plain"), fmt="csv")
    assert [tuple(r) for r in read_flows(spark, str(tmp_path / "plain"), "csv").collect()] == [
        tuple(r) for r in table.select(*[c for c in FLOW_LABELLED.names if c in table.columns]).collect()]
    write_flows(table.select(F.lit(1).alias("label"), *reversed(table.columns)), str(tmp_path / "back"), fmt="csv")
    back = read_flows(spark, str(tmp_path / "back"), "csv")
    assert back.columns == FLOW_LABELLED.names and back.first().label == 1


def test_null_thresholds_void_the_document(spark):
    docs = [('{"red_threshold": null, "yellow_threshold": 0.5}',), ('{"yellow_threshold": 0.5}',)]
    got = spark.createDataFrame(docs, "d string").select(*threshold_columns(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(-0.25, 0.0), (-0.25, 0.5)]


def test_a_broken_registry_is_not_an_empty_one(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_model(spark, str(tmp_path / "none"))
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception) as error:
        load_model(spark, str(tmp_path))
    assert not isinstance(error.value, FileNotFoundError)


def test_runs_with_other_checkpoints_keep_earlier_alerts(spark, tmp_path):
    first, again, other = (run_name(spark, str(tmp_path / c)) for c in ("one", "one", "two"))
    assert first == again != other
    alert = [("2024-01-01T00:00:00+00:00", "a", "b", 1, 2, "tcp", -0.3, "RED")]
    rows = spark.createDataFrame(alert, "timestamp string, src_ip string, dst_ip string, src_port int, dst_port int, "
                                 "protocol string, score double, level string")
    for run in (first, first, other):
        write_alerts(rows, str(tmp_path / "out"), "json", 0, run)
    assert read_alerts(spark, str(tmp_path / "out")).count() == 2


def test_a_question_of_minutes_opens_one_day(spark, tmp_path):
    from flowtide.operators.dashboards import alert_rate, newest
    from flowtide.sources.tables import read_alert_store, store_alerts

    rows = [(f"2024-01-{d:02d}T12:{m:02d}:00+00:00", "a", "b", 1, 2, "tcp", -0.3, "RED") for d in (1, 9, 20) for m in (1, 2)]
    ddl = "timestamp string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, score double, level string"
    store_alerts(spark.createDataFrame(rows, ddl), str(tmp_path / "log"))
    log = read_alert_store(spark, str(tmp_path / "log"))
    now = newest(log)
    rate = alert_rate(log, 120, "RED", as_of=now)
    assert rate.first().rate == pytest.approx(2 / 120)
    scan = rate._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in scan
    days = [f for f in rate.inputFiles() if "day=" in f]
    assert days and newest(log.limit(0)) is None


def labelled_flows(spark, n=1500):
    cols = [F.lit(0).cast("bigint").alias("window"), F.lit("a").alias("src_ip"), F.lit("b").alias("dst_ip"),
            (F.col("id") % 7).cast("int").alias("src_port"), F.lit(2).alias("dst_port"), F.lit("tcp").alias("protocol")]
    odd = F.col("id") % 50 == 0
    features = [F.when(odd, F.col("id") * 3 + k).otherwise((F.col("id") * (k + 3)) % 23).cast("double").alias(c)
                for k, c in enumerate(FEATURES_MINIMAL)]
    return spark.range(n).select(*cols, *features, odd.cast("int").alias("label"))


def test_training_does_not_depend_on_the_partitioning(spark):
    table = labelled_flows(spark)
    params = TrainParams(feature_set="adaptive", trees=15)
    models = [train(table.repartition(n, "src_port"), params) for n in (2, 7)]
    assert models[0].offset == pytest.approx(models[1].offset, abs=1e-9)
    assert models[0].red == pytest.approx(models[1].red, abs=1e-9)
    assert models[0].card == models[1].card and models[0].card["columns_numeric"] == FEATURES_MINIMAL


def test_row_numbers_follow_from_content(spark):
    table = spark.createDataFrame([(1, None), (1, None), (2, 0.5)], "a int, b double")
    got = [sorted(map(tuple, number_rows(table.repartition(n), "k").collect()), key=str) for n in (1, 5)]
    assert got[0] == got[1] and len({r[2] for r in got[0]}) == 3


def test_detection_stream_writes_alerts_logs_and_statistics(spark, tmp_path):
    table = labelled_flows(spark, 600)
    model = train(table, TrainParams(feature_set="adaptive", trees=10))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(checkpoint):
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(source)
        start_detection(stream, model, out, str(tmp_path / checkpoint), trigger={"availableNow": True}).awaitTermination()

    for n in range(3):
        table.where(F.col("src_port") % 3 == n).coalesce(1).write.mode("append").parquet(source)
    run("c1")
    once = read_alerts(spark, f"{out}/alerts_json").count()
    table.limit(0).coalesce(1).write.mode("append").parquet(source)
    run("c1")
    assert once and read_alerts(spark, f"{out}/alerts_json").count() == once
    assert read_alerts(spark, f"{out}/alerts_csv", "csv").count() == once == spark.read.text(f"{out}/log").count()
    stats = spark.read.json(f"{out}/score_stats")
    assert stats.count() == 3 and stats.agg(F.sum("n")).first()[0] == 600
    run("c2")
    assert read_alerts(spark, f"{out}/alerts_json").count() == 2 * once
