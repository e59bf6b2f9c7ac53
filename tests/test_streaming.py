import time
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowtide.operators.flows import flows, state_features
from flowtide.schemas import FLOW_EXTENDED
from flowtide.sources.packets import IngestListener, observe_ingest, parse_packets, read_packet_lines_stream, valid_packets
from flowtide.storage import fresh_dir, shared_root
from flowtide.streaming.flows import stored_base, stream_base, stream_flow_states, stream_flows, with_heartbeat
from flowtide.streaming.idle import FLOW_STATE, folded, joined, live_flows, packet_table, rocksdb_state, slice_state
from flowtide.streaming.ingest import (
    accepted_packets, corrected_states, corrections, ingest_metrics, late_packets, late_states, start_ingest,
)
from flowtide.streaming.replay import end_marker, replay

from .test_flows import F1, F3, GOLDEN, T0, packets_of, random_packets


def wait_for(done, seconds=20):
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.1)


def rounded(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("direction, window", [("uni", 30), ("bi", 5)])
def test_stream_equals_batch(spark, make_packets, direction, window):
    rows = random_packets(600, 0.5)
    table = make_packets(rows)
    steps = [table.where(F.col("ts_us") < T0 + 50_000_000), table.where(F.col("ts_us") >= T0 + 50_000_000), end_marker(table, 600)]
    base = min(r[0] for r in rows)
    out = replay(spark, steps, lambda p: stream_flows(p, window, "1 second", base, direction))
    assert rounded(out.drop("batch_id")) == rounded(flows(table, window, direction))


def test_late_packets_are_dropped(spark, make_packets):
    early = make_packets(packets_of(F1, [60, 60], [1.0]))
    later = make_packets(packets_of(F1, [70], [], start=T0 + 60_000_000))
    late = make_packets(packets_of(F1, [80], [], start=T0 + 2_000_000) + packets_of(F1, [90], [], start=T0 + 59_000_000))
    steps = [early, later, late, end_marker(later, 600)]
    listener = IngestListener()
    spark.streams.addListener(listener)
    try:
        out = replay(spark, steps, lambda p: stream_flows(p, 10, "5 seconds", T0)).orderBy("window").collect()
        wait_for(lambda: listener.late_rows > 0)
    finally:
        spark.streams.removeListener(listener)
    assert listener.late_rows == 1
    assert [(r.window, r.bidirectional_packets, r.bidirectional_bytes) for r in out] == [(0, 2, 120), (5, 1, 90), (6, 1, 70)]


def test_listener_counts_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1,1.1.1.1,2.2.2.2,1,2,,,60,1,0,0\nbad\ntshark: x\n")
    listener = IngestListener()
    spark.streams.addListener(listener)
    try:
        parsed = observe_ingest(parse_packets(read_packet_lines_stream(spark, str(tmp_path / "in"))))
        writer = valid_packets(parsed).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
        writer.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        wait_for(lambda: listener.totals["total_lines"] >= 2)
    finally:
        spark.streams.removeListener(listener)
    assert listener.totals == {"total_lines": 2, "parsed": 1, "skipped": 1}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


NAMES = ["ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "frame_len", "syn", "fin", "rst"]


@pytest.mark.parametrize("cuts", [[], [1], [4], [1, 2, 9], list(range(1, 10))])
@pytest.mark.parametrize("golden", GOLDEN)
def test_slices_and_triggers_add_up(spark, golden, cuts):
    """Packets of a flow in any order over triggers and slices give the flow's features."""
    key, sizes, gaps, flags, want = golden
    frame = pd.DataFrame(packets_of(key, sizes, gaps, *flags), columns=NAMES)
    mixed = frame.sample(frac=1, random_state=1)
    edges = [0, *[c for c in cuts if c < len(mixed)], len(mixed)]
    triggers = [mixed.iloc[a:b] for a, b in zip(edges, edges[1:])]
    slices = []
    for second in sorted(set(frame["ts_us"] // 1_000_000)):
        parts = [t[t["ts_us"] // 1_000_000 == second] for t in triggers]
        table = np.concatenate([packet_table(p, key[4] == "tcp") for p in parts if len(p)])
        slices.append(tuple(slice_state(folded(table[:, 0], table[:, 1:]))))
    state = joined(slices[::-1])
    row = spark.createDataFrame([(0, *key, *state)], FLOW_STATE)
    got = state_features(row).first()
    assert list(got)[6:] == pytest.approx(want, abs=1e-6)


def test_squares_of_gaps_stay_exact_in_long_slices():
    table = np.array([[0, 1, 1, 1, 0, 0, 0], [4_000_000_000, 1, 1, 1, 0, 0, 0]])
    assert slice_state(table)[8] == 4_000_000_000**2
    assert joined([tuple(slice_state(table)), tuple(slice_state(table + [[9_000_000_000, 0, 0, 0, 0, 0, 0]]))])[8] == (
        2 * 4_000_000_000**2 + 5_000_000_000**2)


def run_until(stream, checkpoint, done, seconds=120, trigger="500 milliseconds"):
    rows = []
    writer = stream.writeStream.foreachBatch(lambda df, _: rows.extend(df.collect()))
    query = writer.option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
    try:
        wait_for(lambda: done(rows) or query.exception(), seconds)
        assert query.exception() is None
        return rows, list(query.recentProgress)
    finally:
        query.stop()


def test_idle_flows_are_given_out(spark, make_packets):
    """A flow is given out when it has been idle; packets of the same window that come after make a second row."""
    source, checkpoint = fresh_dir(spark, "live"), fresh_dir(spark, "live-c")
    key, sizes, gaps, flags, want = GOLDEN[0]
    packets = make_packets(packets_of(key, sizes, gaps, *flags))
    packets.coalesce(1).write.parquet(source)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    later = packets_of(F3, [40], [], start=T0 + 1_000_000) + packets_of(key, [50], [], start=T0 + 2_000_000)

    def done(rows):
        if len(rows) == 1 and not sent:
            sent.append(make_packets(later).coalesce(1).write.mode("append").parquet(source))
        return len(rows) >= 3

    sent = []
    try:
        with rocksdb_state(spark):
            out = live_flows(spark.readStream.schema(packets.schema).parquet(source), 5, T0, idle_seconds=2, join_seconds=1)
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in FLOW_EXTENDED]
            rows, _ = run_until(out, checkpoint, done)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [rows[0][c] for c in FLOW_EXTENDED.names[6:]] == pytest.approx(want, abs=1e-5)
    assert sorted((r.src_ip, r.bidirectional_packets, r.packets_per_second) for r in rows[1:]) == [
        ("192.168.1.1", 1, 1e6),
        ("192.168.1.3", 1, 1e6),
    ]


def test_a_hot_flow_spreads_over_its_slices(spark):
    """One flow of 120,000 packets, out of order over three triggers: the batch answer, and no task with most of it."""
    n = spark.range(120_000)
    ts = F.lit(T0) + F.col("id") * 3000 + F.pmod(F.xxhash64("id"), F.lit(2999))
    rows = n.select(
        ts.alias("ts_us"), F.lit("1.1.1.1").alias("src_ip"), F.lit("2.2.2.2").alias("dst_ip"), F.lit(1).alias("src_port"),
        F.lit(2).alias("dst_port"), F.lit("tcp").alias("protocol"), (F.col("id") % 1400 + 40).cast("int").alias("frame_len"),
        (F.col("id") % 7 == 0).cast("int").alias("syn"), F.lit(0).alias("fin"), F.lit(0).alias("rst"))
    source, checkpoint = fresh_dir(spark, "hot"), fresh_dir(spark, "hot-c")
    rows.repartition(6).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    with rocksdb_state(spark):
        flows_out = live_flows(stream, 600, T0, idle_seconds=20, slice_seconds=1, join_seconds=2)
        got, progress = run_until(flows_out, checkpoint, lambda rows: len(rows) > 0, 200)
    assert rounded_rows(got) == rounded(flows(rows, 600, base_us=T0))
    assert sum(p["numInputRows"] > 0 for p in progress) == 3
    # Rows per task of the operator that holds slices: dealt by flow and slice, as here.
    cut = rows.withColumn("slice", F.expr("ts_us div 1000000"))
    dealt = cut.repartition(8, F.lit(0), "src_ip", "slice").groupBy(F.spark_partition_id()).count().collect()
    sizes = sorted(r["count"] for r in dealt)
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_idle_flows_cost_by_rows_not_by_keys(spark):
    """60,000 flows of two or three slices each, with packets of one time stamp: the batch answer within 90 seconds."""
    n = spark.range(240_000)
    flow, at = F.expr("id div 4"), F.expr("id % 4")
    rows = n.select(
        (F.lit(T0) + F.when(at == 3, 2).otherwise(at) * 1_500_000).alias("ts_us"), F.concat(F.lit("10.0.0."), flow % 200).alias("src_ip"),
        F.lit("2.2.2.2").alias("dst_ip"), flow.cast("int").alias("src_port"), F.lit(2).alias("dst_port"),
        F.when(flow % 2 == 0, "tcp").otherwise("udp").alias("protocol"), (F.col("id") % 1400 + 40).cast("int").alias("frame_len"),
        (at == 1).cast("int").alias("syn"), F.lit(None).cast("int").alias("fin"), F.lit(0).alias("rst"))
    source, checkpoint = fresh_dir(spark, "many"), fresh_dir(spark, "many-c")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    with rocksdb_state(spark):
        flows_out = live_flows(stream, 600, T0, idle_seconds=3, slice_seconds=2, join_seconds=2)
        got, _ = run_until(flows_out, checkpoint, lambda rows: len(rows) >= 60_000, 90)
    assert rounded_rows(got) == rounded(flows(rows.fillna(0, ["fin"]), 600, base_us=T0))


def rounded_rows(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


def test_the_first_batch_sets_the_base_and_a_restart_keeps_it(spark, make_packets):
    rows = random_packets(300, 0.5)
    table = make_packets(rows)
    base = min(r[0] for r in rows)
    kept = fresh_dir(spark, "base")
    steps = [table.where(F.col("ts_us") >= T0 + 40_000_000), table.where(F.col("ts_us") < T0 + 40_000_000), end_marker(table, 9000)]
    first = steps[0].agg(F.min("ts_us")).first()[0]
    assert stored_base(spark, kept) is None and first != base
    out = replay(spark, steps, lambda p: stream_flows(p, 30, "1 hour", None, checkpoint=kept))
    assert stored_base(spark, kept) == first
    assert rounded(out.drop("batch_id")) == rounded(flows(table, 30, base_us=first))
    with pytest.raises(ValueError, match="checkpoint"):
        stream_flows(table, 30, base_us=None)


def test_a_stream_without_packets_has_no_base(spark, make_packets):
    source = fresh_dir(spark, "none")
    table = make_packets([])
    table.write.parquet(source)
    with pytest.raises(TimeoutError):
        stream_base(spark.readStream.schema(table.schema).parquet(source), fresh_dir(spark, "none-c"), wait_seconds=1)


def line(ts, size=60, src="1.1.1.1"):
    return f"{ts / 1e6:.6f},{src},2.2.2.2,1,2,,,{size},1,0,0"


def test_intake_counts_every_packet_once(spark):
    """Late packets go aside, a batch that is run again changes nothing, and corrections replace what was given out."""
    source, out, checkpoint = (fresh_dir(spark, f"intake-{n}") for n in ("in", "out", "c"))
    steps = [
        ["bad", "tshark: x", line(T0), line(T0 + 1_000_000), line(T0 + 30_000_000)],
        [line(T0 + 2_000_000, 99), line(T0 + 31_000_000), "1,2"],
        ["tshark: nothing"],
    ]
    for step in steps:
        spark.createDataFrame([(v,) for v in step], "value string").coalesce(1).write.mode("append").text(source)
        start_ingest(read_packet_lines_stream(spark, source), out, checkpoint, 10, 5, {"availableNow": True}).awaitTermination()
    rows = {r.batch_id: r for r in ingest_metrics(spark, out).collect()}
    assert {k: (r.total_lines, r.parsed, r.skipped, r.late) for k, r in rows.items()} == {0: (4, 3, 1, 0), 1: (3, 2, 1, 1)}
    assert {r.base_us for r in rows.values()} == {T0} and rows[1].watermark_us == T0 + 25_000_000
    assert [(r.ts_us, r.frame_len) for r in late_packets(spark, out).collect()] == [(T0 + 2_000_000, 99)]
    accepted = spark.read.schema(accepted_packets(spark, out).schema).parquet(f"{out}/accepted/*")
    assert sorted(r.ts_us - T0 for r in accepted.collect()) == [0, 1_000_000, 30_000_000, 31_000_000]
    given = replay(spark, [accepted, end_marker(accepted, 99)], lambda p: stream_flow_states(p, 10, "5 seconds", T0)).drop("batch_id")
    whole = corrected_states(given, late_states(spark, out, 10, T0)).orderBy("window").collect()
    assert [(r.window, r.packets, r.bytes, r.gaps, r.revised) for r in whole] == [(0, 3, 219, 1, True), (3, 2, 120, 1, False)]
    fixed = corrections(given, late_states(spark, out, 10, T0)).collect()
    assert [(r.window, r.bidirectional_packets, r.flow_duration) for r in fixed] == [(0, 3, 2.0)]


def test_empty_intake_tables(spark):
    out = fresh_dir(spark, "intake-none")
    assert ingest_metrics(spark, out).count() == 0 and late_packets(spark, out).count() == 0


def test_heartbeat_closes_windows_without_packets(spark, make_packets):
    source, checkpoint, rows = fresh_dir(spark, "beat"), fresh_dir(spark, "beat-c"), []
    start = int(time.time()) // 4 * 4 * 1_000_000
    packets = make_packets(packets_of(F1, [60, 70, 80], [0.5, 0.5], start=start))
    packets.coalesce(1).write.parquet(source)
    stream = with_heartbeat(spark.readStream.schema(packets.schema).parquet(source))
    writer = stream_flows(stream, 4, "1 second").writeStream.foreachBatch(lambda df, _: rows.extend(df.collect()))
    query = writer.option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
    try:
        wait_for(lambda: rows or query.exception(), 90)
    finally:
        query.stop()
    assert [(r.src_ip, r.bidirectional_packets, r.iat_mean, r.window) for r in rows] == [(F1[0], 3, 0.5, start // 4_000_000)]


def test_scratch_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_root(spark) == (named.rstrip("/") if named else shared_root(spark))
    assert fresh_dir(spark, "x") != fresh_dir(spark, "x")


def test_scratch_is_removed_at_the_end_of_a_job(spark, monkeypatch):
    from flowtide import storage

    monkeypatch.setattr(storage, "_MADE", {})
    table = storage.materialise(spark.range(5), "gone")
    unused = fresh_dir(spark, "never-written")
    assert table.count() == 5 and unused
    path = storage._MADE[spark.sparkContext.applicationId][0]
    assert storage.remove_scratch(spark) == 1 and storage.remove_scratch(spark) == 0
    assert not Path(path.removeprefix("file:").replace("//", "/")).exists()
