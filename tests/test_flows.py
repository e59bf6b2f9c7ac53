import ipaddress
import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from flowtide.operators.flows import (
    bounded,
    canonicalise,
    flow_states,
    flows,
    join_slices,
    merge_flow_states,
    packet_gaps,
    state_features,
    with_window,
)
from flowtide.schemas import FEATURES_EXTENDED, FEATURES_MINIMAL, FLOW_EXTENDED, FLOW_KEY, FLOW_MINIMAL

T0 = 1_700_000_000_000_000


def packets_of(key, sizes, gaps, syn=0, fin=0, rst=0, start=T0):
    """Packets of one flow; the first ``syn`` of them carry a syn flag, and so on."""
    times = [start, *(start + round(s * 1e6) for s in itertools.accumulate(gaps))]
    flags = [[int(i < n) for n in (syn, fin, rst)] for i in range(len(sizes))]
    return [(t, key[0], key[1], key[2], key[3], key[4], s, *f) for t, s, f in zip(times, sizes, flags)]


F1 = ("192.168.1.1", "10.3.0.7", 40001, 8443, "tcp")
F2 = ("10.3.0.9", "192.168.1.2", 40002, 22, "tcp")
F3 = ("192.168.1.3", "10.3.0.8", 40003, 123, "udp")
GOLDEN = [
    (F1, [64, 1500, 52, 720, 333, 52, 98], [0.02, 0.4, 0.07, 0.31, 0.5, 0.08], (2, 1, 0),
     (7, 2819, 402.714286, 501.874405, 1.38, 2, 1, 0, 0.23, 0.182757, 402.714286, 5.072464)),
    (F2, [1460, 1460, 40, 1460], [0.25, 1.25, 0.5], (1, 0, 1),
     (4, 4420, 1105.0, 614.878037, 2.0, 1, 0, 1, 0.666667, 0.424918, 1105.0, 2.0)),
    (F3, [70, 310, 70], [0.2, 0.6], (0, 0, 0),
     (3, 450, 150.0, 113.137085, 0.8, 0, 0, 0, 0.4, 0.2, 150.0, 3.75)),
    (F1, [90, 100, 110] + [100] * 7, [0.1, 0.2] + [0.1] * 7, (1, 1, 0), (10, 1000, 100, 4.472136, 1.0, 1, 1, 0, 0.111111, 0.031427, 100, 10)),
    (F1, [77], [], (1, 0, 1), (1, 77, 77, 0, 1e-6, 1, 0, 1, 0, 0, 77, 1e6)),
    (F3, [40, 60], [0.0], (2, 2, 2), (2, 100, 50, 10, 1e-6, 0, 0, 0, 0, 0, 50, 2e6)),
]


@pytest.mark.parametrize("window", [5, 86_400])
@pytest.mark.parametrize("key, sizes, gaps, flags, want", GOLDEN)
def test_golden(make_packets, key, sizes, gaps, flags, want, window):
    table = flows(make_packets(packets_of(key, sizes, gaps, *flags)), window)
    rows = table.collect()
    assert table.schema.names == FLOW_EXTENDED.names and len(rows) == 1
    assert [rows[0][c] for c in FLOW_KEY] == list(key)
    assert [rows[0][c] for c in FEATURES_EXTENDED] == pytest.approx(want, abs=1e-6)


def test_minimal_features(make_packets):
    key, sizes, gaps, flags, want = GOLDEN[0]
    table = flows(make_packets(packets_of(key, sizes, gaps, *flags)), feature_set="minimal")
    assert table.schema.names == FLOW_MINIMAL.names
    assert [table.first()[c] for c in FEATURES_MINIMAL] == pytest.approx(want[:5], abs=1e-6)


def test_empty(make_packets):
    for kind in ("minimal", "extended"):
        assert flows(make_packets([]), feature_set=kind).count() == 0


def test_window_edge_restarts_gaps(make_packets):
    rows = flows(make_packets(packets_of(F1, [60, 60, 60], [4.0, 1.0])), 5).orderBy("window").collect()
    assert [(r.window, r.bidirectional_packets, r.iat_mean) for r in rows] == [(0, 2, 4.0), (1, 1, 0.0)]


def test_base_time_and_windows_before_it(make_packets):
    rows = flows(make_packets(packets_of(F1, [60, 60], [6.0])), 5, base_us=T0 + 1_000_000).orderBy("window").collect()
    assert [r.window for r in rows] == [-1, 1]


def random_packets(n, hot, seed=3):
    """Packets of a few flows; one flow has ``hot`` of all, some packets are exact copies."""
    rnd = random.Random(seed)
    keys = [("10.0.0.%d" % i, "10.0.1.%d" % (i % 3), 1000 + i, 80, "tcp" if i % 2 else "udp") for i in range(7)]
    rows = []
    for _ in range(n):
        key = keys[0] if rnd.random() < hot else rnd.choice(keys)
        rows.append((T0 + rnd.randrange(100_000_000), *key, rnd.randrange(40, 1500), *[rnd.randrange(2) for _ in range(3)]))
    return rows + rows[: n // 3]


def brute(rows, window):
    base = min(r[0] for r in rows)
    groups = {}
    for r in sorted(rows):
        groups.setdefault(((r[0] - base) // (window * 1_000_000), *r[1:6]), []).append(r)
    out = {}
    for key, part in groups.items():
        sizes = [r[6] for r in part]
        gaps = [(b[0] - a[0]) / 1e6 for a, b in zip(part, part[1:])]
        flags = [sum(r[i] for r in part) if key[5] == "tcp" else 0 for i in (7, 8, 9)]
        dur = max(1e-6, (part[-1][0] - part[0][0]) / 1e6)
        stats = [statistics.mean(gaps), statistics.pstdev(gaps)] if gaps else [0, 0]
        n, size = len(part), sum(sizes)
        out[key] = [n, size, size / n, statistics.pstdev(sizes), dur, *flags, *stats, size / n, n / dur]
    return out


@pytest.mark.parametrize("window", [5, 10, 30, 1000])
def test_equals_brute_force(make_packets, window):
    rows = random_packets(1500, 0.4)
    got = {(r.window, *[r[c] for c in FLOW_KEY]): [r[c] for c in FEATURES_EXTENDED] for r in flows(make_packets(rows), window).collect()}
    want = brute(rows, window)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], rel=1e-6, abs=1e-6)


def test_result_does_not_depend_on_partitions(spark, make_packets):
    rows = random_packets(800, 0.5)
    seen = []
    for partitions, order in [("1", rows), ("7", rows[::-1])]:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        table = flows(make_packets(order).repartition(5), 30, "bi")
        seen.append(sorted(map(tuple, table.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1]


def test_hot_flow_is_split(spark, make_packets):
    """Nine tenths of the packets belong to one flow; no task of the gap stage gets them all."""
    rows = random_packets(3000, 0.9)
    keyed = with_window(make_packets(rows), 1000)
    stamps = keyed.groupBy("window", *FLOW_KEY, F.expr("ts_us div 10000000").alias("slice")).count()
    assert stamps.agg(F.max("count")).first()[0] < len(rows) / 4
    plan = flows(make_packets(rows), 1000)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_bidirectional_merges_both_ways(make_packets):
    there = packets_of(F1, [60, 70], [1.0], syn=1)
    back = packets_of((F1[1], F1[0], F1[3], F1[2], "TCP"), [90], [], fin=1, start=T0 + 500_000)
    row = flows(make_packets(there + back), 5, "bi").collect()
    assert len(row) == 1
    r = row[0]
    assert (r.src_ip, r.src_port, r.dst_ip, r.protocol) == (F1[1], F1[3], F1[0], "tcp")
    assert (r.bidirectional_packets, r.bidirectional_bytes, r.tcp_syn_count, r.tcp_fin_count) == (3, 220, 1, 1)
    assert (r.iat_mean, r.iat_std) == (0.5, 0.0)


def test_unknown_direction(make_packets):
    with pytest.raises(ValueError):
        flows(make_packets([]), direction="both")


ADDRESSES = [
    "10.0.0.1", "9.255.0.1", "192.168.1.10", "192.168.1.9", "0.0.0.0", "255.255.255.255", "::", "::1", "fe80::1", "2001:db8::",
    "2001:db8::1", "2001:DB8:0:0:0:0:0:2", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "::ffff:102:305", "1::8", "2001:db8:0:1::",
]


def test_canonical_order_equals_the_address_library(spark):
    pairs = [(a, i, b, j, "TCP") for (i, a), (j, b) in itertools.product(enumerate(ADDRESSES), repeat=2)]
    pairs += [(a, 9, a, 5, "udp") for a in ADDRESSES]
    table = spark.createDataFrame(pairs, "src_ip string, src_port int, dst_ip string, dst_port int, protocol string")

    def order(ip, port):
        address = ipaddress.ip_address(ip)
        return address.version, address.packed, port

    for r in canonicalise(table).collect():
        ends = sorted([(r.src_ip, r.src_port), (r.dst_ip, r.dst_port)], key=lambda e: order(*e))
        assert [order(r.a_ip, r.a_port), order(r.b_ip, r.b_port)] == [order(*e) for e in ends]
        assert r.protocol == r.protocol.lower()


def test_uni_and_bi_agree_on_sums(make_packets):
    table = make_packets(random_packets(600, 0.3))
    sums = [
        flows(table, 20, d).agg(*[F.sum(c) for c in ("bidirectional_packets", "bidirectional_bytes", "tcp_syn_count")]).first()
        for d in ("uni", "bi")
    ]
    assert sums[0] == sums[1]


def test_merge_adds_gap_lists(make_packets):
    """Partial states merge like lists of sizes and gaps: no gap is added between them."""
    table = make_packets(packets_of(F1, [60, 70, 80, 90], [1.0, 3.0, 1.0]))
    halves = flow_states(with_window(table, 4), 4).drop("window")
    merged = merge_flow_states(halves, FLOW_KEY)
    r = merged.first()
    assert (r.packets, r.bytes, r.gaps, r.gap_sum) == (4, 300, 2, 2_000_000)
    assert (r.first_us, r.last_us) == (T0, T0 + 5_000_000)
    f = state_features(merged, keys=FLOW_KEY).first()
    assert (f.iat_mean, f.iat_std, f.flow_duration) == (1.0, 0.0, 5.0)


def test_join_slices_adds_the_edges(make_packets):
    table = make_packets(packets_of(F1, [60, 70, 80, 90], [1.0, 3.0, 1.0]))
    joined = join_slices(flow_states(with_window(table, 4), 4).drop("window"), FLOW_KEY).first()
    assert (joined.gaps, joined.gap_sum, int(joined.gap_sq)) == (3, 5_000_000, 11 * 10**12)


def test_packet_gaps_equal_brute_force(spark):
    """A third of all packets are copies of one time stamp."""
    rnd = random.Random(8)
    rows = [(T0 + rnd.randrange(60_000_000), i, rnd.choice("ab")) for i in range(400)] + [(T0 + 7, 1000 + i, "a") for i in range(200)]
    table = spark.createDataFrame(rows, "ts_us bigint, seq bigint, k string")
    got = {r.seq: r.iat_us for r in packet_gaps(table, ["k"], "seq").collect()}
    want = {}
    for k in "ab":
        part = sorted(r for r in rows if r[2] == k)
        want |= {part[0][1]: None} | {b[1]: b[0] - a[0] for a, b in zip(part, part[1:])}
    assert got == want


def test_bounded(make_packets):
    table = make_packets(packets_of(F1, [60] * 4, [30.0, 29.999999, 0.000001]))
    assert bounded(table, 1).count() == 3
    assert bounded(table, 0.5).count() == 1
