import pytest
from pyspark.sql import functions as F

from flowtide.functions.addresses import parse_flow_id
from flowtide.schemas import FLOW_NORMALISED, LABELLED_COLUMNS
from flowtide.sources.labelled import (
    _open_header, file_quotas, find_layouts, header_lines, list_files, normalise_labelled, normalise_name, quotas, read_labelled, resolve_header,
)
from flowtide.sources.synthetic import synthetic_flows

SHORT = (
    "Dst Port,Protocol,Flow Duration,Tot Fwd Pkts,Tot Bwd Pkts,TotLen Fwd Pkts,TotLen Bwd Pkts,Flow IAT Mean,Flow IAT Std,"
    "SYN Flag Cnt,FIN Flag Cnt,RST Flag Cnt,Pkt Len Std,Label"
)
LONG = (
    "Flow ID, Source IP, Source Port, Destination IP, Destination Port, Protocol, Flow Duration, Total Fwd Packets,"
    " Total Backward Packets,Total Length of Fwd Packets, Total Length of Bwd Packets, Label"
)


def test_names():
    assert normalise_name("  Pkt  Len/Std ") == "pkt len std"


def test_header_resolution():
    assert resolve_header(SHORT.split(","))["pkt_len_std"] == 12
    long = resolve_header(LONG.split(","))
    assert (long["src_ip"], long["bwd_bytes"], long["label_raw"]) == (1, 10, 11)
    assert "syn" not in long
    with pytest.raises(KeyError, match="label_raw"):
        resolve_header(SHORT.split(",")[:-1])


def test_repeated_headers():
    """Names that differ in case or blanks: the last counts. Exact repeats: the first."""
    core = SHORT.split(",")
    assert resolve_header([*core, " label "])["label_raw"] == len(core)
    assert resolve_header([*core, "Label"])["label_raw"] == len(core) - 1


def write(folder, name, header, *rows):
    (folder / name).write_text("\n".join([header, *rows]) + "\n")


@pytest.fixture
def files(tmp_path):
    write(
        tmp_path, "a.csv", SHORT,
        "80,6,1500000,3,2,100,400,250000,1000,1,0,2,12.5,Benign",
        SHORT,  # a header line inside the data
        "443,17,-5,0,0,-10,5,,x,0.9,y,,NaN,DDoS",
        "22,1,7,1,1,1,1,1,1,1,1,1,1,Benign",
        "53,udp,Infinity,Infinity,7,NaN,12,1,1,1,1,1,1,",
    )
    write(tmp_path, "b.csv", LONG, "x,1.1.1.1,5,2.2.2.2,6, TCP ,1000000,1,1,10,20,benign ", "x,3.3.3.3,p,4.4.4.4,,tcp,1,2,2,2,2,Bot")
    reordered = "Label,TotLen Bwd Pkts,TotLen Fwd Pkts,Tot Bwd Pkts,Tot Fwd Pkts,Flow Duration,Protocol,Flow ID"
    write(tmp_path, "c.csv", reordered, "BENIGN,4,3,2,1,1000000,6,1.2.3.4:10-5.6.7.8:20-6", "Bot,4,3,2,1,9,6,1.2.3.4-5.6.7.8-10-20-6", "Bot,4,3,2,1,9,6,?")
    write(tmp_path, "d.csv", "Protocol,Flow Duration", "6,1")
    write(tmp_path, "e.csv", "")
    return str(tmp_path)


def test_mixed_headers(spark, files):
    assert list_files(spark, f"{files}/*.csv").count() == 5
    found = find_layouts(spark, f"{files}/*.csv")
    assert sorted(r.layout for r in found.files.where("layout IS NOT NULL").collect()) == [0, 1, 2]
    assert sorted(r.reason[:25] for r in found.files.where("layout IS NULL").collect()) == ["missing required columns:"] * 2
    table = read_labelled(spark, f"{files}/*.csv")
    assert table.schema.names == LABELLED_COLUMNS
    assert [f.dataType for f in table.schema] == [f.dataType for f in FLOW_NORMALISED]
    rows = {(r.src_ip, r.src_port, r.dst_ip, r.dst_port): r for r in table.collect()}
    assert len(rows) == 7 and table.count() == 8

    web = rows["0.0.0.0", 0, "0.0.0.0", 80]
    assert (web.protocol, web.flow_duration, web.bidirectional_packets, web.bidirectional_bytes) == ("tcp", 1.5, 5, 500)
    assert (web.mean_packet_size, web.std_packet_size, web.iat_mean, web.iat_std) == (100, 12.5, 0.25, 0.001)
    assert (web.tcp_syn_count, web.tcp_rst_count, web.label, web.packets_per_second) == (1, 2, 0, 5 / 1.5)

    bad = rows["0.0.0.0", 0, "0.0.0.0", 443]
    assert (bad.protocol, bad.flow_duration, bad.bidirectional_packets, bad.bidirectional_bytes) == ("udp", 1e-6, 1, 0)
    assert (bad.tcp_syn_count, bad.tcp_fin_count, bad.iat_mean, bad.iat_std, bad.std_packet_size, bad.label) == (0, 0, 0, 0, 0, 1)

    infinite = rows["0.0.0.0", 0, "0.0.0.0", 53]
    assert (infinite.bidirectional_packets, infinite.bidirectional_bytes, infinite.label) == (1, 12, 1)

    assert rows["1.1.1.1", 5, "2.2.2.2", 6].label == 0
    assert rows["3.3.3.3", 0, "4.4.4.4", 0].label == 1
    flow_ids = table.where("src_ip = '1.2.3.4'").collect()
    assert [(r.dst_ip, r.src_port, r.dst_port) for r in flow_ids] == [("5.6.7.8", 10, 20)] * 2
    assert sorted(r.label for r in flow_ids) == [0, 1]


def test_tasks_open_the_files(spark, files, monkeypatch):
    """No file is opened from the driver, and a text scan finds the same first lines as the tasks do."""
    from flowtide.sources import labelled

    want = sorted(map(tuple, header_lines(spark, f"{files}/*.csv").collect()))
    assert len(want) == 5 and all(w[2] is not None for w in want)
    seen = []
    monkeypatch.setattr(labelled, "_open_header", lambda name, path: seen.append(path) or (None, "closed"))
    scanned = sorted(map(tuple, header_lines(spark, f"{files}/*.csv").collect()))
    assert seen == []
    assert [(n, p, line or "") for n, p, line in scanned] == want


def test_first_lines_through_codecs(tmp_path):
    import bz2
    import gzip

    text = "a,b\r\n1,2\n" + "x" * 200_000
    (tmp_path / "p.csv").write_text(text)
    (tmp_path / "g.csv.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "b.csv.bz2").write_bytes(bz2.compress(text.encode()))
    (tmp_path / "broken.csv.gz").write_bytes(b"no archive")
    for name in ("p.csv", "g.csv.gz", "b.csv.bz2"):
        assert _open_header(f"file:{tmp_path}/{name}", f"file:{tmp_path}/{name}") == ("a,b", "read")
    assert _open_header("", f"file:{tmp_path}/broken.csv.gz") == (None, "unreadable")
    assert _open_header("", f"file:{tmp_path}/gone.csv") == (None, "closed")
    assert _open_header("viewfs://x/y.csv", "viewfs://x/y.csv") == (None, "closed")
    assert _open_header("", f"file:{tmp_path}/p.csv.lz4") == (None, "closed")


def test_quotas_of_files_without_the_driver(spark):
    names = [f"f{i:03}" for i in range(37)]
    table = spark.createDataFrame([(n,) for n in names], "source_file string").repartition(5)
    for limit in (0, 5, 37, 100):
        got = {r.source_file: r.quota for r in file_quotas(table, limit).collect()}
        assert got == quotas(limit, names)
    assert file_quotas(table.limit(0), 5).count() == 0


def test_no_usable_file(spark, tmp_path):
    write(tmp_path, "d.csv", "Protocol,Flow Duration", "6,1")
    with pytest.raises(ValueError):
        read_labelled(spark, f"{tmp_path}/*.csv")


def test_limit_takes_quotas(spark, tmp_path):
    row = "80,6,1500000,{i},2,100,400,250000,1000,1,0,2,12.5,Benign"
    for name, n in (("a", 50), ("b", 3), ("c", 50)):
        write(tmp_path, f"{name}.csv", SHORT, *[row.format(i=i) for i in range(n)])
    assert read_labelled(spark, f"{tmp_path}/*.csv", limit=20).count() == 7 + 3 + 6
    assert read_labelled(spark, f"{tmp_path}/*.csv", limit=2).count() == 2
    assert read_labelled(spark, f"{tmp_path}/*.csv").count() == 103


def test_flow_ids_of_one_column(spark):
    ids = ["1.1.1.1:5-2.2.2.2:6-6", "1.1.1.1-2.2.2.2-5-6-17", "a-b", None, "1.1.1.1:99999999999-2.2.2.2:6-6"]
    table = parse_flow_id(spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "n int, id string"), "id").orderBy("n")
    ends = [(r.src_ip, r.src_port, r.dst_ip, r.dst_port) for r in table.collect()]
    known = ("1.1.1.1", 5, "2.2.2.2", 6)
    assert ends == [known, known, ("0.0.0.0", 0, "0.0.0.0", 0), ("0.0.0.0", 0, "0.0.0.0", 0), ("1.1.1.1", 0, "2.2.2.2", 6)]


def test_normalising_needs_no_python(spark):
    raw = spark.createDataFrame([tuple("1" for _ in SHORT.split(","))], ", ".join(f"`{n}` string" for n in SHORT.split(",")))
    plan = normalise_labelled(raw)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_synthetic_mix(spark):
    table = synthetic_flows(spark, 300, 40, 30, seed=1)
    assert table.count() == 370
    assert table.where("label = 0").count() == 300
    flood = table.where("label = 1 AND bidirectional_packets >= 1000")
    assert flood.count() == 40 and flood.where("tcp_syn_count <> bidirectional_packets OR dst_port > 1024").count() == 0
    ends = table.agg(F.min("dst_port"), F.max("dst_port"), F.min("src_port"), F.min("flow_duration"), F.max("flow_duration")).first()
    assert ends[0] >= 1 and ends[1] <= 65535 and ends[2] >= 1025 and ends[3] > 0 and ends[4] <= 5.0
    private = r"^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.)[0-9.]*\.([1-9][0-9]*)$"
    assert table.where("label = 0").where(~F.col("src_ip").rlike(private)).count() == 0
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, synthetic_flows(spark, 300, 40, 30, seed=1).collect()))
    assert table.first() != synthetic_flows(spark, 300, 40, 30, seed=2).first()
