import pytest
from pyspark.sql import functions as F

from flowtide.functions.coerce import flag_to_int
from flowtide.sources.packets import data_lines, ingest_stats, parse_packets, read_packets, valid_packets

TRUE = ["1", "true", "True", "T", "yes", "Y", "42", "  True  ", "\t1\n", "-3", "1_0"]
FALSE = ["0", "false", "False", "f", "no", "N", "", None, "0xFF", "maybe", "1.5", "00", "_1"]


@pytest.mark.parametrize("text, want", [(t, 1) for t in TRUE] + [(t, 0) for t in FALSE])
def test_flag(spark, text, want):
    row = spark.createDataFrame([(text,)], "f string").select(flag_to_int(F.col("f")).alias("v")).first()
    assert row.v == want


LINES = {
    "100.5,1.1.1.1,2.2.2.2,10,20,,,60,True,0,": (100_500_000, "tcp", 10, 20, 60, 1, 0, 0),
    "100.123456789,1.1.1.1,2.2.2.2,10,,,,,0,1,0": (100_123_457, "tcp", 10, 0, 0, 0, 1, 0),
    "100,1.1.1.1,2.2.2.2,,,53,5353,80,1,1,1,extra,more": (100_000_000, "udp", 53, 5353, 80, 1, 1, 1),
    "  1e2,1.1.1.1,2.2.2.2,,7,9,9,80,,,  ": (100_000_000, "tcp", 0, 7, 80, 0, 0, 0),
}
REJECTED = [
    "100,1.1.1.1,2.2.2.2,10,20,,,60,1,0",
    ",1.1.1.1,2.2.2.2,10,20,,,60,1,0,0",
    "x,1.1.1.1,2.2.2.2,10,20,,,60,1,0,0",
    "nan,1.1.1.1,2.2.2.2,10,20,,,60,1,0,0",
    "100,,2.2.2.2,10,20,,,60,1,0,0",
    "100,1.1.1.1,,10,20,,,60,1,0,0",
    "100,1.1.1.1,2.2.2.2,,,,,60,1,0,0",
    "100,1.1.1.1,2.2.2.2,a,20,,,60,1,0,0",
    "100,1.1.1.1,2.2.2.2,,,5,b,60,1,0,0",
    "100,1.1.1.1,2.2.2.2,10,20,,,6.5,1,0,0",
]
IGNORED = ["", "   ", "Capturing on 'eth0'", "tshark: warning", "  tshark: indented"]


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


@pytest.mark.parametrize("line", LINES)
def test_accepted(spark, line):
    r = valid_packets(parse_packets(lines(spark, [line]))).first()
    assert (r.ts_us, r.protocol, r.src_port, r.dst_port, r.frame_len, r.syn, r.fin, r.rst) == LINES[line]


def test_rejects_and_counters(spark):
    every = lines(spark, [*LINES, *REJECTED, *IGNORED])
    stats = ingest_stats(parse_packets(every)).first()
    assert (stats.total_lines, stats.parsed, stats.skipped) == (len(LINES) + len(REJECTED), len(LINES), len(REJECTED))
    assert data_lines(lines(spark, IGNORED)).count() == 0


def test_counters_of_no_lines(spark):
    stats = ingest_stats(parse_packets(lines(spark, []))).first()
    assert tuple(stats) == (0, 0, 0)


def test_many_files(spark, tmp_path):
    for i, line in enumerate(LINES):
        (tmp_path / f"{i}.txt").write_text(line + "\n" + "Capturing on x\n" + REJECTED[i] + "\n")
    assert read_packets(spark, f"{tmp_path}/*.txt").count() == len(LINES)


def test_arrival_number_is_kept(spark):
    numbered = lines(spark, list(LINES)).withColumn("seq", F.lit(7))
    assert [r.seq for r in parse_packets(numbered).collect()] == [7] * len(LINES)
