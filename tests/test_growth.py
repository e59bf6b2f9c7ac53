"""Steps of checks whose tasks must grow in number with the input, and what the sample and the scan leave out."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks import labelled_checks, model_checks
from flowtide.operators.sampling import row_hash, smallest_per_group
from flowtide.sources.labelled import read_labelled, skipped_files

SF = "/root/testdata/sf0.001"
HEADER = "Protocol,Flow Duration,Tot Fwd Pkts,Tot Bwd Pkts,TotLen Fwd Pkts,TotLen Bwd Pkts,Label\n"


@pytest.mark.parametrize("rows, files", [(250_000, {3}), (100, {*range(10, 60)})])
def test_odd_files_grow_in_number(spark, monkeypatch, rows, files):
    """a task writes or unpacks so many rows at most, about."""
    monkeypatch.setattr(labelled_checks, "FILE_ROWS", rows)
    folder = Path(labelled_checks.write_odd_files(spark, SF).removesuffix("/*/*.csv*"))
    assert {len(list(p.glob("part-*"))) for p in folder.iterdir()} <= files


def test_the_scan_leaves_unusable_files_out(spark, tmp_path):
    """a file that is no gzip at all has no header; the scan must not open it."""
    (tmp_path / "a.csv").write_text(HEADER + "6,1,1,1,1,1,x\n17,1,1,1,1,1,x\n")
    (tmp_path / "b.csv.gz").write_bytes(b"no gzip\n" * 50)
    (tmp_path / "c.csv").write_text(HEADER.replace(",Label", "") + "6,1,1,1,1,1\n" * 9)
    assert skipped_files(spark, f"{tmp_path}/*").count() == 2
    assert read_labelled(spark, f"{tmp_path}/*").count() == 2
    assert read_labelled(spark, f"{tmp_path}/*", limit=1).count() == 1


def test_a_stored_hash_gives_the_same_sample(spark):
    """the hash may be taken from a column."""
    table = spark.range(3000).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 700).alias("v"))
    quota = spark.createDataFrame([("0", 10), ("1", 401), ("2", 0)], "g string, quota bigint")
    want = smallest_per_group(table, ["g"], 5, ["v"], quota=quota)
    got = smallest_per_group(table.withColumn("h", row_hash(5, ["v"])), ["g"], 5, ["v"], quota=quota, hashed="h")
    assert sorted(got.drop("h").collect()) == sorted(want.collect()) and want.count() == 411


def test_training_partitions_grow_with_the_flows(spark, monkeypatch):
    """a fixed number of partitions would leave the first pass over the flows to three tasks."""
    seen = []

    def trained(flows, params, **more):
        seen.append(flows.rdd.getNumPartitions())
        raise InterruptedError

    monkeypatch.setattr(model_checks, "PART_FLOWS", 100)
    monkeypatch.setattr(model_checks, "train", trained)
    with pytest.raises(InterruptedError):
        model_checks.train_properties(spark, SF)
    assert seen[0] > 8
