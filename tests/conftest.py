import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("flowtide-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


PACKET_DDL = (
    "ts_us bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, "
    "frame_len int, syn int, fin int, rst int"
)


@pytest.fixture
def make_packets(spark):
    def make(rows):
        return spark.createDataFrame(rows, PACKET_DDL)

    return make
