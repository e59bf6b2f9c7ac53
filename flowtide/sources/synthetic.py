"""Labelled synthetic flows: every value is a hash of (seed, row id, name), so the table is built in parallel.

A row id table can come from ``spark.range`` or from any table with a unique id.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import uniform, uniform_int
from ..operators.sampling import seeded_shuffle
from ..schemas import FLOW_LABELLED

# Ports of common services.
SERVICE_PORTS = [80, 443, 22, 25, 53, 123]
KINDS = ["benign", "syn_flood", "port_scan"]


def random_ip(seed: int, ident: Column, name: str, private: bool = True) -> Column:
    """G1: an address of one of the private ranges (even odds, last octet 1 to 254) or any IPv4 address."""

    def octet(i, low, high):
        return uniform_int(seed, low, high, ident, f"{name}{i}")

    def dotted(*parts):
        return F.concat_ws(".", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])

    if not private:
        return dotted(*[octet(i, 0, 255) for i in range(4)])
    # One draw picks the range; equal parts of it stand for 10/8, 172.16/12 and 192.168/16.
    block = uniform_int(seed, 0, 2, ident, f"{name}block")
    second = uniform(seed, ident, f"{name}1")

    def spread(low, high):
        return F.floor(second * F.lit(float(high - low + 1))).cast("bigint") + F.lit(low)

    heads = F.array(dotted(10, spread(0, 255)), dotted(172, spread(16, 31)), dotted(192, 168))
    return dotted(F.element_at(heads, (block + 1).cast("int")), octet(2, 0, 255), octet(3, 1, 254))


def _base(seed: int, ident: Column, kind: str) -> dict[str, Column]:
    whole = partial(_whole, seed, ident)
    real = partial(_real, seed, ident)
    inside, outside = (random_ip(seed, ident, n, p) for n, p in (("inside", True), ("outside", False)))
    zero = F.lit(0).cast("bigint")
    if kind == "benign":
        service = F.element_at(F.array(*map(F.lit, SERVICE_PORTS)), (whole("service", 1, len(SERVICE_PORTS))).cast("int"))
        common = uniform(seed, ident, "common") < F.lit(0.8)
        return {
            "src_ip": inside,
            "dst_ip": outside,
            "dst_port": F.when(common, service.cast("bigint")).otherwise(whole("dst_port", 1, 65535)),
            "protocol": F.when(uniform(seed, ident, "protocol") < F.lit(0.5), "tcp").otherwise("udp"),
            "packets": whole("packets", 1, 50),
            "size": whole("size", 40, 1500),
            "std": F.col("size") * real("std", 0.1, 0.5),
            "duration": real("duration", 0.001, 5.0),
            "syn": zero,
            "iat_spread": real("iat_std", 0.1, 0.5),
            "label": F.lit(0),
        }
    flood = kind == "syn_flood"
    return {
        "src_ip": outside,
        "dst_ip": inside,
        "dst_port": whole("dst_port", 1, 1024 if flood else 65535),
        "protocol": F.lit("tcp"),
        "packets": whole("packets", *((1000, 5000) if flood else (1, 3))),
        "size": whole("size", *((40, 80) if flood else (40, 200))),
        "std": real("std", 0.0, 5.0) if flood else F.lit(0.0),
        "duration": real("duration", *((0.01, 1.0) if flood else (0.0001, 0.01))),
        "syn": F.col("packets"),
        "iat_spread": F.lit(0.0),
        "label": F.lit(1),
    }


def _whole(seed: int, ident: Column, name: str, low: int, high: int) -> Column:
    return uniform_int(seed, low, high, ident, name)


def _real(seed: int, ident: Column, name: str, low: float, high: float) -> Column:
    return F.lit(low) + uniform(seed, ident, name) * F.lit(high - low)


def synthetic_kind(ids: DataFrame, kind: str, seed: int = 42, ident: str = "id") -> DataFrame:
    """One flow of a kind per row of ``ids``; keeps the id column."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    base = _base(seed, F.col(ident), kind)
    late = {n: base.pop(n) for n in ("std", "syn")}
    table = ids.select(ident, *[c.alias(n) for n, c in base.items()])
    table = table.withColumns({**late, "src_port": uniform_int(seed, 1025, 65535, F.col(ident), "src_port")})
    packets, duration = F.col("packets"), F.col("duration")
    finished = {
        "window": F.lit(0),
        "bidirectional_packets": packets,
        "bidirectional_bytes": packets * F.col("size"),
        "mean_packet_size": F.col("size"),
        "std_packet_size": F.col("std"),
        "flow_duration": duration,
        "tcp_syn_count": F.col("syn"),
        "tcp_fin_count": F.lit(0),
        "tcp_rst_count": F.lit(0),
        "iat_mean": duration / packets,
        "iat_std": duration / packets * F.col("iat_spread"),
        "bytes_per_packet": F.col("size"),
        "packets_per_second": packets / duration,
    }
    fields = [finished.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in FLOW_LABELLED]
    return table.select(ident, *fields)


def synthetic_flows(
    spark: SparkSession, benign: int = 1000, syn_flood: int = 100, port_scan: int = 100, seed: int = 42
) -> DataFrame:
    """A shuffled mix of the three kinds."""
    table, start = None, 0
    for kind, n in zip(KINDS, (benign, syn_flood, port_scan)):
        part = synthetic_kind(spark.range(start, start + n), kind, seed)
        table = part if table is None else table.unionByName(part)
        start += n
    return seeded_shuffle(table, seed, ["id"]).drop("id")
