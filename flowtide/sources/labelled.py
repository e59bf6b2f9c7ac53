"""Labelled flow data sets with varying headers, normalised to one schema."""

from __future__ import annotations

import csv
import logging
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.addresses import UNKNOWN_IP, flow_id_endpoints, flow_id_parts
from ..functions.coerce import (
    MIN_DURATION,
    at_least,
    binary_label,
    micros_to_seconds,
    protocol_name,
    to_count,
    to_double_or_zero,
    whole,
)
from ..operators.sampling import row_hash, smallest_per_group
from ..schemas import LABELLED_COLUMNS
from ..storage import materialise

LOG = logging.getLogger(__name__)

# Accepted header names of each logical field, best first.
SYNONYMS = {
    "flow_id": ["flow id", "flowid"],
    "src_ip": ["src ip", "source ip", "src_ip"],
    "dst_ip": ["dst ip", "destination ip", "dst_ip"],
    "src_port": ["src port", "source port", "src_port"],
    "dst_port": ["dst port", "destination port", "dst_port"],
    "protocol": ["protocol"],
    "flow_duration_us": ["flow duration", "flow duration(us)", "flow_duration"],
    "flow_iat_mean_us": ["flow iat mean", "flow iat mean(us)", "flow_iat_mean"],
    "flow_iat_std_us": ["flow iat std", "flow iat std(us)", "flow_iat_std"],
    "fwd_pkts": ["tot fwd pkts", "total fwd packets", "fwd packets", "fwd_pkts"],
    "bwd_pkts": ["tot bwd pkts", "total backward packets", "bwd packets", "bwd_pkts"],
    "fwd_bytes": ["totlen fwd pkts", "total length of fwd packets", "fwd bytes", "fwd_bytes"],
    "bwd_bytes": ["totlen bwd pkts", "total length of bwd packets", "bwd bytes", "bwd_bytes"],
    "syn": ["syn flag cnt", "syn flag count", "syn"],
    "fin": ["fin flag cnt", "fin flag count", "fin"],
    "rst": ["rst flag cnt", "rst flag count", "rst"],
    "pkt_len_std": ["pkt len std", "packet length std", "pkt length std"],
    "label_raw": ["label"],
}

# Fields without which a file is skipped.
REQUIRED = ["protocol", "flow_duration_us", "fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes", "label_raw"]


def normalise_name(name: str) -> str:
    """Lower case, slashes as blanks, runs of blanks as one."""
    return " ".join(name.lower().replace("/", " ").split())


def resolve_header(names: list[str]) -> dict[str, int]:
    """Position of each logical field in a header, or an error that lists the missing required ones.

    Of columns whose names differ only in case or blanks the last wins; of exact repeats the first.
    """
    position: dict[str, int] = {}
    seen: set[str] = set()
    for i, name in enumerate(names):
        if name not in seen:
            seen.add(name)
            position[normalise_name(name)] = i
    found = {}
    for field, synonyms in SYNONYMS.items():
        hit = next((s for s in synonyms if s in position), None)
        if hit is not None:
            found[field] = position[hit]
    missing = [f for f in REQUIRED if f not in found]
    if missing:
        raise KeyError(f"missing required columns: {missing}")
    return found


#: Where the endpoints of a layout come from.
EXPLICIT, BY_FLOW_ID, NOWHERE = range(3)


def endpoint_kind(mapping: dict[str, int]) -> int:
    """Explicit addresses win over the flow id."""
    if "src_ip" in mapping and "dst_ip" in mapping:
        return EXPLICIT
    return BY_FLOW_ID if "flow_id" in mapping else NOWHERE


def _endpoints(field: dict[str, Column], kinds: set[int], kind: Column) -> dict[str, Column]:
    """Explicit addresses, else the flow id (then its ports win), else 0.0.0.0; ports default to 0.

    ``kinds`` are those that occur, ``kind`` is that of the row.
    """

    def port(name):
        return F.coalesce(whole(to_double_or_zero(field[name])).try_cast("int"), F.lit(0)) if name in field else F.lit(0)

    ports = {"src_port": port("src_port"), "dst_port": port("dst_port")}
    ways = {NOWHERE: {"src_ip": F.lit(UNKNOWN_IP), "dst_ip": F.lit(UNKNOWN_IP), **ports}}
    if EXPLICIT in kinds:
        ways[EXPLICIT] = {n: F.coalesce(field[n], F.lit("nan")) for n in ("src_ip", "dst_ip")} | ports
    if BY_FLOW_ID in kinds:
        ways[BY_FLOW_ID] = flow_id_endpoints(field["flow_id"])
    if len(kinds) == 1:
        return ways[min(kinds)]
    return {n: F.coalesce(*[F.when(kind == k, ways[k][n]) for k in sorted(kinds)]) for n in ways[NOWHERE]}


def normalise_labelled(
    raw: DataFrame, mapping: dict[str, int] | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Text columns of one header layout to the normalised schema, tcp and udp only.

    ``keep`` names further columns of ``raw`` to carry along in front.
    """
    keep = keep or []
    data = [c for c in raw.columns if c not in keep]
    mapping = resolve_header(data) if mapping is None else mapping
    return normalise_layouts(raw, data, [mapping], None, keep)


def normalise_layouts(
    raw: DataFrame, data: list[str], layouts: list[dict[str, int]], which: Column | None, keep: list[str]
) -> DataFrame:
    """The same for rows of several layouts: ``data`` are the text columns by position, ``which`` a row's layout."""
    kinds = [endpoint_kind(m) for m in layouts]
    fields = [f for f in SYNONYMS if any(f in m for m in layouts)]
    if BY_FLOW_ID not in kinds and "flow_id" in fields:
        fields.remove("flow_id")

    def by_layout(values: list[Column | None]) -> Column:
        """The value of the row's layout; null where its layout has none."""
        if which is None:
            return values[0]
        first = {}
        for i, v in enumerate(values):
            if v is not None:
                first.setdefault(str(v), (v, []))[1].append(i)
        return F.coalesce(*[F.when(which.isin(ids), v) for v, ids in first.values()])

    source = {f: by_layout([F.col(f"`{data[m[f]]}`") if f in m else None for m in layouts]) for f in fields}
    if "flow_id" in source:
        source["flow_id"] = flow_id_parts(source["flow_id"])
    kind = by_layout([F.lit(k) for k in kinds]).alias("_kind")
    raw = raw.select(*[F.col(f"`{c}`") for c in keep], kind, *[c.alias(f"_{f}") for f, c in source.items()])
    field = {f: F.col(f"_{f}") for f in source}

    def optional(name, convert, default):
        return convert(field[name]) if name in field else F.lit(default)

    # Sums by a function over an array keep the step out of whole-stage code, where all cells together make one method that
    # is too long for the JVM to compile; as a projection of its own its parts are compiled (three times as fast).
    def both_ways(what):
        cells = F.array(field[f"fwd_{what}"], field[f"bwd_{what}"])
        return whole(F.aggregate(cells, F.lit(0.0), lambda total, cell: total + to_double_or_zero(cell)))

    packets = at_least(both_ways("pkts"), 1)
    size = at_least(both_ways("bytes"), 0)
    base = raw.select(
        *[F.col(f"`{c}`") for c in keep],
        *[c.alias(n) for n, c in _endpoints(field, set(kinds), F.col("_kind")).items()],
        protocol_name(field["protocol"]).alias("protocol"),
        at_least(micros_to_seconds(field["flow_duration_us"]), MIN_DURATION).alias("flow_duration"),
        packets.alias("bidirectional_packets"),
        size.alias("bidirectional_bytes"),
        optional("pkt_len_std", to_double_or_zero, 0.0).alias("std_packet_size"),
        optional("syn", to_count, 0).cast("bigint").alias("tcp_syn_count"),
        optional("fin", to_count, 0).cast("bigint").alias("tcp_fin_count"),
        optional("rst", to_count, 0).cast("bigint").alias("tcp_rst_count"),
        optional("flow_iat_mean_us", micros_to_seconds, 0.0).alias("iat_mean"),
        optional("flow_iat_std_us", micros_to_seconds, 0.0).alias("iat_std"),
        binary_label(field["label_raw"]).alias("label"),
    ).where(F.col("protocol").isin("tcp", "udp"))
    per_packet = F.col("bidirectional_bytes") / F.col("bidirectional_packets")
    return base.withColumns(
        {
            "mean_packet_size": per_packet,
            "bytes_per_packet": per_packet,
            "packets_per_second": F.col("bidirectional_packets") / F.col("flow_duration"),
        }
    ).select(*keep, *LABELLED_COLUMNS)


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(source_file, path) of the files that match a glob: the name that a scan's file column gives, and the plain path.

    Both come from one scan, as the two differ where a path holds a blank or another escaped character. No content is read.
    """
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(F.col("_metadata.file_path").alias("source_file"), "path")


#: What the tasks can unpack themselves, by the end of the file name.
_PACKED = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}
_OTHERS = (".deflate", ".lz4", ".snappy", ".lzo", ".zstd")


def _open_header(name: str, path: str) -> tuple[str | None, str]:
    """First line of a file and "read"; "unreadable" where there is none to read, "closed" if this task cannot tell."""
    from pyarrow import ArrowException, CompressedInputStream, fs

    if path.endswith(_OTHERS):
        return None, "closed"
    try:
        if path.startswith(("file:", "/")):
            files, place = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        else:
            files, place = fs.FileSystem.from_uri(name)
    except (ArrowException, ValueError, OSError):
        return None, "closed"
    packed = next((c for end, c in _PACKED.items() if path.endswith(end)), None)
    try:
        with files.open_input_stream(place, compression=None) as raw:
            text = CompressedInputStream(raw, packed) if packed else raw
            held = b""
            while b"\n" not in held and b"\r" not in held and (more := text.read(65536)):
                held += more
    except FileNotFoundError:
        # Another machine's folder, or a file that has gone: the engine's own readers decide.
        return None, "closed"
    except (ArrowException, OSError):
        return None, "unreadable"
    return held.replace(b"\r", b"\n").split(b"\n", 1)[0].decode("utf-8", "replace"), "read"


def header_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """(source_file, path, line) of all files of a glob, stored; ``line`` is null if none can be read.

    Tasks open the files, each reads as much as its first line takes. What they cannot open (file systems or codecs that
    only the engine's readers know) is read by a text scan instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_open_header(n, p) for n, p in zip(*(batch.column(c).to_pylist() for c in ("source_file", "path")))]
            lines, states = zip(*found) if found else ((), ())
            columns = [batch.column("source_file"), batch.column("path"), pa.array(lines, pa.string()), pa.array(states, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["source_file", "path", "line", "state"])

    schema = "source_file string, path string, line string, state string"
    opened = materialise(list_files(spark, pattern).mapInArrow(run, schema), "headers")
    closed = opened.where("state = 'closed'").select("source_file", "path")
    if closed.isEmpty():
        return opened.drop("state")
    text = spark.read.option("ignoreCorruptFiles", True).text(pattern).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("start"), "value",
        F.monotonically_increasing_id().alias("at"))
    first = text.where("start = 0").groupBy("source_file").agg(F.min_by("value", "at").alias("line"))
    return materialise(
        opened.where("state <> 'closed'").drop("state").unionByName(closed.join(first, "source_file", "left")), "headers")


@dataclass
class Layouts:
    """The distinct usable layouts with the width of the widest, and the stored table (source_file, path, layout, reason)."""

    mappings: list[dict[str, int]]
    width: int
    files: DataFrame


def find_layouts(spark: SparkSession, pattern: str) -> Layouts:
    """Which layout each file of a glob has, or why it is not usable. The driver sees the distinct headers only."""
    lines = header_lines(spark, pattern)
    rows, mappings, width = [], [], 0
    for (line,) in sorted(lines.where("line IS NOT NULL").select("line").distinct().collect()):
        header = _split_header(line)
        try:
            mapping = resolve_header(header)
        except KeyError as error:
            rows.append((line, None, error.args[0]))
            continue
        rows.append((line, len(mappings), None))
        mappings.append(mapping)
        width = max(width, len(header))
    known = spark.createDataFrame(rows, "line string, layout int, reason string")
    judged = lines.join(F.broadcast(known), "line", "left")
    reason = F.when(F.col("line").isNull(), "unreadable header").otherwise(F.col("reason")).alias("reason")
    return Layouts(mappings, width, materialise(judged.select("source_file", "path", "layout", reason), "file-layouts"))


def skipped_files(spark: SparkSession, pattern: str) -> DataFrame:
    """P10: (path, reason) of the files of a glob that ``read_labelled`` leaves out."""
    return find_layouts(spark, pattern).files.where("layout IS NULL").select("path", "reason")


def _split_header(line: str) -> list[str]:
    return next(csv.reader([line.removeprefix("\ufeff")]), [])


def quotas(limit: int, files: list[str]) -> dict[str, int]:
    """L1: rows per file: an equal share, and one more for the first ``limit % n`` files."""
    share, extra = divmod(limit, len(files))
    return {path: share + (i < extra) for i, path in enumerate(files)}


def file_quotas(files: DataFrame, limit: int) -> DataFrame:
    """L1: the same as a table (source_file, quota), with files in the order of their names.

    Files are numbered range by range, so their list is not sorted in one task; one row per range is summed up.
    """
    ranges = materialise(
        files.select("source_file").repartitionByRange("source_file").withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return files.select("source_file", F.lit(0).cast("bigint").alias("quota"))
    share, extra = divmod(limit, total)
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("range").orderBy("source_file")) + F.col("before") - 1
    numbered = ranges.withColumnRenamed("range", "r").join(
        F.broadcast(sizes.select("range", before.alias("before"))), F.col("r") == F.col("range"))
    return numbered.select("source_file", (F.lit(share) + (place < extra).cast("bigint")).alias("quota"))


#: Files up to which the table of layouts is broadcast; beyond, it is joined by shuffle.
BROADCAST_FILES = 1_000_000
#: Unusable files up to which the scan leaves them out by name; beyond, their rows are read and dropped by the join.
NAMED_FILES = 10_000


def read_labelled(spark: SparkSession, pattern: str, limit: int = 0, seed: int = 42) -> DataFrame:
    """All usable files of a glob in the normalised schema; with a limit, a uniform sample of each file.

    All layouts are read by one scan, by position, and each row finds its fields by the layout of its file.
    """
    found = find_layouts(spark, pattern)
    skipped, usable, n = found.files.agg(
        F.count_if(F.col("layout").isNull()), F.count("layout"), F.count(F.lit(1))).first()
    if skipped:
        LOG.warning("%d of %d files of %s are not usable; skipped_files tells why", skipped, n, pattern)
    if not usable:
        raise ValueError(f"no usable file matches {pattern}")
    names = [f"c{i}" for i in range(found.width)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(pattern)
    if 0 < skipped <= NAMED_FILES:
        unusable = [r[0] for r in found.files.where("layout IS NULL").select("source_file").collect()]
        raw = raw.where(~F.col("_metadata.file_path").isin(unusable))
    files = found.files.where("layout IS NOT NULL").select("source_file", "layout")
    placed = raw.select(F.col("_metadata.file_path").alias("source_file"), *names).join(
        F.broadcast(files) if n <= BROADCAST_FILES else files, "source_file")
    table = normalise_layouts(placed, names, found.mappings, F.col("layout"), ["source_file"])
    if table.isEmpty():
        raise ValueError(f"no flow in the files of {pattern}")
    if limit <= 0:
        return table.drop("source_file")
    # Sampling reads its input three times; parsing and hashing all rows once and reading the table is cheaper.
    table = materialise(table.withColumn("row_hash", row_hash(seed, LABELLED_COLUMNS)), "labelled")
    picked = quota_sample(table, file_quotas(files, limit), "source_file", seed, LABELLED_COLUMNS, "row_hash")
    return picked.drop("source_file", "row_hash")


def quota_sample(
    table: DataFrame, quota: dict[str, int] | DataFrame, source: str, seed: int = 42, key: list[str] | None = None,
    hashed: str | None = None,
) -> DataFrame:
    """L1/L2: from each source its quota of rows, a uniform sample that depends on seed and row content only.

    A source whose quota is 0 gives no rows, nor do rows without a source. With a table (source, ``quota``), sources that
    it lacks give none; a dictionary must name all. ``hashed``: see ``flag_smallest``.
    """
    share = quota
    if isinstance(quota, dict):
        schema = T.StructType([T.StructField(source, T.StringType()), T.StructField("quota", T.LongType())])
        share = table.sparkSession.createDataFrame([(s, int(q)) for s, q in quota.items()], schema)
        named = table.where(F.col(source).isNotNull()).select(source).distinct()
        unknown = named.join(share, source, "left_anti").limit(1).collect()
        if unknown:
            raise ValueError(f"no quota for source {unknown[0][0]!r}")
    key = key or [c for c in table.columns if c not in (source, hashed)]
    return smallest_per_group(table, [source], seed, key, quota=share, hashed=hashed)
