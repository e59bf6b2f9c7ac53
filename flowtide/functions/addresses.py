"""IP address order and flow-id parsing with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_V4 = r"^[0-9]{1,3}([.][0-9]{1,3}){3}$"


def _octets(ip: Column) -> list[Column]:
    head, tail = F.substring_index(ip, ".", 2), F.substring_index(ip, ".", -2)
    return [F.substring_index(part, ".", side) for part in (head, tail) for side in (1, -1)]


def _v4_key(ip: Column) -> Column:
    return F.concat(F.lit("4"), *[F.lpad(o, 3, "0") for o in _octets(ip)])


def _groups(side: Column) -> Column:
    """Colon-separated groups as four hex digits each; the empty side has none."""
    parts = F.filter(F.split(side, ":"), lambda g: g != "")
    return F.transform(parts, lambda g: F.lpad(g, 4, "0"))


def _v4_tail_as_hex(ip: Column) -> Column:
    """Rewrite a dotted IPv4 tail (``::ffff:1.2.3.4``) as two hex groups."""
    tail = F.substring_index(ip, ":", -1)
    octets = [F.lpad(F.hex(o.try_cast("bigint")), 2, "0") for o in _octets(tail)]
    head = F.substring(ip, F.lit(1), F.length(ip) - F.length(tail))
    rewritten = F.concat(head, *octets[:2], F.lit(":"), *octets[2:])
    return F.when(F.instr(tail, ".") > 0, rewritten).otherwise(ip)


def _v6_key(ip: Column) -> Column:
    text = _v4_tail_as_hex(F.lower(F.split_part(ip, F.lit("%"), F.lit(1))))
    left = _groups(F.split_part(text, F.lit("::"), F.lit(1)))
    right = _groups(F.split_part(text, F.lit("::"), F.lit(2)))
    fill = F.repeat(F.lit("0000"), F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0)))
    return F.concat(F.lit("6"), F.lower(F.concat(F.array_join(left, ""), fill, F.array_join(right, ""))))


def address_key(ip: Column) -> Column:
    """text that sorts like (ip version, packed address); other text sorts after all addresses."""
    return (
        F.when(ip.rlike(_V4), _v4_key(ip))
        .when(F.instr(ip, ":") > 0, _v6_key(ip))
        .otherwise(F.concat(F.lit("9"), ip))
    )


# The two layouts of a flow id, groups in the order they appear.
FLOW_ID_IP_PORT = r"([^:]+):(\d+)-([^:]+):(\d+)-(.+)"
FLOW_ID_IP_IP = r"([^-]+)-([^-]+)-(\d+)-(\d+)-(.+)"
UNKNOWN_IP = "0.0.0.0"
_MARK = "\x01"


def flow_id_parts(flow_id: Column) -> Column:
    """the four endpoint texts of a flow id as an array; each row tries both layouts, null if neither fits.

    One pattern holds both; the groups of the layout that does not fit are empty in the replacement.
    """
    either = f"^(?:{FLOW_ID_IP_PORT}|{FLOW_ID_IP_IP})$"
    found = F.regexp_replace(flow_id, either, _MARK.join(("$1$6", "$3$7", "$2$8", "$4$9")))
    parts = F.split(found, _MARK)
    return F.when(F.size(parts) == 4, parts)


def flow_id_endpoints(parts: Column) -> dict[str, Column]:
    """F2: endpoints from the parts of a flow id; an unreadable id gives 0.0.0.0 and port 0."""

    def text(i):
        return F.coalesce(F.get(parts, F.lit(i)), F.lit(UNKNOWN_IP))

    def port(i):
        return F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0))

    return {"src_ip": text(0), "dst_ip": text(1), "src_port": port(2), "dst_port": port(3)}


def parse_flow_id(df: DataFrame, column: str) -> DataFrame:
    """replace a flow id column by its four endpoint columns."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    parts = df.select(*rest, flow_id_parts(F.col(f"`{column}`")).alias("_id"))
    return parts.select(*rest, *[c.alias(n) for n, c in flow_id_endpoints(F.col("_id")).items()])
