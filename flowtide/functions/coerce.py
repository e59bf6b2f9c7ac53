"""Tolerant conversions: bad text becomes null or a default, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of a true flag, or a whole number other than zero; blanks around are ignored.
TRUE_FLAG = r"(?i)^\s*(true|t|yes|y|[+-]?(?=[0-9_]*[1-9])[0-9]+(_[0-9]+)*)\s*$"

WHITESPACE = " \t\n\r\x0b\x0c"
MIN_DURATION = 1e-6


def strip(text: Column) -> Column:
    """Trim all ASCII white space, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def flag_to_int(flag: Column) -> Column:
    """1 for a true spelling or any non-zero whole number, else 0 (also for null)."""
    return F.coalesce(flag.cast("string").rlike(TRUE_FLAG).cast("int"), F.lit(0))


def _may_be_number(text: Column) -> Column:
    """False for text whose first sign is a letter that begins no number: the cast would raise and catch an error for it."""
    first = F.ascii(text)
    return first.between(1, ord("9")) | first.isin(ord("i"), ord("I"))


def to_double(text: Column) -> Column:
    """number or null; NaN counts as missing."""
    return F.nanvl(F.when(_may_be_number(text), text.try_cast("double")), F.lit(None).cast("double"))


def to_double_or_zero(text: Column) -> Column:
    return F.coalesce(to_double(text), F.lit(0.0))


def to_count(text: Column) -> Column:
    """whole number, cut towards zero; garbage and infinities are 0."""
    return whole(to_double_or_zero(text))


def whole(number: Column) -> Column:
    return F.coalesce(number.try_cast("bigint"), F.lit(0).cast("bigint"))


def micros_to_seconds(text: Column) -> Column:
    """microseconds as text to seconds; bad text is 0."""
    return F.coalesce(to_double(text) / F.lit(1e6), F.lit(0.0))


def at_least(value: Column, floor) -> Column:
    """lower clip of a value that holds no NaN."""
    return F.greatest(value, F.lit(floor))


def binary_label(label: Column) -> Column:
    """0 for benign, 1 for all else; a missing label counts as an attack."""
    return (F.coalesce(F.upper(strip(label)), F.lit("NAN")) != "BENIGN").cast("int")


# Names and numbers of the two transport protocols.
PROTOCOLS = {"tcp": "tcp", "udp": "udp", "6": "tcp", "17": "udp", "6.0": "tcp", "17.0": "udp"}


def protocol_name(text: Column) -> Column:
    """Tcp or udp from a name or a number, else ``other``."""
    known = F.create_map(*[F.lit(x) for pair in PROTOCOLS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(strip(text))), F.lit("other"))
