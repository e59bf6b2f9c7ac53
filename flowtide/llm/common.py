"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as the inside of a character class: blank, tab, newline, vertical tab, form feed, return.
WORD_GAP = r"\x20\x09-\x0D"
SALTS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def whole_text(column: str = "text") -> Column:
    """The text; empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WORD_GAP}]+"), lambda w: w != F.lit(""))


#: Lines whose running sums are taken at once.
_BLOCK = 256


def sums_before(numbers: Column) -> Column:
    """For an array of numbers, the sums of those before each; in blocks, so that long arrays take no square of time."""

    def plain(values):
        zero = F.array(F.lit(0).cast("bigint"))
        sums = F.aggregate(values, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(sums, 1, F.size(sums) - 1)

    def total(values):
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _BLOCK).cast("int")),
                         lambda b: F.slice(numbers, b * _BLOCK + 1, _BLOCK))
    return let(blocks, lambda bs: let(plain(F.transform(bs, total)), lambda sums: F.flatten(
        F.transform(bs, lambda block, b: F.transform(plain(block), lambda v: v + F.get(sums, b))))))


def salted_join(large: DataFrame, small: DataFrame, keys: list[str], salt_by: list[str], how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """Equi-join whose hot keys spread over ``salts`` partitions: each row of ``small`` is repeated once per salt.

    ``small`` has one row per key, so the copies stay at ``salts`` times its rows, whatever a key holds in ``large``.
    """
    salt = "__salt"
    spread = large.withColumn(salt, F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*keys, salt], how).drop(salt)


def spread_join(large: DataFrame, small: DataFrame, key: str, rows: str, how: str = "inner",
                salt_by: list[str] | None = None) -> DataFrame:
    """Equi-join with ``small`` (one row per key; ``rows``: how many rows of ``large`` have that key, at least 1).

    A key with more rows than an average partition is dealt over as many partitions as its rows would fill. There are
    fewer such keys than partitions, so their list is broadcast, and ``small`` grows by fewer rows than twice the
    partitions. Rows of a hot key are dealt by a hash of ``salt_by``, or else in turn, which only a stored ``large`` allows
    (a lost task must deal them the same way). ``small`` is read three times: hand in a stored one.
    """
    spark = large.sparkSession
    parts = partitions(spark)
    total = small.agg(F.sum(rows)).first()[0] or 1
    fill = F.ceil(F.col(rows) * F.lit(parts) / F.lit(float(total))).cast("bigint")
    hot = small.where(F.col(rows) * F.lit(parts) > total).select(key, fill.alias("__fill"))
    turn = F.monotonically_increasing_id() if salt_by is None else F.xxhash64(*salt_by)
    dealt = large.join(F.broadcast(hot), key, "left").withColumn(
        "__salt", F.coalesce(F.pmod(turn, F.col("__fill")), F.lit(0))).drop("__fill")
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), fill - 1))).drop(rows)
    return dealt.join(copies, [key, "__salt"], how).drop("__salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
