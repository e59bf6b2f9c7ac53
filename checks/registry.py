"""Collects the check queries: a Spark function over the test tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def r4(column) -> Column:
    """Four decimals by the same floating-point steps in every engine."""
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(column * F.lit(1e4) + F.lit(0.5)) / F.lit(1e4)


def rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: r4(n) for n in names})


def sql_r4(expr: str, alias: str) -> str:
    return f"floor(({expr}) * 1e4 + 0.5) / 1e4 AS {alias}"


def sql_uniform(*parts: str) -> str:
    """SQL of ``uniform``: parts are SQL text expressions."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0)"


def sql_hash60(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT)"
