"""Exact deterministic samples and splits without sorting a whole group in one task.

Rows are ordered by a hash of their key, and the first so many of each group are wanted. Two narrow passes find where
that rank lies: a histogram of the leading hash bits gives the bucket, and the rows of that one bucket, copies folded,
give the last wanted (hash, key) of the group. The choice itself is then a comparison per row: no shuffle of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import HASH_BITS, hash60
from ..storage import materialise

BUCKET_BITS = 18
# Up to this many groups the table of limits (one row per group) is broadcast; beyond, it is joined by shuffle.
BROADCAST_GROUPS = 100_000
# Copies of one row are written out in runs of this length, by different tasks.
COPY_RUN = 65_536


def _order_text(columns: list[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]


def row_hash(seed: int, key: list[str]) -> Column:
    """The hash by which rows are ordered; worth storing where a table is sampled, as that reads it three times."""
    return hash60(seed, *_order_text(key))


def flag_smallest(
    df: DataFrame,
    group: list[str],
    seed: int,
    key: list[str],
    quota: DataFrame | None = None,
    fraction: float | None = None,
    name: str = "chosen",
    hashed: str | None = None,
) -> DataFrame:
    """Flag the ``quota`` (or ``floor(fraction * n)``) rows of each group that come first in hash order.

    ``quota`` has the group columns and ``quota``; groups that it lacks have none. Ties in the hash go by key text, which
    is made for rows of the last bucket only. ``hashed`` names a column that holds ``row_hash`` of the key already.
    """
    text = F.concat_ws("\x01", *_order_text(key))
    keyed = df.withColumn("_h", F.col(hashed) if hashed else row_hash(seed, key))
    limits, partial = _collect(_limits(keyed, group, text, quota, fraction), group)
    ends = [f"_g_{g}" for g in group]
    placed = keyed.join(limits, _same_group(group), "left")
    placed = placed.withColumn("_key", F.when(F.col("_h") == F.col("_last_h"), text))
    last = (F.col("_h") == F.col("_last_h")) & (F.col("_key") == F.col("_last_key"))
    first = (F.col("_h") < F.col("_last_h")) | ((F.col("_h") == F.col("_last_h")) & (F.col("_key") < F.col("_last_key")))
    if not partial:
        return placed.select(*df.columns, F.coalesce(first | last, F.lit(False)).alias(name))
    shared = F.coalesce(last & (F.col("_take") < F.col("_copies")), F.lit(False))
    sure = placed.where(~shared).select(*df.columns, F.coalesce(first | last, F.lit(False)).alias(name))
    return sure.unionByName(_share_copies(placed.where(shared).drop(*ends), df.columns, group, name))


def _limits(keyed: DataFrame, group: list[str], text: Column, quota: DataFrame | None, fraction: float | None) -> DataFrame:
    """One row per group: the last wanted (hash, key), how many rows have it, and how many of those are wanted."""
    bucketed = keyed.withColumn("_b", F.shiftright("_h", HASH_BITS - BUCKET_BITS))
    counts = bucketed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    totals = counts.withColumns({"_total": F.sum("_n").over(whole), "_upto": _running("_n", whole, ["_b"])})
    if quota is not None:
        totals = totals.join(quota.select(*group, F.col("quota").alias("_k")), group)
    else:
        totals = totals.withColumn("_k", F.floor(F.col("_total") * F.lit(fraction)).cast("bigint"))
    totals = totals.withColumn("_k", F.least("_k", "_total"))
    cut = _hit(totals, "_n", F.col("_k")).select(*group, F.col("_b").alias("_cut"), "_need")

    cut, _ = _collect(cut, group)
    edge = bucketed.join(cut, _same_group(group) & (F.col("_b") == F.col("_cut")))
    edge = edge.select(*group, "_h", text.alias("_key"), "_need")
    folded = edge.groupBy(*group, "_h", "_key", "_need").agg(F.count(F.lit(1)).alias("_copies"))
    placed = folded.withColumn("_upto", _running("_copies", whole, ["_h", "_key"]))
    return _hit(placed.withColumnRenamed("_need", "_wanted"), "_copies", F.col("_wanted")).select(
        *group, F.col("_h").alias("_last_h"), F.col("_key").alias("_last_key"), "_copies", F.col("_need").alias("_take")
    )


def _running(count: str, whole: Window, order: list[str]) -> Column:
    return F.sum(count).over(whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _hit(running: DataFrame, count: str, wanted: Column) -> DataFrame:
    """The row of each group in which the running count reaches ``wanted``; ``_need`` is what is wanted of that row."""
    before = F.col("_upto") - F.col(count)
    return running.where((F.col("_upto") >= wanted) & (before < wanted)).withColumn("_need", wanted - before)


def _collect(table: DataFrame, group: list[str]) -> tuple[DataFrame, bool]:
    """A stored table of one row per group, broadcast if its length is within bounds, and whether some copies are shared."""
    stored = materialise(table.withColumnsRenamed({g: f"_g_{g}" for g in group}), "limits")
    shared = F.count_if(F.col("_take") < F.col("_copies")) if "_take" in stored.columns else F.count(F.lit(None))
    groups, partial = stored.agg(F.count(F.lit(1)), shared).first()
    return (F.broadcast(stored) if groups <= BROADCAST_GROUPS else stored), bool(partial)


def _same_group(group: list[str]) -> Column:
    match = F.lit(True)
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return match


def _share_copies(last: DataFrame, columns: list[str], group: list[str], name: str) -> DataFrame:
    """Rows that tie for the last places: equal rows fold, the first ``_take`` of all are flagged, then all unfold."""
    folded = last.groupBy(*columns, "_take").agg(F.count(F.lit(1)).alias("_n"))
    placed = folded.withColumn("_upto", _running("_n", Window.partitionBy(*group), _order_text(columns)))
    chosen = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_take") - (F.col("_upto") - F.col("_n"))))
    yes = placed.select(*columns, F.lit(True).alias(name), chosen.alias("_times"))
    no = placed.select(*columns, F.lit(False).alias(name), (F.col("_n") - chosen).alias("_times"))
    return repeat_rows(yes.unionByName(no), "_times")


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its ``times`` column says; long repeats are spread over many tasks."""
    rest = [c for c in df.columns if c != times]
    last = F.floor((F.col(times) - F.lit(1)) / F.lit(COPY_RUN)).cast("bigint")
    runs = df.where(F.col(times) > 0).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    runs = runs.repartition(*rest, "_run")
    length = F.least(F.lit(COPY_RUN).cast("bigint"), F.col(times) - F.col("_run") * F.lit(COPY_RUN))
    return runs.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), length))).select(*rest)


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """Add a row number that follows from the row's content: a hash of it, and of its place among equal rows.

    Equal rows fold before the shuffle and unfold in runs, so a row that a third of the table repeats is no hot key.
    """
    last = F.floor((F.col("_n") - F.lit(1)) / F.lit(COPY_RUN)).cast("bigint")
    folded = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    runs = folded.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).repartition(*df.columns, "_run")
    length = F.least(F.lit(COPY_RUN).cast("bigint"), F.col("_n") - F.col("_run") * F.lit(COPY_RUN))
    placed = runs.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), length)))
    number = F.shiftrightunsigned(F.xxhash64(*df.columns, F.col("_run"), F.col("_i")), 1)
    return placed.select(*df.columns, number.alias(name))


def smallest_per_group(df: DataFrame, group: list[str], seed: int, key: list[str], **size) -> DataFrame:
    """L1/L2: keep the first rows of each group in hash order, see ``flag_smallest``."""
    return flag_smallest(df, group, seed, key, name="_chosen", **size).where("_chosen").drop("_chosen")


def stratified_split(
    df: DataFrame, label: str | None, fraction: float = 0.2, seed: int = 42, key: list[str] | None = None
) -> DataFrame:
    """L4: add ``is_val``; each label gives the same fraction of its rows to validation."""
    key = key or [c for c in df.columns if c != label]
    return flag_smallest(df, [label] if label else [], seed, key, fraction=fraction, name="is_val")


def seeded_shuffle(df: DataFrame, seed: int, key: list[str]) -> DataFrame:
    """L3: the whole table in a random but repeatable order."""
    return df.orderBy(hash60(seed, *_order_text(key)), *key)
