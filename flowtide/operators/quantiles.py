"""Exact quantiles (linear interpolation) of columns of any length.

Small columns use the built-in exact aggregate. For long ones a sketch brackets the wanted rank, one pass counts the
rows below and inside the bracket, and the bracket shrinks until few distinct values remain between its ends; repeated
values at the ends are counted, not collected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows up to which the built-in aggregate, which keeps all distinct values in one task, is used.
DIRECT_ROWS = 200_000
# Values of a bracket that may be read by the driver.
BRACKET_ROWS = 20_000
SKETCH_ACCURACY = 10_000


@dataclass
class _Rank:
    """One order statistic being searched: rank ``k`` of ``column``, known to lie in [low, high]."""

    column: str
    k: int
    low: float = -math.inf
    high: float = math.inf
    value: float | None = None
    counts: dict = field(default_factory=dict)


def exact_quantiles(
    df: DataFrame,
    wanted: dict[str, list[float]],
    rows: int | None = None,
    direct_rows: int = DIRECT_ROWS,
    bracket_rows: int = BRACKET_ROWS,
) -> dict[str, list[float | None]]:
    """Quantiles of each column, ignoring nulls and NaN; None for a column without values.

    ``rows`` is an upper bound of the row count if the caller knows one; it may save a counting pass.
    """
    columns = list(wanted)
    df = df.select(*[F.nullif(F.col(c).cast("double"), F.lit(math.nan)).alias(c) for c in columns])
    if rows is not None and rows <= direct_rows:
        return _direct(df, wanted)
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    if max(counts.values(), default=0) <= direct_rows:
        return _direct(df, wanted)
    ranks: dict[tuple[str, int], _Rank] = {}
    for c in columns:
        for p in wanted[c]:
            for k in _neighbours(p, counts[c]):
                ranks.setdefault((c, k), _Rank(c, k))
    _search(df, counts, list(ranks.values()), bracket_rows)
    return {c: [_interpolate(ranks, c, p, counts[c]) for p in wanted[c]] for c in columns}


def _direct(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    row = df.agg(*[F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, ps))).alias(c) for c, ps in wanted.items()])
    row = row.first()
    return {c: list(row[c]) if row[c] is not None else [None] * len(ps) for c, ps in wanted.items()}


def _neighbours(p: float, n: int) -> list[int]:
    if n == 0:
        return []
    at = p * (n - 1)
    return sorted({math.floor(at), math.ceil(at)})


def _interpolate(ranks, column: str, p: float, n: int) -> float | None:
    if n == 0:
        return None
    at = p * (n - 1)
    low, high = math.floor(at), math.ceil(at)
    a, b = ranks[column, low].value, ranks[column, high].value
    return a if low == high else a * (high - at) + b * (at - low)


def _inside(r: _Rank) -> Column:
    return (F.col(r.column) >= F.lit(r.low)) & (F.col(r.column) <= F.lit(r.high))


def _search(df: DataFrame, counts: dict[str, int], ranks: list[_Rank], bracket_rows: int) -> None:
    for r in ranks:
        r.counts = {"below": 0, "inside": counts[r.column], "at_low": 0, "at_high": 0}
    while open_ranks := [r for r in ranks if r.value is None]:
        wide = [r for r in open_ranks if _between(r) > bracket_rows]
        _read(df, [r for r in open_ranks if r not in wide])
        if not wide:
            continue
        before = [_between(r) for r in wide]
        _narrow(df, wide)
        # A sketch of the bracket has ends inside it, so fewer rows stay between; if ever not, one exact pass ends it.
        for r, n in zip(wide, before):
            if _between(r) >= n:
                at = (r.k - r.counts["below"]) / max(1, r.counts["inside"] - 1)
                r.value = df.where(_inside(r)).agg(F.percentile(r.column, at)).first()[0]


def _between(r: _Rank) -> int:
    """Rows strictly between the ends of the bracket."""
    c = r.counts
    return 0 if r.low == r.high else c["inside"] - c["at_low"] - c["at_high"]


def _read(df: DataFrame, ranks: list[_Rank]) -> None:
    """Fill in ranks whose brackets hold few values between their ends; one pass reads all those values."""
    inner = []
    for r in ranks:
        at = r.k - r.counts["below"]
        if at < r.counts["at_low"] or r.low == r.high:
            r.value = r.low
        elif at >= r.counts["inside"] - r.counts["at_high"]:
            r.value = r.high
        else:
            inner.append(r)
    if not inner:
        return
    brackets = sorted({(r.column, r.low, r.high) for r in inner})
    hits = []
    for i, (column, low, high) in enumerate(brackets):
        v = F.col(column).cast("double")
        hits.append(F.when((v > F.lit(low)) & (v < F.lit(high)), F.struct(F.lit(i).alias("i"), v.alias("v"))))
    found = df.select(F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("hit.i", "hit.v").toPandas()
    values = {i: np.sort(part["v"].to_numpy()) for i, part in found.groupby("i")}
    for r in inner:
        bracket = values[brackets.index((r.column, r.low, r.high))]
        r.value = float(bracket[r.k - r.counts["below"] - r.counts["at_low"]])


def _narrow(df: DataFrame, ranks: list[_Rank]) -> None:
    """One sketch pass over the brackets, one counting pass over the narrower ones; a bracket that misses is kept."""
    slack = 2.0 / SKETCH_ACCURACY
    sketches = []
    for i, r in enumerate(ranks):
        f = (r.k - r.counts["below"]) / max(1, r.counts["inside"] - 1)
        ends = F.array(F.lit(max(0.0, f - slack)), F.lit(min(1.0, f + slack)))
        value = F.when(_inside(r), F.col(r.column).cast("double"))
        sketches.append(F.percentile_approx(value, ends, SKETCH_ACCURACY).alias(f"s{i}"))
    found = df.agg(*sketches).first()

    tries = [_Rank(r.column, r.k, *found[f"s{i}"]) for i, r in enumerate(ranks)]
    sums = []
    for i, t in enumerate(tries):
        v = F.col(t.column)
        tests = {"below": v < t.low, "inside": _inside(t), "at_low": v == t.low, "at_high": v == t.high}
        sums += [F.count_if(test).alias(f"{name}{i}") for name, test in tests.items()]
    row = df.agg(*sums).first()
    for i, (r, t) in enumerate(zip(ranks, tries)):
        t.counts = {name: row[f"{name}{i}"] for name in ("below", "inside", "at_low", "at_high")}
        if t.counts["below"] <= t.k < t.counts["below"] + t.counts["inside"]:
            r.low, r.high, r.counts = t.low, t.high, t.counts
        elif t.k < t.counts["below"]:
            _keep_below(r, t)
        else:
            _keep_above(r, t)


def _keep_below(r: _Rank, t: _Rank) -> None:
    """The rank lies below the tried bracket: its lower end becomes the upper end."""
    inside = t.counts["below"] + t.counts["at_low"] - r.counts["below"]
    r.high = t.low
    r.counts = {**r.counts, "inside": inside, "at_high": t.counts["at_low"]}


def _keep_above(r: _Rank, t: _Rank) -> None:
    """The rank lies above the tried bracket: its upper end becomes the lower end."""
    below = t.counts["below"] + t.counts["inside"] - t.counts["at_high"]
    end = r.counts["below"] + r.counts["inside"]
    r.low = t.high
    r.counts = {**r.counts, "below": below, "inside": end - below, "at_low": t.counts["at_high"]}
