"""Decision offset, contamination calibration and alert thresholds from scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

# Contamination candidates, and the constants of the red threshold.
CANDIDATES = [0.005, 0.01, 0.02, 0.05]
BENIGN_QUANTILE = 0.01
RED_MARGIN = 0.001
RED_CAP = -0.02
UNLABELLED_MARGIN = 0.05
RED_FALLBACK = -0.1


def decision_offsets(
    scored: DataFrame, contaminations: list[float], score: str = "raw_score", rows: int | None = None
) -> dict[float, float]:
    """M5: for each contamination the score quantile that serves as offset; score - offset < 0 is an anomaly."""
    found = exact_quantiles(scored, {score: list(contaminations)}, rows)[score]
    return dict(zip(contaminations, found))


def _ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(F.lit(1).cast("bigint"), whole)


def f1_table(scored: DataFrame, offsets: dict[float, float], label: str = "label", score: str = "raw_score") -> DataFrame:
    """A10/M6: confusion counts, precision, recall and F1 per contamination, in one pass over the scores."""
    truth = F.col(label) == 1
    clean = F.col(label) == 0
    rows = []
    for contamination, offset in offsets.items():
        hit = F.col(score) - F.lit(offset) < 0
        counts = {"tp": hit & truth, "fp": hit & clean, "fn": ~hit & truth}
        named = [F.count_if(test).alias(n) for n, test in counts.items()]
        rows.append(F.struct(F.lit(contamination).alias("contamination"), *named))
    counted = scored.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    tp, fp, fn = (F.col(n) for n in ("tp", "fp", "fn"))
    rates = counted.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn)})
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both == 0, F.lit(0.0)).otherwise(F.try_divide(F.lit(2.0) * F.col("precision") * F.col("recall"), both))
    return rates.withColumn("f1", f1)


def best_contamination(table: DataFrame) -> float:
    """M6: the candidate with the greatest F1; the first of equals, in candidate order."""
    rows = {r.contamination: r.f1 for r in table.collect()}
    return max(rows, key=rows.get)


def calibration_table(scored: DataFrame, candidates: list[float] | None = None, rows: int | None = None) -> DataFrame:
    """M6: offset and F1 of each candidate, and which one is ``chosen``; ``scored`` has raw_score, label and is_val.

    Offsets come from the fitted rows (``rows`` of them), F1 from the held-out ones.
    """
    offsets = decision_offsets(scored.where(~F.col("is_val")), candidates or CANDIDATES, rows=rows)
    table = f1_table(scored.where("is_val"), offsets)
    known = scored.sparkSession.createDataFrame(
        [(i, c, o) for i, (c, o) in enumerate(offsets.items())], "place int, contamination double, offset double")
    judged = known.join(table, "contamination")
    best = judged.agg(F.min_by("place", F.struct(-F.col("f1"), "place"))).scalar()
    return judged.withColumn("chosen", F.col("place") == best)


def red_threshold(decisions: DataFrame, label: str | None = None, score: str = "score", rows: int | None = None) -> float:
    """Just below the 1st percentile of benign scores, at most -0.02; without labels below the least score."""
    if label is not None:
        benign = exact_quantiles(decisions.where(F.col(label) == 0), {score: [BENIGN_QUANTILE]}, rows)[score][0]
        if benign is not None:
            return min(benign - RED_MARGIN, RED_CAP)
    least = decisions.agg(F.min(score)).first()[0]
    return RED_FALLBACK if least is None else least - UNLABELLED_MARGIN
