"""Run monitoring over evaluation points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sequora.functions.metrics import composite


def best_so_far(points: DataFrame, run: str, order: str, value: str, mode: str = "max") -> DataFrame:
    """points with the best value up to each one, the place of it (the first of equal ones) and whether the point improved."""
    if mode not in ("max", "min"):
        raise ValueError(f"unknown mode: {mode}")
    v = F.col(value) if mode == "max" else -F.col(value)
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.max(v).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = points.withColumn("best", F.max(v).over(w)).withColumn("improved", before.isNull() | (v > before))
    rows = rows.withColumn("best_at", F.max(F.when(F.col("improved"), F.col(order))).over(w))
    return rows.withColumn("best", F.col("best") if mode == "max" else -F.col("best"))


#: Fixed values of the rules below: reject levels, keep level, and the batches from which they hold.
EARLY_LEVEL, EARLY_BATCH = 0.145, 12_000
LATE_LEVEL, LATE_BATCH = 0.1634, 20_000
KEEP_LEVEL, JUDGE_BATCH = 0.1744, 10_000


def early_stop(points: DataFrame, run: str, batch: str, value: str, most: int) -> DataFrame:
    """points with `best` so far and `reason` to stop (null: go on)."""
    w = Window.partitionBy(run).orderBy(batch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best, b = F.col("best"), F.col(batch)
    reason = (
        F.when(b >= most, "max_batches")
        .when((b < JUDGE_BATCH) | F.col(value).isNull(), None)
        .when((b >= EARLY_BATCH) & (best < EARLY_LEVEL), "early_reject")
        .when(best >= KEEP_LEVEL, None)
        .when((b >= LATE_BATCH) & (best < LATE_LEVEL), "reject")
    )
    return points.withColumn("best", F.coalesce(F.max(value).over(w), F.lit(0.0))).withColumn("reason", reason)


def scores(runs: DataFrame, overall: str, ads: str, least_overall: float = 0.58, least_ads: float = 0.2121) -> DataFrame:
    """runs with the composite score and whether both guardrails hold."""
    ok = (F.col(overall) >= least_overall) & (F.col(ads) >= least_ads)
    return runs.withColumn("score", composite(F.col(overall), F.col(ads))).withColumn("accepted", ok)
