"""Weights by time distance to anchor events: range-frame windows, one shuffle and one sort for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequora.functions import arrays as A


def ahead(df: DataFrame, user: str, t: str, anchor: Column, valid: Column, scale: float, tau: float, lookahead: int, others_only: bool = True, name: str = "weight") -> DataFrame:
    """1 + scale * exp(-dt / tau) of the next later anchor within `lookahead` seconds."""
    w = Window.partitionBy(user).orderBy(t).rangeBetween(1, lookahead)
    near = F.exp(-(F.min(F.when(anchor, F.col(t))).over(w) - F.col(t)) / float(tau))
    applies = valid & ~anchor if others_only else valid
    return df.withColumn(name, 1.0 + F.when(applies, scale * F.coalesce(near, F.lit(0.0))).otherwise(0.0))


def around(df: DataFrame, user: str, t: str, anchor: Column, valid: Column, top: float = 4.0, sigma: float = 180.0, next_window: int = 600, prev_window: int = 600, next_side: float = 1.0, prev_side: float = 1.0, gate: Column | None = None, others_only: bool = True, name: str = "weight") -> DataFrame:
    """1 + (top - 1) * gate * the larger Gaussian of the next anchor (0..next_window seconds ahead) and the previous one."""
    w = Window.partitionBy(user).orderBy(t)
    when = F.when(anchor, F.col(t))
    after = F.min(when).over(w.rangeBetween(0, next_window)) - F.col(t)
    before = F.col(t) - F.max(when).over(w.rangeBetween(-prev_window, -1))
    bell = lambda dt, side: F.coalesce(side * F.exp(-0.5 * F.pow(dt / float(sigma), F.lit(2.0))), F.lit(0.0))
    best = F.greatest(bell(after, next_side), bell(before, prev_side))
    applies = valid & ~anchor if others_only else valid
    return df.withColumn(name, 1.0 + F.when(applies, (top - 1.0) * best * (F.lit(1.0) if gate is None else gate)).otherwise(0.0))


def around_similar(df: DataFrame, user: str, key: str, t: str, vector: str, anchor: Column, valid: Column, top: float = 4.0, sigma: float = 180.0, window: int = 600, low: float = 0.0, high: float = 1.0, power: float = 1.0, name: str = "weight") -> DataFrame:
    """As around(), each anchor's Gaussian times a similarity gate, and the largest product counts, not the nearest anchor.

    Anchors are laid on the time buckets that their window can reach, so the join is an equi-join on (user, bucket).
    """
    ev = df.withColumn("_bucket", F.floor(F.col(t) / window)).withColumn("_valid", valid & ~anchor)
    anchors = df.where(anchor).select(F.col(user).alias("_u"), F.col(t).alias("_t"), F.col(vector).alias("_v"))
    anchors = anchors.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_t") / window) - 1, F.floor(F.col("_t") / window) + 1)))
    pairs = ev.where("_valid").join(anchors, (F.col(user) == F.col("_u")) & (F.col("_bucket") == F.col("_b")) & (F.abs(F.col(t) - F.col("_t")) <= window))
    gate = F.pow(F.least(F.greatest((A.cosine(F.col(vector), F.col("_v")) - low) / max(high - low, 1e-6), F.lit(0.0)), F.lit(1.0)), F.lit(power))
    best = pairs.groupBy(F.col(key).alias("_k")).agg(F.max(F.exp(-0.5 * F.pow((F.col(t) - F.col("_t")) / float(sigma), F.lit(2.0))) * gate).alias("_best"))
    return ev.join(best, F.col(key) == F.col("_k"), "left").withColumn(name, 1.0 + (top - 1.0) * F.coalesce("_best", F.lit(0.0))).drop("_bucket", "_valid", "_k", "_best")


def diagnostics(df: DataFrame, weight: str, *by: str) -> DataFrame:
    """Mean and largest weight, and shares above several levels."""
    w = F.col(weight)
    share = lambda c: F.avg(c.cast("double"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(w).alias("mean_weight"), F.max(w).alias("max_weight"), share(w > 1).alias("frac_gt_1"), share(w >= 1.5).alias("frac_ge_1_5"), share(w >= 2).alias("frac_ge_2"), share(w >= 3).alias("frac_ge_3"), share(w >= 3.5).alias("frac_ge_3_5"))


def near_probability(df: DataFrame, item: str, kind: str, near: Column, alpha: float = 100.0, least: int = 20) -> DataFrame:
    """P(anchor near) for each item, smoothed towards its type's; items met less than `least` times have their type's.

    gate: the probability scaled from the background rate (0) to the 95th percentile over items (1).
    """
    near = near.cast("double")
    types = df.groupBy(F.col(kind).alias("_k")).agg(F.avg(near).alias("p_type"))
    items = df.groupBy(item, kind).agg(F.count("*").alias("n"), F.sum(near).alias("near"))
    p = F.when(F.col("n") >= least, (F.col("near") + alpha * F.col("p_type")) / (F.col("n") + alpha)).otherwise(F.col("p_type"))
    scored = items.join(types, F.col(kind) == F.col("_k")).select(item, kind, "n", "near", "p_type", p.alias("p"))
    bounds = df.agg(F.avg(near).alias("low")).crossJoin(scored.agg(F.expr("percentile(p, 0.95)").alias("high")))  # one row by one row
    gate = F.least(F.greatest((F.col("p") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))
    return scored.crossJoin(F.broadcast(bounds)).withColumn("gate", gate).drop("low", "high")
