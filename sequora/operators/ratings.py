"""Rating tables to sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequora.operators.vocab import numbered


def with_users(ratings: DataFrame, users: DataFrame, on: str) -> DataFrame:
    return ratings.join(users, on, "left")


def kcore(df: DataFrame, user: str, item: str, least: int) -> DataFrame:
    """Rows whose user and item both occur at least so often, both counted before any row goes (one pass, not iterated)."""
    often = lambda c, name: df.groupBy(F.col(c).alias(name)).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(name)
    # counts are combined before the shuffle; what is left of them filters the rows
    kept = df.join(often(user, "_u"), F.col(user).eqNullSafe(F.col("_u")), "left_semi")
    return kept.join(often(item, "_i"), F.col(item).eqNullSafe(F.col("_i")), "left_semi")


def codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the 0-based rank of each distinct value.  The distinct values are numbered once and joined back."""
    values = df.select(F.col(column).alias("_v")).distinct()
    ranked = numbered(values, [], ["_v"], name)
    return df.join(ranked, F.col(column) == F.col("_v"), "left").drop("_v")


def split_by_share(df: DataFrame, user: str, share: float) -> DataFrame:
    """`split`: train for ids up to share * the number of users (literally the id's value, as for dense ids from 1), else test."""
    n = df.agg(F.count_distinct(user).alias("_n"))  # one row
    return df.crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col(user) <= F.col("_n") * share, "train").otherwise("test")).drop("_n")


def length_stats(df: DataFrame, length: Column) -> DataFrame:
    return df.agg(F.count("*").alias("n_users"), F.min(length).alias("min_len"), F.max(length).alias("max_len"), F.avg(length).alias("mean_len"), F.median(length).alias("median_len"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))
