"""Ordered user sequences and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequora.functions import arrays as A
from sequora.functions.text import hash60


def collect(df: DataFrame, user: str, order: list[str], fields: list[str]) -> DataFrame:
    """One row for each user with parallel arrays of `fields` in `order` (ties by the fields themselves)."""
    packed = F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    rows = df.groupBy(user).agg(packed.alias("_events"))
    return rows.select(user, *(F.col(f"_events.{f}").alias(f) for f in fields))


def tail(df: DataFrame, user: str, order: list[Column | str], n: int) -> DataFrame:
    """Each user's last n rows, cut before any collect, so a heavy user's rows never meet in one array."""
    back = Window.partitionBy(user).orderBy(*(F.desc(o) if isinstance(o, str) else o for o in order))
    return df.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= n).drop("_n")


def next_labels(df: DataFrame, user: str, order: list[str], columns: dict[str, str]) -> DataFrame:
    """Rows with the next row's columns under new names; each user's last row goes."""
    w = Window.partitionBy(user).orderBy(*order)
    marked = df.withColumns({new: F.lead(old).over(w) for old, new in columns.items()} | {"_more": F.lead(F.lit(1)).over(w)})
    return marked.where("_more = 1").drop("_more")


def next_positive(df: DataFrame, user: str, order: list[str], item: str, positive: Column, name: str = "label") -> DataFrame:
    """Rows with the next later positive item, 0 without one."""
    w = Window.partitionBy(user).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(name, F.coalesce(F.first(F.when(positive, F.col(item)), ignorenulls=True).over(w), F.lit(0)))


def positive_later(df: DataFrame, user: str, order: list[str], item: str, positive: Column, name: str = "again") -> DataFrame:
    """Rows with whether the same item comes again later as a positive."""
    w = Window.partitionBy(user, item).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(name, F.coalesce(F.max(F.when(positive, 1)).over(w), F.lit(0)) == 1)


def next_event_example(ids: Column, n: int) -> tuple[Column, Column, Column]:
    """Input, label and length of next-event prediction: all but the last, all but the first, cut to the last n and padded."""
    size = F.least(F.greatest(F.size(ids) - 1, F.lit(0)), F.lit(n))
    return A.pad_truncate(A.all_but_last(ids), n), A.pad_truncate(A.from_second(ids), n), size


def cut_to_last_positive(df: DataFrame, types: str, wanted: list[str], arrays: list[str]) -> DataFrame:
    """All arrays cut after the last positive."""
    cut = A.last_place(F.col(types), wanted)
    return df.withColumn("_cut", cut).withColumns({a: F.slice(a, F.lit(1), F.col("_cut")) for a in arrays}).drop("_cut")


def chronological(c: Column, n: int, forward: bool = True) -> Column:
    """In time order the last n; else newest first, of which the first n."""
    return A.last_n(c, n) if forward else F.slice(F.reverse(c), 1, n)


def keep_last_nonzero(df: DataFrame, user: str, order: list[str], weight: str) -> DataFrame:
    """Weights with all but each user's last non-zero one set to 0."""
    w = Window.partitionBy(user).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    later = F.coalesce(F.max(F.when(F.col(weight) != 0, 1)).over(w), F.lit(0))
    return df.withColumn(weight, F.when(later == 1, F.lit(0.0)).otherwise(F.col(weight)))


def gap_bucket(seconds: Column, most: int = 128) -> Column:
    """Logarithmic bucket of a time gap."""
    raw = F.floor(F.log(F.greatest(F.abs(seconds), F.lit(1)).cast("double")) / 0.301)
    return F.least(F.greatest(raw, F.lit(0)), F.lit(most)).cast("long")


def sample_history(df: DataFrame, user: str, order: list[str], rate: float, window: int, seed: int) -> DataFrame:
    """Each user's last row, and of the `window` rows before it a share of `rate` (at least one), chosen by hash and left in order."""
    if not 0.0 < rate <= 1.0:
        raise ValueError("the rate is in (0, 1]")
    back = Window.partitionBy(user).orderBy(*(F.desc(o) for o in order))
    rows = df.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= window + 1)
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(user)) - 1).withColumn("_h", hash60(seed, user_col := F.col(user), *(F.col(o) for o in order)))
    chosen = Window.partitionBy(user_col, F.col("_back") == 1).orderBy("_h", *order)
    keep = (F.col("_back") == 1) | (F.row_number().over(chosen) <= F.greatest(F.ceil(F.col("_n") * F.lit(rate)), F.lit(1)))
    return rows.withColumn("_keep", keep).where("_keep").drop("_back", "_n", "_h", "_keep")
