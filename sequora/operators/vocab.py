"""Vocabularies, encoded ids and the joins that apply them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OFFSET = 1_000_000_000
FIRST_ID = 20  # 0 is padding, 1 the mask, the rest reserved


def encode(domain: Column, item: Column, offset: int = OFFSET) -> Column:
    return domain.cast("long") * F.lit(offset) + item.cast("long")


def decode(encoded: Column, offset: int = OFFSET) -> tuple[Column, Column]:
    """Domain and item id."""
    return F.floor(encoded / F.lit(offset)).cast("long"), F.pmod(encoded, F.lit(offset)).cast("long")


def smallest_offset(top: Column) -> Column:
    """The smallest power of ten above an id."""
    return F.rpad(F.lit("1"), F.length(top.cast("string")) + 1, "0").cast("long")


def distinct_items(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()


def numbered(items: DataFrame, by: list[str], keys: list[str], name: str, start: int = 0, bucket: Column | None = None) -> DataFrame:
    """items with dense numbers from `start` in the order of keys, for each value of `by`.

    Items are numbered within buckets that follow the order (the first characters of a text, ranges of whole numbers, or as
    given), and each bucket begins after those before it: only bucket sizes meet in one place.
    """
    if bucket is None:
        kind = items.schema[keys[0]].dataType
        first = F.col(keys[0])
        bucket = F.substring(first, 1, 4) if kind.typeName() in ("string", "varchar", "char") else F.floor(first / (1 << 16)) if kind.typeName() in ("byte", "short", "integer", "long") else F.lit(0)
    held = items.withColumn("_b", bucket)
    sizes = held.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_b").eqNullSafe(F.col("_c"))
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    own = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*keys))
    return held.withColumn("_own", own).join(starts, same).select(*items.columns, (F.col("_own") + F.col("_before") + (start - 1)).cast("long").alias(name))


def build(df: DataFrame, keys: list[str], by: str | None = None, start: int = FIRST_ID, name: str = "item_id") -> DataFrame:
    """Dense ids from `start` for distinct keys in their order, for each value of `by`."""
    by_ = [by] if by else []
    return numbered(distinct_items(df, [*by_, *keys]), by_, keys, name, start)


def build_large(df: DataFrame, keys: list[str], by: str, start: int = FIRST_ID, name: str = "item_id", buckets: int = 1024) -> DataFrame:
    """As build(), in hash order, for domains too large for one task: rows are numbered within hash buckets, and each
    bucket's numbers begin after those of the buckets before it.  Only bucket sizes (by x buckets rows) meet in one place."""
    items = distinct_items(df, [by, *keys])
    items = items.withColumn("_h", F.xxhash64(*keys)).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    sizes = items.groupBy(by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(by).alias("_by"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    own = Window.partitionBy(by, "_b").orderBy("_h", *keys)
    numbered = items.withColumn("_i", F.row_number().over(own)).join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_bb")))
    return numbered.select(by, *keys, (F.col("_i") + F.col("_s") + start - 1).cast("long").alias(name))


def build_first_seen(df: DataFrame, by: str, text: str, order: list[str], start: int = 0, name: str = "item_id") -> DataFrame:
    """Dense ids in the order in which texts are first met."""
    first = df.groupBy(by, text).agg(F.min(F.struct(*order)).alias("_first")).select(by, text, *(F.col(f"_first.{o}").alias(f"_o{i}") for i, o in enumerate(order)))
    return numbered(first, [by], [f"_o{i}" for i in range(len(order))], name, start).drop(*(f"_o{i}" for i in range(len(order))))


def stats(vocab: DataFrame, name: str = "item_id") -> DataFrame:
    """Count, smallest and largest id in one pass."""
    return vocab.agg(F.count("*").alias("n"), F.min(name).alias("min_id"), F.max(name).alias("max_id"))


def summary(vocab: DataFrame, by: str, name: str = "item_id", reserved: int = FIRST_ID) -> DataFrame:
    return vocab.groupBy(by).agg(F.count("*").alias("n"), F.max(name).alias("max_id")).withColumn("shard_size", F.col("n") + reserved)


def attach(df: DataFrame, vocab: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """df with the vocabulary's id: one join for all domains.  Catalyst broadcasts the vocabulary if its size allows."""
    return df.join(vocab, on, how)


def category(df: DataFrame, item: str, table: DataFrame, place: str, category: str) -> DataFrame:
    """df with the category, counted from 1, of items counted from 1; item 0 (padding) has that of item 1."""
    at = F.greatest(F.col(item) - 1, F.lit(0))
    found = table.select(F.col(place).alias("_p"), (F.col(category) + 1).alias(category))
    return df.join(found, at == F.col("_p")).drop("_p")


def misses(df: DataFrame, vocab: DataFrame, on: list[str], name: str = "item_id") -> DataFrame:
    return attach(df, vocab, on).agg(F.count("*").alias("n_rows"), F.count_if(F.col(name).isNull()).alias("n_missing"))


def in_domain(encoded: Column, domain: int, offset: int = OFFSET, positive_only: bool = True) -> Column:
    """Whether an id is of a domain; 0 (padding) is of none unless `positive_only` is off."""
    if domain == 0:
        return (encoded < offset) & (encoded > 0) if positive_only else encoded < offset
    return (encoded >= domain * offset) & (encoded < (domain + 1) * offset)
