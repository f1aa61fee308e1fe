"""Raw logs to flat, clean events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sequora.functions.text import MISSING_TITLE, MISSING_URL

EVENT = T.ArrayType(T.StructType([T.StructField("time", T.TimestampType()), T.StructField("Type", T.StringType()), T.StructField("Market", T.StringType()), T.StructField("CommercialIntentScore", T.StringType()), T.StructField("Texts", T.ArrayType(T.StringType()))]))
TIME_FLOOR = "2010-01-01 00:00:00"


def with_optional(df: DataFrame, name: str, kind: str) -> DataFrame:
    """df with a typed null column where it has none of that name."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def explode_events(raw: DataFrame, json: str = "EventsOnlyWithAd", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each event of a JSON array column; rows with null, empty or malformed arrays give none."""
    events = raw.withColumn("event", F.explode(F.from_json(json, EVENT)))
    texts = F.col("event.Texts")
    return events.select(*keep, F.col("event.time").alias("time"), F.col("event.Type").alias("type"), F.col("event.Market").alias("market"), F.col("event.CommercialIntentScore").alias("commercial_intent_score"), F.get(texts, F.lit(0)).alias("title"), F.get(texts, F.lit(1)).alias("url"))


def fill_missing(df: DataFrame) -> DataFrame:
    return df.withColumns({"title": F.coalesce("title", F.lit(MISSING_TITLE)), "url": F.coalesce("url", F.lit(MISSING_URL))})


def after(df: DataFrame, column: str = "time", floor: str = TIME_FLOOR) -> DataFrame:
    """Rows later than the floor; null times go."""
    return df.where(F.col(column) > F.lit(floor).cast(df.schema[column].dataType))


def dedup(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key: the first in `order`, so that the survivor does not depend on partitioning."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def min_length(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.where(F.size(column) >= n)


def with_any(df: DataFrame, types: str, wanted: list[str]) -> DataFrame:
    """Rows whose array has any of the wanted types (null elements do no harm)."""
    return df.where(F.exists(types, lambda t: F.coalesce(t.isin(*wanted), F.lit(False))))
