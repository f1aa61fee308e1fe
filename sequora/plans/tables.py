"""The tables as the queries see them, in DataFrame and in SQL form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sequora.operators.taxonomy import STREAM
from sequora.operators.vocab import OFFSET


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with k (from props), t (unix seconds), type_id, grp, domain, id (encoded), text, positive."""
    e = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    e = e.withColumns({"k": F.get_json_object("props", "$.k").cast("long"), "t": seconds(F.col("ts")), "type_id": STREAM.type_id(kind), "grp": STREAM.group(kind), "domain": STREAM.domain(kind)})
    return e.withColumns({"id": F.col("domain").cast("long") * OFFSET + F.col("k") + 20, "text": F.concat_ws(" ", kind, F.col("k").cast("string")), "positive": STREAM.positive(kind)})


def seconds(ts: Column) -> Column:
    """Unix seconds of a time without zone, whatever the session's zone."""
    return F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def rank_of(event_id: Column) -> Column:
    """Ranks for reports: 0 (not found) to 300."""
    return F.when(event_id % 10 == 0, 0).otherwise((event_id * 7919) % 300 + 1)


def case(key: str, field: str, default: str) -> str:
    """The taxonomy's map as a CASE expression."""
    lit = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN '{t.name}' THEN {lit(getattr(t, field))}" for t in STREAM.types) + f" ELSE {default} END"


EV = f"""ev AS (SELECT *, domain * 1000000000 + k + 20 AS id, event_type || ' ' || k AS text, event_type = 'click' AS positive FROM (
  SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT AS k, floor(epoch(ts))::BIGINT AS t,
  {case("event_type", "type_id", "0")} AS type_id, {case("event_type", "group", "'Others'")} AS grp, ({case("event_type", "domain", "-1")})::BIGINT AS domain FROM events))"""
RANK = "CASE WHEN event_id % 10 = 0 THEN 0 ELSE (event_id * 7919) % 300 + 1 END"


def h60(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15))::BIGINT"
