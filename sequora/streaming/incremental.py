"""Structured Streaming forms: windowed counts with late data, and each user's latest events kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_counts(stream: DataFrame, time: str, kind: str, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and users of each type and window; events later than the watermark are left out."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    out = stream.withWatermark(time, late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n", "users")


def latest_sequences(stream: DataFrame, n: int) -> DataFrame:
    """Each user's last n events by (t, event_id), sent again whenever the user has new ones: (user_id, n, ids, times).

    stream has user_id, t, event_id, id.  An event that comes late is put in its place.
    """

    def update(key: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for rows in batches:
            held += list(zip(rows["t"].tolist(), rows["event_id"].tolist(), rows["id"].tolist(), strict=True))
        held = sorted(set(held))[-n:]
        state.update(tuple(map(list, zip(*held, strict=True))))
        yield pd.DataFrame({"user_id": [key[0]], "n": [len(held)], "ids": [",".join(str(x[2]) for x in held)], "times": [",".join(str(x[0]) for x in held)]})

    return stream.groupBy("user_id").applyInPandasWithState(update, "user_id long, n int, ids string, times string", "t array<long>, event_id array<long>, id array<long>", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, path: str, state: str, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there and give its last result: of complete output the last batch, of updates each key's last row."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    out = spark.read.parquet(path)
    fields = [c for c in out.columns if c != "batch"]
    if mode == "complete":
        return out.join(F.broadcast(out.agg(F.max("batch").alias("_last"))), F.col("batch") == F.col("_last")).select(*fields)  # one row
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("_r"))
    return last.select(*(F.col(f"_r.{c}").alias(c) for c in fields))
