"""Resumable stages: each is written once, and a finished stage is read instead of run again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sequora.operators import clean, sequences, vocab
from sequora.operators.taxonomy import Taxonomy
from sequora.sources.readers import exists
from sequora.sources.writers import parquet


@dataclass
class Pipeline:
    """Named stages in order; a stage gets the earlier stages' outputs by name.

    A stage counts as finished if its folder has Spark's success marker, which a partial write does not leave.
    """

    spark: SparkSession
    folder: str
    stages: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]] = field(default_factory=list)

    def add(self, name: str, f: Callable[[dict[str, DataFrame]], DataFrame]) -> Pipeline:
        if any(name == n for n, _ in self.stages):
            raise ValueError(f"there is a stage {name}")
        self.stages.append((name, f))
        return self

    def _finished(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return bool(p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)) and exists(self.spark, path)

    def run(self, force: bool = False) -> dict[str, DataFrame]:
        done: dict[str, DataFrame] = {}
        for name, f in self.stages:
            path = f"{self.folder}/{name}"
            if force or not self._finished(path):
                parquet(f(done), path)
            done[name] = self.spark.read.parquet(path)
        return done


def event_pipeline(spark: SparkSession, raw: DataFrame, folder: str, taxonomy: Taxonomy, user: str = "user_id", least: int = 5) -> Pipeline:
    """Raw JSON events to clean events, vocabulary, encoded events, sequences, split."""
    from pyspark.sql import functions as F

    from sequora.operators import sampling

    keys = [user, "time", "type", "title", "url"]

    def events(_: dict[str, DataFrame]) -> DataFrame:
        flat = clean.after(clean.fill_missing(clean.explode_events(raw, keep=(user,))))
        return clean.dedup(flat, keys, ["market", "commercial_intent_score"]).withColumn("domain_id", taxonomy.domain(F.col("type"))).where("domain_id >= 0")

    def words(done: dict[str, DataFrame]) -> DataFrame:
        return vocab.build_large(done["events"], ["title", "url"], "domain_id")

    def encoded(done: dict[str, DataFrame]) -> DataFrame:
        joined = vocab.attach(done["events"], done["vocab"], ["domain_id", "title", "url"], "inner")
        return joined.withColumn("encoded_id", vocab.encode(F.col("domain_id"), F.col("item_id"))).withColumn("time_unix", F.unix_timestamp("time"))

    def users(done: dict[str, DataFrame]) -> DataFrame:
        rows = sequences.collect(done["encoded"], user, ["time_unix", "title", "url"], ["encoded_id", "type", "time_unix", "title", "url"])
        return clean.min_length(rows, "encoded_id", least)

    def split(done: dict[str, DataFrame]) -> DataFrame:
        wanted = taxonomy.positives()
        marked = done["sequences"].withColumn("_p", F.exists("type", lambda t: F.coalesce(t.isin(*wanted), F.lit(False))))
        return sampling.hash_split(marked, user, 0.95, 42, F.col("_p")).drop("_p")

    return Pipeline(spark, folder).add("events", events).add("vocab", words).add("encoded", encoded).add("sequences", users).add("split", split)
