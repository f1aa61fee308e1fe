"""Readers for every input form; schemas are explicit where the form has one."""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequora.operators.clean import EVENT

RANK_RECORD = "user_id string, target_type string, target_rank int, top_k int"
#: One event of the text log: its time is text of minutes.
LOGGED = "array<struct<Type: string, Texts: array<string>, time: string>>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a readable Parquet dataset; errors other than its absence are raised."""
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def events_parquet(spark: SparkSession, path: str) -> DataFrame:
    """User rows with a JSON array of events; optional columns are typed nulls where absent."""
    from sequora.operators.clean import with_optional

    df = spark.read.parquet(path)
    return with_optional(with_optional(df, "DemandType", "string"), "L1RankingV3Score", "string").withColumn("events", F.from_json("EventsOnlyWithAd", EVENT))


def log(spark: SparkSession, path: str) -> DataFrame:
    """A text log of `uid TAB json`: (uid, events, bad), a header line in each file dropped, split at the first tab only.

    Lines without a tab go; malformed JSON gives null events and bad = true, so that it can be counted.
    """
    lines = spark.read.option("header", True).option("sep", "\u0001").option("quote", "").option("enforceSchema", True).schema("value string").csv(path)
    parts = F.split("value", "\t", 2)
    rows = lines.where(F.contains("value", F.lit("\t"))).select(parts[0].alias("uid"), parts[1].alias("json"))
    parsed = rows.withColumn("events", F.from_json("json", LOGGED))
    return parsed.select("uid", "events", F.col("events").isNull().alias("bad"))


def chunks(spark: SparkSession, folder: str, pattern: str = "train_chunk_*.tsv") -> DataFrame:
    """log() over chunk files, with each row's chunk (the file's name)."""
    lines = spark.read.option("header", True).option("sep", "\u0001").option("quote", "").schema("value string").csv(f"{folder}/{pattern}")
    lines = lines.withColumn("chunk", F.col("_metadata.file_name"))
    parts = F.split("value", "\t", 2)
    parsed = lines.where(F.contains("value", F.lit("\t"))).select("chunk", parts[0].alias("uid"), F.from_json(parts[1], LOGGED).alias("events"))
    return parsed.withColumn("bad", F.col("events").isNull())


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "::", encoding: str = "iso-8859-1", header: bool = False) -> DataFrame:
    """Delimited text with named columns; separators may be longer than one character."""
    return spark.read.schema(schema).option("sep", sep).option("encoding", encoding).option("header", header).csv(path)


def renamed_csv(spark: SparkSession, path: str, schema: str, names: dict[str, str]) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path).withColumnsRenamed(names)


def rank_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RANK_RECORD).json(path)


def metadata(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.option("multiLine", multi_line).json(path)


def rows_between(df: DataFrame, column: str, first: int, end: int) -> DataFrame:
    """first <= column < end, pushed to the scan."""
    return df.where((F.col(column) >= first) & (F.col(column) < end))


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            got = np.load(io.BytesIO(content), allow_pickle=False)
            parts = {"": got} if isinstance(got, np.ndarray) else dict(got)
            for name, a in parts.items():
                a = np.atleast_2d(np.asarray(a, np.float64)) if np.ndim(a) != 1 else np.asarray(a, np.float64)[:, None]
                n = len(a)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([name] * n), pa.array(np.arange(n)), pa.array(list(a), pa.list_(pa.float64()))], ["path", "name", "row", "values"])


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """.npy and .npz files as (path, name, row, values); one task reads a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.np[yz]").load(path)
    return files.select("path", "content").mapInArrow(_arrays, "path string, name string, row long, values array<double>")


def _ranges(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs as afs

    for batch in batches:
        for r in batch.to_pylist():
            fs, name = afs.FileSystem.from_uri(r["path"])
            kind = np.dtype(r["kind"])
            with fs.open_input_file(name) as f:
                for first in range(r["first"], r["last"], step):
                    n = min(step, r["last"] - first)
                    raw = f.read_at(n * r["width"] * kind.itemsize, r["offset"] + first * r["width"] * kind.itemsize)
                    values = np.frombuffer(raw, kind).astype(np.float64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * r["width"]), pa.array(values))
                    yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * n), pa.array(np.arange(first, first + n)), lists], ["path", "row", "values"])


def npy_rows(spark: SparkSession, folder: str, rows: int = 1 << 16, step: int = 4096) -> DataFrame:
    """.npy files of two dimensions as (path, row, values), each read by ranges of `rows` rows, so files may be of any size.

    Only headers are read on the driver.  The folder is one that pyarrow can open on the driver and the executors.
    """
    from pyarrow import fs as afs

    fs, base = afs.FileSystem.from_uri(folder)
    files = []
    for info in fs.get_file_info(afs.FileSelector(base)):
        if info.path.endswith(".npy"):
            with fs.open_input_file(info.path) as f:
                version = np.lib.format.read_magic(f)
                shape, fortran, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
                if len(shape) != 2 or fortran:
                    raise ValueError(f"{info.path}: not a two-dimensional array in row order")
                files.append((f"{folder.rstrip('/')}/{info.base_name}", int(shape[0]), int(shape[1]), kind.str, f.tell()))
    listed = spark.createDataFrame(files, "path string, n long, width int, kind string, offset long")
    parts = listed.where("n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(rows).cast("long"))).alias("first"))
    parts = parts.withColumn("last", F.least(F.col("first") + rows, "n")).repartition("path", "first")
    return parts.mapInArrow(partial(_ranges, step=step), "path string, row long, values array<double>")


def synthetic_sequences(spark: SparkSession, users: int, shortest: int = 10, longest: int = 200, domains: int = 4, items: int = 1000, seed: int = 0) -> DataFrame:
    """Fixture sequences: (user_id, encoded_ids, timestamps_unix), the last event in domain 0."""
    from sequora.functions.text import hash60
    from sequora.operators.vocab import OFFSET

    u = spark.range(users).withColumnRenamed("id", "user_id")
    u = u.withColumn("n", (hash60(seed, F.col("user_id"), "n") % (longest - shortest + 1) + shortest).cast("int"))
    draw = lambda i, what: hash60(seed, F.col("user_id"), i, F.lit(what))
    ids = F.transform(F.sequence(F.lit(1), "n"), lambda i: F.when(i == F.col("n"), F.lit(0)).otherwise(draw(i, "d") % domains) * OFFSET + draw(i, "i") % items + 20)
    times = F.transform(F.sequence(F.lit(1), "n"), lambda i: (i.cast("long") * 60 + F.lit(1_700_000_000)))
    return u.select("user_id", ids.alias("encoded_ids"), times.alias("timestamps_unix"))


def synthetic_embeddings(spark: SparkSession, items: int, width: int, domains: int = 4, seed: int = 42) -> DataFrame:
    """Fixture embeddings: (domain_id, item_id, embedding), rows of length 1."""
    from sequora.functions.arrays import l2_normalize
    from sequora.functions.text import hash60

    d = spark.range(items * domains).select(F.floor(F.col("id") / items).cast("int").alias("domain_id"), (F.col("id") % items).alias("item_id"))
    values = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: hash60(seed, F.col("domain_id"), F.col("item_id"), j) / float(1 << 60) * 2 - 1)
    return d.select("domain_id", "item_id", l2_normalize(values).alias("embedding"))
