"""Writers for every output form.  Spark's commit protocol makes each write atomic."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sequora.functions.text import hash60, numbers_to_csv
from sequora.operators.retrieval import as_text


def parquet(df: DataFrame, path: str, files: int | None = None, by: list[str] | None = None) -> None:
    """Overwrite; `files` coalesces, `by` partitions the folder."""
    out = (df.coalesce(files) if files else df).write.mode("overwrite")
    (out.partitionBy(*by) if by else out).parquet(path)


def parquet_files(df: DataFrame, path: str, rows: int) -> None:
    """Files of at most so many rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def one_row_tsv(df: DataFrame, path: str) -> None:
    df.limit(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def report(df: DataFrame, path: str) -> None:
    """A small report as one JSON-lines file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def embeddings_tsv(df: DataFrame, path: str, item: str, vector: str) -> None:
    """id TAB values with six significant digits."""
    as_text(df, item, vector).write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def sequences_csv(df: DataFrame, path: str, key: str, arrays: list[str], seed: int = 0) -> None:
    """Arrays as comma-joined text, rows in hash order."""
    out = df.withColumns({a: numbers_to_csv(F.col(a)) for a in arrays})
    out.orderBy(hash60(seed, F.col(key)), key).select(key, *arrays).write.mode("overwrite").option("header", True).csv(path)


def shards(df: DataFrame, path: str) -> None:
    """An embedding table by domain and shard; a rerun replaces only the shards it brings."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain_id", "shard").parquet(path)


def log_lines(df: DataFrame, column: str, path: str) -> None:
    """Lines of a text log as they are, a header line in each file."""
    df.select(F.col(column).alias("value")).write.option("header", True).option("sep", "\u0001").option("quote", "").option("escapeQuotes", False).csv(path)


def delimited(df: DataFrame, path: str, sep: str) -> None:
    """Columns as text with a separator of any length, without header or quotes."""
    df.select(F.concat_ws(sep, *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns)).alias("value")).write.text(path)


def single_file(spark: SparkSession, write: Callable[[str], None], path: str) -> None:
    """The one part file that `write` leaves in a folder, under a name of its own; the folder goes."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = f"{path}.{uuid.uuid4().hex}"
    write(folder)
    to, where = hadoop.Path(path), hadoop.Path(folder)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [p.getPath() for p in fs.globStatus(hadoop.Path(f"{folder}/part-*"))]
    if len(parts) != 1:
        raise ValueError(f"{len(parts)} part files instead of one")
    fs.mkdirs(to.getParent())
    if not fs.rename(parts[0], to):
        raise OSError(f"cannot rename to {path}")
    fs.delete(where, True)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write was committed: a partial one leaves no success marker."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def sorted_parquet(df: DataFrame, path: str, order: list[str]) -> None:
    """Globally sorted files: ranges of the order are dealt to files, each sorted."""
    df.orderBy(*order).write.mode("overwrite").parquet(path)


def row_ranges(df: DataFrame, path: str, order: str, files: int, width: int = 1 << 16) -> None:
    """`files` ranges of equally many rows in the order of a whole-number column, the remainder in the last, by folder `part`.

    Rows are numbered within buckets of consecutive values; only bucket sizes meet in one place.
    """
    rows = df.withColumn("_b", F.floor(F.col(order) / width))
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    one = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(one.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_b").alias("_c"), before.alias("_before"), F.sum("_n").over(one).alias("_all"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1
    numbered = rows.withColumn("_i", place).join(starts, F.col("_b") == F.col("_c"))
    each = F.greatest(F.floor(F.col("_all") / files), F.lit(1))
    part = F.least(F.floor((F.col("_i") + F.col("_before")) / each), F.lit(files - 1))
    numbered.select(*df.columns, part.cast("int").alias("part")).repartition(files, "part").sortWithinPartitions("part", order).write.mode("overwrite").partitionBy("part").parquet(path)


def _npy(batches: Iterator[pa.RecordBatch], folder: str, width: int, dtype: str, rows: int | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, row), with each shard's number of rows: one file for each shard, written as the rows come."""
    import io

    from pyarrow import fs as afs

    fs, base = afs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    out, now, at, size, temporary = None, None, 0, 0, ""
    kind = np.dtype(dtype)

    def zeros(n: int) -> None:
        step = max(1, (1 << 20) // max(1, width * kind.itemsize))
        while n > 0:
            out.write(bytes(min(n, step) * width * kind.itemsize))
            n -= step

    def close() -> Iterator[pa.RecordBatch]:
        if out is not None:
            zeros(size - at)
            out.close()
            fs.move(temporary, f"{base}/shard_{now}.npy")
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([size])], ["shard", "rows"])

    for batch in batches:
        shard, row, total = (batch.column(c).to_numpy() for c in ("shard", "row", "total"))
        values = np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(shard), width).astype(kind)
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
            if a == b:
                continue
            if now != int(shard[a]):
                yield from close()
                now, at, size = int(shard[a]), 0, rows or int(total[a])
                temporary = f"{base}/.{uuid.uuid4().hex}"
                out = fs.open_output_stream(temporary)
                head = io.BytesIO()
                np.lib.format.write_array_header_1_0(head, {"descr": np.lib.format.dtype_to_descr(kind), "fortran_order": False, "shape": (size, width)})
                out.write(head.getvalue())
            i = a
            while i < b:  # runs of consecutive rows; what lies between them is zero
                j = i + 1
                while j < b and row[j] == row[j - 1] + 1:
                    j += 1
                zeros(int(row[i]) - at)
                out.write(values[i:j].tobytes())
                at = int(row[j - 1]) + 1
                i = j
    yield from close()


def npy_shards(df: DataFrame, path: str, shard: str, row: str, vector: str, width: int, dtype: str = "float16", rows: int | None = None) -> None:
    """A dense .npy file (rows by width) for each shard, vectors at their row, zeros where there is none.

    A shard is written by one task as its sorted rows stream through, so it may be larger than memory; it gets its name when
    it is whole.  `rows`: of every shard; else up to its last row.  The path is one that pyarrow can open on the executors.

    The window is what brings a shard's rows to one task: adaptive execution may drop a repartition() beside a join on the same
    key and then read the join's side where it lies, but it keeps what an operator requires.
    """
    kept = df.select(F.col(shard).cast("long").alias("shard"), F.col(row).cast("long").alias("row"), F.col(vector).cast("array<double>").alias("v"))
    whole = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = kept.where("shard is not null").withColumn("total", F.max("row").over(whole) + 1).sortWithinPartitions("shard", "row")
    dealt.mapInArrow(partial(_npy, folder=path, width=width, dtype=dtype, rows=rows), "shard long, rows long").collect()  # a row for each file
