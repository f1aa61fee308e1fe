"""What the operators share on the cluster: code shipping, materialised tables, grouped streaming, components."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
#: Rows of one key that a join may send to one task, at least; keys with more are broadcast, at most so many.
HOT_ROWS, HOT_KEYS = 8192, 1000
#: The same for links of a graph, which are small.
HOT_LINKS = 1024
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so functions in it can be unpickled there.

    Arrow batches get a bound in bytes where the session has none (or a larger one), so a Python worker holds a few
    megabytes of texts at a time, or one longer text.  The number of rows in a batch stays as the session has it.
    """
    sc = spark.sparkContext
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def lean(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """f, after whose last batch a worker gives free memory back; workers live on from task to task."""

    @wraps(f)
    def run(*args: object, **options: object) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(*args, **options)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def _bytes(value: str) -> int:
    digits = value.strip().lower().rstrip("b")
    return int(digits.rstrip("kmgt")) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(digits[-1:], 0)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset, a fresh local one if driver and executors are one process (as in tests), else an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = _own_folder()
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


_OWN: list[str] = []


def _own_folder() -> str:
    if not _OWN:
        import shutil

        _OWN.append(tempfile.mkdtemp(prefix="sequora-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return f"file://{_OWN[0]}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Tables:
    """Tables that one operator writes to the shared folder on its way; those that its result doesn't read go when it is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = path, out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            path, _ = self.paths.pop(id(t), (None, None))
            if path:
                _delete(self.spark, path)


def materialise(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    return Tables(spark).write(df)


def drop_tables(spark: SparkSession) -> None:
    """Delete every table materialise() wrote in this application; results not yet written become unreadable."""
    _delete(spark, shared_folder(spark))


def fresh(df: DataFrame, name: str) -> str:
    """A column name starting with `name` that the table does not have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def place(df: DataFrame, name: str) -> str:
    """In numbered(df), the name of a column: the one spelled the same, or else the first that differs in case only."""
    found = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not found:
        raise ValueError(f"there is no column {name}")
    return f"c{found[0]}_"


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0_, c1_ and so on, whatever they were called (dots, other case, names that operators use)."""
    return df.toDF(*(f"c{i}_" for i in range(len(df.columns))))


def picked(df: DataFrame, **types: str) -> DataFrame:
    """The columns of these names, cast to these types."""
    return numbered(df).select(*(F.col(place(df, name)).cast(kind).alias(name) for name, kind in types.items()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys (integers) as one table each; the input is sorted by the keys within its partition."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is not None and last != tuple(c[0] for c in cols)
        begin = 0
        for i in np.flatnonzero(new).tolist():
            if i > begin:
                held.append(batch.slice(begin, i - begin))
            yield pa.Table.from_batches(held)
            held, begin = [], i
        held.append(batch.slice(begin))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def attach(rows: DataFrame, key: str, facts: DataFrame, at: str, n: str, most: int, total: int, least: int = HOT_ROWS) -> DataFrame:
    """rows joined (inner) to facts, one row for each value of `at`, on key = at; n in facts is the number of rows with that key,
    `most` the largest n and `total` their sum.

    Keys with more rows than `least`, and than a HOT_KEYS-th of all, are broadcast: there can be at most HOT_KEYS of them.
    So no task gets more rows of one key than that, and the rows of a hot key stay where they are.
    """
    bound = max(least, total // HOT_KEYS)
    if most <= bound:
        return rows.join(facts.drop(n), F.col(key) == F.col(at))
    hot = F.broadcast(facts.where(F.col(n) > bound).drop(n))
    cold = rows.join(hot.select(F.col(at).alias("hot_")), F.col(key) == F.col("hot_"), "left_anti")
    return rows.join(hot, F.col(key) == F.col(at)).unionByName(cold.join(facts.where(F.col(n) <= bound).drop(n), F.col(key) == F.col(at)))


def repeated(df: DataFrame, n: str, number: str, step: int = 4096) -> DataFrame:
    """Each row as often as its column n says, numbered from 0 in `number`; in two steps, so that no long array is made."""
    some = df.where(F.col(n) > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / step))).alias("step_"))
    some = some.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col(n) - F.col("step_") * step, F.lit(step)) - 1)).alias("at_"))
    return some.withColumn(number, F.col("step_") * step + F.col("at_")).drop("step_", "at_")


def connected_components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """Components of undirected links (a, b), 64-bit ids: one row (id, component) per id, component its smallest id.

    Alternating large-star and small-star steps; each is a minimum per id (combined before the shuffle) and a join that
    splits hot ids, so no neighbourhood is held in one place.  Rounds are written to the shared folder; past ones go.
    """
    a, b = F.col("a"), F.col("b")
    tables = Tables(spark)
    now = tables.write(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct())
    degrees = lambda df: df.groupBy("a").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()

    while True:
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        d = degrees(both)
        # large star: larger neighbours of u go to the smallest of u and its neighbours
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"), "n")
        large = attach(both, "a", low, "u", "n", d.most, d.total, HOT_LINKS).where("b > a").select(b.alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        if d.most > HOT_LINKS:
            large = tables.write(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumnRenamed("a", "u")
        most, total = (0, 0) if d.most <= HOT_LINKS else degrees(large)
        small = attach(large, "a", low, "u", "n", most, total, HOT_LINKS)
        small = small.select(b.alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a > b").distinct()
        past, now = now, tables.write(small)
        tables.drop(past, large)
        # done when every id has one parent that has none
        ends = now.select(F.inline(F.array(F.struct(a.alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(b.alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
        ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.agg(F.coalesce(F.max((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)), F.lit(False)).alias("more")).first()["more"]:
            return rooted(now)


def rooted(parents: DataFrame) -> DataFrame:
    """(id, component) of links (a, b) where every a has one b and no b is an a."""
    roots = parents.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return parents.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
