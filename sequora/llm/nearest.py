"""Largest inner products by collision-counting hashing.

Inner products become distances on a sphere: a vector gets one more component
that brings it to the greatest length in its block, a query is scaled to length
one.  Rows are dealt to blocks by ranges of length, so that a few long rows do
not make all others look equally far.  Each hash function is one random projection, kept as a sorted array of a block's
rows.  For a query, a window centred at its own projection is laid on every
array; a row in enough of the windows is a candidate and is verified by its
inner product in double precision.  Virtual rehashing widens the windows, level
by level, until the query's k-th best distance is within the level's radius;
should the last level not reach it, every row is verified.

Blocks of rows, of bounded size, meet chunks of queries; a block's sorted arrays
are made once in a task, and the chunk's queries stream through them.  Each
block gives its k best, which are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sequora.llm.runtime import fresh, grouped, lean, materialise, numbered, place, ship
from sequora.llm.vectors import common_length, packed, unpacked

HASHES = 96
COLLISIONS = 0.66
LEVELS = (1.15, 1.3, 1.45, 1.7, 2.2)
CERTAIN = 1.1  # the k-th best distance is so far inside the level's radius when windows stop growing
RANGES = 64  # of length, at most; their bounds are taken from at most SAMPLE rows
SAMPLE = 20_000
PARTS = 255  # a rank is kept as one of so many equal parts of its array


class SortedProjections:
    """A block of rows: each projection's sorted values, and each row's rank in them."""

    def __init__(self, x: np.ndarray, longest: float, seed: int = 11, hashes: int = HASHES):
        rng = np.random.default_rng(seed)
        self.x, self.n = x, len(x)
        self.longest = longest
        size = (x**2).sum(1)
        raised = np.concatenate([x, np.sqrt(np.maximum(longest**2 - size, 0))[:, None]], 1) / longest
        self.directions = rng.standard_normal((x.shape[1] + 1, hashes))
        h = raised @ self.directions
        order = np.argsort(h, 0, kind="stable")
        self.values = np.ascontiguousarray(np.take_along_axis(h, order, 0).T)
        place = np.empty((hashes, self.n), np.int64)
        np.put_along_axis(place, order.T, np.broadcast_to(np.arange(self.n), place.shape), 1)
        self.ranks = (place * PARTS // self.n).astype(np.uint8)
        self.shift, self.met = np.empty_like(self.ranks), np.empty(self.ranks.shape, bool)

    def windows(self, centres: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """For each query: first part and number of parts of each sorted array within `radius` of its centre, to the nearest part."""
        lo, hi = (np.stack([np.searchsorted(v, c + r, side) for v, c in zip(self.values, centres.T, strict=True)], 1) for r, side in ((-radius, "left"), (radius, "right")))
        lo, hi = (np.rint(x * (PARTS / self.n)).astype(np.int64) for x in (lo, hi))
        return lo.astype(np.uint8), (hi - lo).astype(np.uint8)

    def nearest(self, queries: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, collisions: float = COLLISIONS) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query: rows and inner products of the k best verified rows other than its own id."""
        lengths = np.sqrt((queries**2).sum(1))
        centres = (queries / lengths[:, None]) @ self.directions[:-1]
        enough = collisions * len(self.ranks)
        least = np.minimum(k, self.n - np.isin(own, ids))
        rows = [np.zeros(0, np.int64)] * len(queries)
        scores = [np.zeros(0)] * len(queries)
        active = np.arange(len(queries))
        for radius in LEVELS:
            lo, n = self.windows(centres[active], radius)
            still = []
            for i, a, m in zip(active.tolist(), lo, n, strict=True):
                np.subtract(self.ranks, a[:, None], out=self.shift)
                np.less(self.shift, m[:, None], out=self.met)
                new = np.add.reduce(self.met.view(np.uint8), 0) >= enough
                new[rows[i]] = False
                new = np.flatnonzero(new)
                new = new[ids[new] != own[i]]
                rows[i], scores[i] = np.append(rows[i], new), np.append(scores[i], self.x[new] @ queries[i])
                if len(rows[i]) >= max(least[i], 1):
                    kth = np.partition(scores[i], len(scores[i]) - k)[len(scores[i]) - k] if len(scores[i]) >= k else -np.inf
                    if 2 - 2 * kth / (lengths[i] * self.longest) <= (radius / CERTAIN) ** 2:
                        continue
                still.append(i)
            active = np.array(still, np.int64)
            if not len(active):
                break
        for i in active.tolist():
            rows[i] = np.flatnonzero(ids != own[i])
            scores[i] = self.x[rows[i]] @ queries[i]
        out = []
        for i, q in enumerate(queries):
            r, s = rows[i], scores[i]
            if len(r) > k:
                kth = np.partition(s, len(s) - k)[len(s) - k]
                r = r[s >= kth - 1e-9 * max(1.0, abs(kth))]
            s = (self.x[r] * q).sum(1)  # one order of summation, so equal vectors have equal scores
            best = np.lexsort((ids[r], -s))[:k]
            out.append((r[best], s[best]))
        return out


def _sized(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("size", pa.array(np.linalg.norm(unpacked(batch.column("e"), length), axis=1)))


@lean
def _search(batches: Iterator[pa.RecordBatch], length: int, k: int, step: int = 1024) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, chunk), a block's rows before its queries: its index is made once, queries stream through it."""
    key, index, found, rows = None, None, None, []
    for batch in batches:
        for part in grouped(iter([batch]), ["block", "chunk", "asks"]):
            part = part.combine_chunks()
            here = part["block"][0].as_py(), part["chunk"][0].as_py()
            if here != key:
                key, index, rows = here, None, []
            x, ids = unpacked(part["e"], length), part["vec_id"].to_numpy()
            if not part["asks"][0].as_py():
                rows.append((x, ids))
                continue
            if not rows:
                continue
            if index is None:
                x_, found = (np.concatenate(v) for v in zip(*rows, strict=True))
                order = np.argsort(found, kind="stable")
                found = found[order]
                index = SortedProjections(x_[order], float(np.linalg.norm(x_, axis=1).max()))
            for i in range(0, len(ids), step):
                out = index.nearest(x[i : i + step], found, ids[i : i + step], k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i : i + step], [len(r) for r, _ in out])), pa.array(np.concatenate([found[r] for r, _ in out])), pa.array(np.concatenate([v for _, v in out]))], ["query_id", "vec_id", "score"])


def search(df: DataFrame, spark: SparkSession, queries: Column, k: int = 20, block_rows: int = 8192, chunk_rows: int = 16_384) -> DataFrame:
    """For each row of df (vec_id, embedding, any others) where `queries` holds: query_id, rank, vec_id, score of its k nearest.

    Candidates are all rows but those with the query's own id.  Vectors that are null, empty or zero, or hold null or
    non-finite components, those of another length than the commonest, and rows without id take no part; of rows that
    share an id, the first by bytes counts.  Ties go to the smaller id; with fewer than k candidates all are returned.
    """
    ship(spark)
    asked, id_, vector = fresh(df, "asked"), place(df, "vec_id"), place(df, "embedding")
    rows = df.withColumn(asked, F.coalesce(queries, F.lit(False)))
    rows = numbered(rows).select(F.col(id_).cast("long").alias("vec_id"), F.col(place(rows, asked)).alias("q"), F.col(vector).alias("e")).where("vec_id is not null")
    length = common_length(rows, "e")
    rows = packed(rows, length, "vec_id long, q boolean, e binary").groupBy("vec_id").agg(F.min("e").alias("e"), F.max("q").alias("q"))
    rows = rows.select("vec_id", "q", "e").mapInArrow(partial(_sized, length=length), "vec_id long, q boolean, e binary, size double")
    rows = materialise(rows, spark)
    facts = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("asked")).first()
    ranges, chunks = min(RANGES, max(1, -(-facts.n // block_rows * 5 // 4))), max(1, -(-facts.asked // chunk_rows))
    part = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    some = rows.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(SAMPLE).select("size").toArrow()["size"].to_numpy() if ranges > 1 else np.zeros(1)
    bounds = np.unique(np.quantile(some, np.arange(1, ranges) / ranges)).tolist()
    # a range, such as one of equal lengths, may hold more than a block: it is dealt by hash to as many as it needs
    rows = rows.withColumn("range", sum((F.lit(b) < F.col("size")).cast("int") for b in bounds) if bounds else F.lit(0))
    counts = {r["range"]: r["count"] for r in rows.groupBy("range").count().collect()}
    parts = [max(1, -(-counts.get(i, 0) // block_rows)) for i in range(len(bounds) + 1)]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("range") + 1)
    block = of(np.cumsum([0, *parts[:-1]]).tolist()) + part(of(parts), 1)
    blocks = sum(parts)
    data = rows.select(block.alias("block"), every(chunks).alias("chunk"), F.lit(False).alias("asks"), "vec_id", "e")
    asked = rows.where("q").select(every(blocks).alias("block"), part(F.lit(chunks), 2).alias("chunk"), F.lit(True).alias("asks"), "vec_id", "e")
    dealt = data.unionByName(asked).repartition(blocks * chunks, "block", "chunk").sortWithinPartitions("block", "chunk", "asks")
    found = dealt.mapInArrow(partial(_search, length=length, k=k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
