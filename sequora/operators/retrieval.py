"""Embedding lookup, inner-product top-k, candidate filters, label ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequora.functions.text import hash60


def lookup(df: DataFrame, table: DataFrame, on: list[str], missing: str = "null") -> DataFrame:
    """df with each id's embedding; `missing`: null keeps ids without one, drop drops them."""
    return df.join(table, on, "left" if missing == "null" else "inner")


def shard_of(item: Column, size: int) -> tuple[Column, Column]:
    """Shard number and row in it."""
    return F.floor(item / F.lit(size)).cast("long"), F.pmod(item, F.lit(size)).cast("long")


def shard_plan(items: DataFrame, item: str, size: int, least: int = 0) -> DataFrame:
    """Shards of an id range: first and last id and rows; shards with fewer than `least` rows go."""
    shard, _ = shard_of(F.col(item), size)
    return items.groupBy(shard.alias("shard")).agg(F.min(item).alias("first_id"), F.max(item).alias("last_id"), F.count("*").alias("n")).where(F.col("n") >= least)


def dense(table: DataFrame, shard: str, row: str, vector: str, width: int, rows: int) -> DataFrame:
    """Every row 0..rows-1 of each shard that occurs, zero vectors where there is none."""
    every = table.select(shard).distinct().withColumn(row, F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    return every.join(table, [shard, row], "left").withColumn(vector, F.coalesce(vector, F.array_repeat(F.lit(0.0).cast("float"), width)))


def latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, the new ones where both have a key."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    fields = [c for c in old.columns if c not in keys]
    top = both.groupBy(*keys).agg(F.max_by(F.struct(*fields), "_v").alias("_r"))
    return top.select(*keys, *(F.col(f"_r.{f}").alias(f) for f in fields))


Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]


def inner_products(asked: np.ndarray, items: np.ndarray) -> np.ndarray:
    return asked @ items.T


def mixture_of_products(asked: np.ndarray, items: np.ndarray, parts: int) -> np.ndarray:
    """Vectors are `parts` gate logits and then as many components; the score is the components' inner products, weighted by
    the softmax of the summed logits of both sides."""
    gates = asked[:, None, :parts] + items[None, :, :parts]
    gates = np.exp(gates - gates.max(2, keepdims=True))
    q, x = (v[:, parts:].reshape(len(v), parts, -1) for v in (asked, items))
    return (np.einsum("qpd,xpd->qxp", q, x) * gates).sum(2) / gates.sum(2)


class _Best:
    """The k best items of a chunk's queries so far; items come batch by batch, so a block of any size fits."""

    def __init__(self, k: int, scorer: Scorer) -> None:
        self.k, self.scorer = k, scorer
        self.ids: list[np.ndarray] = []
        self.vectors: list[np.ndarray] = []
        self.asked: np.ndarray | None = None

    def ask(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids.append(ids)
        self.vectors.append(vectors)

    def offer(self, ids: np.ndarray, items: np.ndarray) -> None:
        if self.asked is None:
            if not self.vectors:
                return
            self.asked = np.concatenate(self.vectors)
            self.q, self.item, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            self.least = np.full(len(self.asked), -np.inf)
        step = 1 << 16
        for i in range(0, len(self.asked), 256):
            part = self.asked[i : i + 256]
            s = self.scorer(part, items)
            q, c = np.nonzero(s >= self.least[i : i + 256, None] - 1e-9)
            if self.scorer is inner_products:  # one order of summation, so that equal vectors have equal scores
                score = np.concatenate([(part[q[j : j + step]] * items[c[j : j + step]]).sum(1) for j in range(0, len(q), step)]) if len(q) else np.zeros(0)
            else:
                score = s[q, c]
            self.q, self.item, self.score = np.concatenate([self.q, q + i]), np.concatenate([self.item, ids[c]]), np.concatenate([self.score, score])
        order = np.lexsort((self.item, -self.score, self.q))
        q = self.q[order]
        first = np.searchsorted(q, q, "left")
        order = order[np.arange(len(q)) - first < self.k]
        self.q, self.item, self.score = self.q[order], self.item[order], self.score[order]
        full = np.bincount(self.q, minlength=len(self.least)) == self.k
        lowest = np.full(len(self.least), np.inf)
        np.minimum.at(lowest, self.q, self.score)
        self.least = np.where(full, lowest, -np.inf)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.asked is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(self.ids)[self.q]), pa.array(self.item), pa.array(self.score)], ["query_id", "item_id", "score"])


def _block_topk(batches: Iterator[pa.RecordBatch], k: int, scorer: Scorer = inner_products) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, chunk), the queries of each before its items."""
    best, last = None, None
    for batch in batches:
        block, chunk, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "chunk", "asks"))
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(chunk) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
            if a == b:
                continue
            if (block[a], chunk[a]) != last:
                if best is not None:
                    yield from best.rows()
                best, last = _Best(k, scorer), (block[a], chunk[a])
            part = batch.slice(a, b - a)
            vectors = np.asarray(part.column("v").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b - a, -1)
            (best.ask if asks[a] else best.offer)(part.column("id").to_numpy(), vectors)
    if best is not None:
        yield from best.rows()


BLOCK_ITEMS, CHUNK_QUERIES = 1 << 17, 1 << 12


def mips_topk(queries: DataFrame, items: DataFrame, k: int, blocks: int | None = None, chunks: int | None = None, scorer: Scorer = inner_products) -> DataFrame:
    """(query_id, item_id, score, rank): the k items of largest inner product for each query, ties to the smaller id.

    queries (id, v) and items (id, v).  Items are dealt to blocks and queries to chunks by hash (as many as their counts ask
    for, if not given); each block and chunk meet in one task, which holds the chunk's queries and streams the block's items
    through matrix products, keeping k rows for each query.  Those are merged.  Nothing is broadcast; vectors travel as they are.
    """
    blocks = blocks or max(16, -(-items.count() // BLOCK_ITEMS))
    chunks = chunks or max(1, -(-queries.count() // CHUNK_QUERIES))
    place = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = items.select(place(1, blocks).alias("block"), each(chunks).alias("chunk"), F.lit(False).alias("asks"), F.col("id").cast("long").alias("id"), "v")
    dealt = dealt.unionByName(queries.select(each(blocks).alias("block"), place(2, chunks).alias("chunk"), F.lit(True).alias("asks"), F.col("id").cast("long").alias("id"), "v"))
    parts = dealt.repartition(blocks * chunks, "block", "chunk").sortWithinPartitions("block", "chunk", F.desc("asks")).mapInArrow(partial(_block_topk, k=k, scorer=scorer), "query_id long, item_id long, score double")
    return top(parts, k)


def mixture_topk(queries: DataFrame, items: DataFrame, k: int, parts: int, blocks: int | None = None, chunks: int | None = None) -> DataFrame:
    """As mips_topk by a mixture of products: v holds `parts` gate logits and then as many components of one length."""
    return mips_topk(queries, items, k, blocks, chunks, partial(mixture_of_products, parts=parts))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query_id with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sharded_topk(queries: DataFrame, items: DataFrame, shard: str, k: int) -> DataFrame:
    """Top k within each shard, then of all shards (every shard counts).  A shard's items are dealt to blocks, queries to chunks, as in mips_topk."""
    chunks = max(1, -(-queries.count() // CHUNK_QUERIES))
    sizes = items.groupBy(F.col(shard).cast("int").alias("s")).agg(F.ceil(F.count("*") / BLOCK_ITEMS).cast("int").alias("n"))
    salt = lambda i, n: F.pmod(F.xxhash64(F.lit(i), "id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = items.join(sizes, F.col(shard).cast("int") == F.col("s")).select("s", salt(1, F.col("n")).alias("block"), each(F.lit(chunks)).alias("chunk"), F.lit(False).alias("asks"), F.col("id").cast("long").alias("id"), "v")
    # queries meet every block of every shard: a row for each pair, as the sharded search asks for
    asked = queries.join(sizes).select("s", each(F.col("n")).alias("block"), salt(2, F.lit(chunks)).alias("chunk"), F.lit(True).alias("asks"), F.col("id").cast("long").alias("id"), "v")
    both = held.unionByName(asked).withColumn("block", F.col("s").cast("long") * (1 << 20) + F.col("block")).drop("s")
    parts = both.repartition("block", "chunk").sortWithinPartitions("block", "chunk", F.desc("asks")).mapInArrow(partial(_block_topk, k=k), "query_id long, item_id long, score double")
    return top(parts, k)


def exclude(scored: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates without each query's invalid items."""
    return scored.join(seen.select("query_id", "item_id").distinct(), ["query_id", "item_id"], "left_anti")


def topk_unseen(queries: DataFrame, items: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """As mips_topk without each query's seen items (query_id, item_id): k and as many more as a query has seen are fetched."""
    most = seen.distinct().groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    more = mips_topk(queries, items, k + most).select("query_id", "item_id", "score")
    return top(exclude(more, seen), k)


METHODS: dict[str, Callable[..., DataFrame]] = {"brute_force": mips_topk, "sharded": sharded_topk, "mixture": mixture_topk}


def topk(method: str, *args: object, **options: object) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown top-k method: {method}")
    return METHODS[method](*args, **options)


def label_rank(scored: DataFrame, query: str, score: str, is_label: Column, not_found: int | None = None) -> DataFrame:
    """One row for each query: 1 + the number of other candidates scoring above its label; without a label `not_found` or 0."""
    w = Window.partitionBy(query)
    label = F.max(F.when(is_label, F.col(score))).over(w)
    rows = scored.withColumn("_l", label).withColumn("_above", ~is_label & (F.col(score) > F.col("_l")))
    return rows.groupBy(query).agg(F.when(F.max(F.col("_l").isNotNull()), 1 + F.count_if("_above")).otherwise(not_found or 0).alias("target_rank"))


def last_by_id(df: DataFrame, item: str, order: str, value: str) -> DataFrame:
    """One value for each id: the one of its last occurrence."""
    return df.groupBy(item).agg(F.max_by(value, order).alias(value))


def mean_pool(tokens: DataFrame, key: str, vector: str, mask: Column) -> DataFrame:
    """Masked mean of token vectors by key and place: (key, pos, mean)."""
    flat = tokens.where(mask).select(key, F.posexplode(vector).alias("pos", "v"))
    return flat.groupBy(key, "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def shuffled_ids(items: DataFrame, item: str, seed: int) -> DataFrame:
    return items.withColumn("draw", hash60(seed, F.col(item)))


def _percent_g(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [None if v is None else " ".join("%.6g" % x for x in v) for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["id", "text"])


def as_text(table: DataFrame, item: str, vector: str) -> DataFrame:
    """(id, text): values with six significant digits, joined by spaces."""
    return table.select(F.col(item).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_percent_g, "id long, text string")
