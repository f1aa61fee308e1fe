"""Reproducible sampling, splits and negatives: every draw is a hash of seed and keys, so partitioning changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequora.functions.text import hash60, unit_hash


def eval_users(users: DataFrame, user: str, eligible: Column, n: int, seed: int) -> DataFrame:
    """users with `split`: the n eligible users of smallest hash are eval, the rest train."""
    h = hash60(seed, F.col(user))
    picked = users.where(eligible).select(F.col(user).alias("_u"), h.alias("_h")).orderBy("_h", "_u").limit(n).select("_u", F.lit("eval").alias("_s"))
    return users.join(picked, F.col(user) == F.col("_u"), "left").withColumn("split", F.coalesce("_s", F.lit("train"))).drop("_u", "_s")


def eval_users_by_chunk(users: DataFrame, user: str, chunk: Column, eligible: Column, quota: int, seed: int) -> DataFrame:
    """Chunks in order give their eligible users, in hash order within a chunk, until the quota is filled."""
    h = hash60(seed, F.col(user))
    rows = users.where(eligible).select(user, chunk.alias("chunk"), h.alias("_h"))
    sizes = rows.groupBy("chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("chunk").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("chunk").orderBy("_h", user))
    return rows.withColumn("_i", place).join(sizes, F.col("chunk") == F.col("_c")).where(F.col("_i") + F.col("_before") <= quota).select(user, "chunk")


def hash_split(df: DataFrame, key: str, share: float, seed: int, only: Column | None = None) -> DataFrame:
    """df with `split`: train where the key's hash falls below the share or `only` does not hold, else eval."""
    train = unit_hash(seed, F.col(key)) < share
    return df.withColumn("split", F.when(train if only is None else train | ~only, "train").otherwise("eval"))


def shuffled(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Rows in hash order of their keys."""
    return df.orderBy(hash60(seed, *(F.col(k) for k in keys)), *keys)


def positional(df: DataFrame, seed: int, keys: list[str], rate: float) -> DataFrame:
    return df.where(unit_hash(seed, *(F.col(k) for k in keys)) < rate)


def owned(df: DataFrame, place: str, workers: int, worker: int) -> DataFrame:
    return df.where(F.pmod(F.col(place), F.lit(workers)) == worker)


def offsets(parts: DataFrame, order: str, rows: str, width: int = 1 << 16) -> DataFrame:
    """parts, in the order of a whole-number column, with the number of rows in all parts before each.

    Parts are added up within buckets of consecutive numbers; only the buckets' sums meet in one place.
    """
    held = parts.withColumn("_b", F.floor(F.col(order) / width))
    sums = held.groupBy("_b").agg(F.sum(rows).alias("_n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before(Window.partitionBy(F.lit(0)).orderBy("_b"))), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum(rows).over(before(Window.partitionBy("_b").orderBy(order))), F.lit(0))
    return held.withColumn("_own", own).join(starts, F.col("_b") == F.col("_c")).withColumn("first_row", F.col("_own") + F.col("_before")).drop("_b", "_c", "_own", "_before")


def rows_at(asked: DataFrame, position: str, rows: DataFrame, parts: DataFrame, part: str, row: str) -> DataFrame:
    """The rows at asked positions over all parts: `parts` has each part's first_row, `rows` the number of each row in its part."""
    placed = rows.join(parts.select(F.col(part).alias("_p"), "first_row"), F.col(part) == F.col("_p")).withColumn("_at", F.col("first_row") + F.col(row)).drop("_p", "first_row")
    return asked.join(placed, F.col(position) == F.col("_at")).drop("_at")


def rotated_shard(epoch: Column, shards: int) -> Column:
    return F.pmod(epoch, F.lit(shards))


def indexed(pool: DataFrame, item: str, by: list[str] | None = None, width: int = 1 << 16) -> DataFrame:
    """Distinct whole-number items with `idx` (from 0, in order) and `n` for each value of `by`.

    Items are numbered within buckets of consecutive ids, and each bucket begins after those before it; only bucket sizes
    (ids / width rows) meet in one place, so a pool of any size is numbered in parallel.
    """
    by = by or []
    items = pool.select(*by, item).distinct().withColumn("_b", F.floor(F.col(item) / width))
    sizes = items.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    part = Window.partitionBy(*(by or [F.lit(0)]))
    before = F.coalesce(F.sum("_n").over(part.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*by, "_b", before.alias("_before"), F.sum("_n").over(part).alias("n"))
    own = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(item))
    return items.join(starts, [*by, "_b"]).withColumn("idx", own - 1 + F.col("_before")).select(*by, item, "idx", "n")


def uniform_negatives(positives: DataFrame, keys: list[str], pool: DataFrame, item: str, k: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """k draws with replacement for each positive from the pool (of its `by` values): rows (keys, j, negative).

    A draw is an index; the pool is joined by (by, index), so no cross product is made.  Positives without a pool give none.
    """
    by = by or []
    at = indexed(pool, item, by)
    sizes = at.groupBy(*by).agg(F.max("n").alias("n"))
    marked = positives.join(sizes, by) if by else positives.crossJoin(F.broadcast(sizes))  # without `by` one row: the pool's size
    rows = marked.select(*keys, *[b for b in by if b not in keys], "n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
    rows = rows.withColumn("idx", F.pmod(hash60(seed, *(F.col(x) for x in keys), F.col("j")), F.col("n"))).drop("n")
    return rows.join(at.select(*by, "idx", F.col(item).alias("negative")), [*by, "idx"]).select(*keys, "j", "negative")


def domain_negatives(domains: DataFrame, pool: DataFrame, item: str, k: int, seed: int) -> DataFrame:
    """k draws for each domain, shared by all its rows; a domain without pool gives none."""
    return uniform_negatives(domains.select("domain").distinct(), ["domain"], pool, item, k, seed, ["domain"])


def pooled_negatives(pools: dict[int, dict[int, float]], items: DataFrame, item: str, k: int, seed: int) -> DataFrame:
    """k draws for each domain, shared by its rows: each from a pool (another domain's items) by weight, then an item of it:
    rows (domain, j, pool, negative).  items has domain and `item`; a pool without items gives none."""
    spans = []
    for domain, weights in pools.items():
        low, total = 0.0, sum(weights.values())
        for pool, w in weights.items():
            spans.append((domain, pool, low, low + w / total))
            low += w / total
        spans[-1] = (*spans[-1][:3], 1.0)
    table = items.sparkSession.createDataFrame(spans, "domain int, pool int, low double, high double")
    draws = table.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("_u", unit_hash(seed, F.col("domain"), F.col("j"), F.lit("pool")))
    draws = draws.where((F.col("_u") >= F.col("low")) & (F.col("_u") < F.col("high"))).select("domain", "j", "pool")
    at = indexed(items.withColumnRenamed("domain", "_d"), item, ["_d"])
    sizes = at.groupBy(F.col("_d").alias("_s")).agg(F.max("n").alias("_n"))
    asked = draws.join(sizes, F.col("pool") == F.col("_s")).withColumn("_i", F.pmod(hash60(seed, F.col("domain"), F.col("j"), F.lit("item")), F.col("_n")))
    return asked.join(at, (F.col("pool") == F.col("_d")) & (F.col("_i") == F.col("idx"))).select("domain", "j", "pool", F.col(item).alias("negative"))


def in_batch_negatives(rows: DataFrame, batch: str, place: str, seq: str, item: str, k: int, seed: int, attempts: int = 4) -> DataFrame:
    """k draws for each row from its batch, of another sequence and item: rows (batch, place, j, negative).

    Draw j tries `attempts` hashed places (0-based, dense) and takes the first that fits; where none does, it takes the fitting
    row of its batch with the smallest hash.  Only rows without any fitting row in their batch give none.
    """
    sizes = rows.groupBy(batch).agg(F.count("*").alias("_n"))
    draws = rows.join(sizes, batch).select(batch, place, F.col(seq).alias("_s"), F.col(item).alias("_i"), "_n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
    asks = draws.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    asks = asks.withColumn("_p", F.pmod(hash60(seed, F.col(batch), F.col(place), F.col("j"), F.col("a")), F.col("_n")))
    others = rows.select(F.col(batch).alias("_b"), F.col(place).alias("_q"), F.col(seq).alias("_t"), F.col(item).alias("negative"))
    fits = (F.col("_s") != F.col("_t")) & (F.col("_i") != F.col("negative"))
    got = asks.join(others, (F.col(batch) == F.col("_b")) & (F.col("_p") == F.col("_q"))).where(fits)
    got = got.groupBy(batch, place, "j").agg(F.min_by("negative", "a").alias("negative"))
    rest = draws.join(got.select(batch, place, "j"), [batch, place, "j"], "left_anti")
    rest = rest.join(others, F.col(batch) == F.col("_b")).where(fits)
    order = F.struct(hash60(seed, F.col(batch), F.col(place), F.col("j"), F.lit("rest"), F.col("_q")), F.col("_q"))
    return got.unionByName(rest.groupBy(batch, place, "j").agg(F.min_by("negative", order).alias("negative")))


def hybrid(in_batch: DataFrame, rotating: DataFrame, keys: list[str], k: int, ratio: float) -> DataFrame:
    """The first int(k * ratio) in-batch draws of each row, and the remaining ones from the other sampler."""
    own = int(k * ratio)
    return in_batch.where(F.col("j") < own).select(*keys, "j", "negative").unionByName(rotating.where(F.col("j") < k - own).select(*keys, (F.col("j") + own).alias("j"), "negative"))
