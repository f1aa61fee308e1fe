"""Array and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_n(c: Column, n: int) -> Column:
    """The last n elements; all of a shorter array."""
    return F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), F.lit(n))


def pad_truncate(c: Column, n: int, fill: int = 0) -> Column:
    """The last n elements, filled on the right to n."""
    return F.slice(F.concat(last_n(c, n), F.array_repeat(F.lit(fill).cast("bigint"), n)), 1, n)


def all_but_last(c: Column, n: int = 1) -> Column:
    return F.slice(c, F.lit(1), F.greatest(F.size(c) - n, F.lit(0)))


def from_second(c: Column) -> Column:
    return F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))


def conditional_labels(ids: Column, actions: Column) -> Column:
    """For each place the next id if its action is positive, else 0."""
    return F.transform(ids, lambda x, i: F.when(F.coalesce(F.get(actions, i + 1), F.lit(0)) > 0, F.get(ids, i + 1)).otherwise(F.lit(0)))


def next_positive(ids: Column, actions: Column) -> Column:
    """For each place the next later id with a positive action, else 0; one fold from the right."""
    pairs = F.reverse(F.arrays_zip(ids.alias("id"), actions.alias("action")))
    zero = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("next"))
    step = lambda a, x: F.struct(F.concat(F.array(a["next"]), a["out"]).alias("out"), F.when(x["action"] > 0, x["id"].cast("bigint")).otherwise(a["next"]).alias("next"))
    return F.aggregate(pairs, zero, step, lambda a: a["out"])


def last_place(types: Column, wanted: list[str]) -> Column:
    """1-based place of the last element among `wanted`, 0 without any."""
    back = F.array_position(F.transform(F.reverse(types), lambda t: F.coalesce(t.isin(*wanted), F.lit(False))), True)
    return F.when(back > 0, F.size(types) - back + 1).otherwise(0).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def l2_normalize(a: Column, eps: float = 1e-6) -> Column:
    size = F.greatest(norm(a), F.lit(eps))
    return F.transform(a, lambda v: v.cast("double") / size)


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def layer_norm(a: Column, eps: float = 1e-6) -> Column:
    """Centred and scaled to unit variance (population)."""
    n = F.size(a).cast("double")
    mean = F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double")) / n
    spread = F.aggregate(a, F.lit(0.0), lambda s, v: s + (v.cast("double") - mean) * (v.cast("double") - mean)) / n
    return F.transform(a, lambda v: (v.cast("double") - mean) / F.sqrt(spread + eps))


def append_at(c: Column, place: Column, value: Column) -> Column:
    """One more slot at the end, and `value` at 0-based `place`."""
    return F.transform(F.concat(c, F.array(F.lit(0).cast("bigint"))), lambda x, i: F.when(i == place, value).otherwise(x))


def entropy(p: Column, eps: float = 1e-8) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, v: s - v * F.log(v + eps))


def log_sum_exp(a: Column) -> Column:
    """Logarithm of the sum of exponentials, in stable form."""
    top = F.array_max(a)
    return top + F.log(F.aggregate(a, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def gathered(parts: list[DataFrame], column: str) -> DataFrame:
    """Batches whose arrays differ in length as one: arrays are filled with zeros to the longest of all and cut to their own length again."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    own = whole.withColumn("_n", F.size(column))
    longest = F.broadcast(own.agg(F.max("_n").alias("_longest")))  # one row
    padded = own.crossJoin(longest).withColumn(column, F.expr(f"concat(`{column}`, array_repeat(cast(0 as bigint), _longest - _n))"))
    return padded.withColumn(column, F.slice(column, F.lit(1), F.col("_n"))).drop("_n", "_longest")
