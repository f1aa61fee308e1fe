"""Reports of ranking metrics, weighted losses and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequora.functions import metrics as M


def metric_columns(rank: Column, k: int, floor: int | None = None) -> list[Column]:
    return [F.avg(M.ndcg(rank, k)).alias("ndcg"), F.avg(M.hit_rate(rank, k)).alias("hr"), F.avg(M.mrr(rank, floor)).alias("mrr"), F.count(F.lit(1)).alias("n")]


def by_group(records: DataFrame, group: str, rank: str, k: int = 10) -> DataFrame:
    """Mean metrics of each group and overall, in one pass over the records."""
    report = records.groupingSets([[group], []], group).agg(*metric_columns(F.col(rank), k), F.grouping(group).alias("_all"))
    return report.withColumn(group, F.when(F.col("_all") == 1, "Overall").otherwise(F.col(group))).drop("_all")


def by_type_and_group(records: DataFrame, kind: str, group: str, rank: str, k: int = 10, floor: int | None = None) -> DataFrame:
    """Overall, each type and each group in one report: (scope, name, metrics)."""
    report = records.groupingSets([[], [kind], [group]], kind, group).agg(*metric_columns(F.col(rank), k, floor), F.grouping(kind).alias("_k"), F.grouping(group).alias("_g"))
    scope = F.when(F.col("_k") == 0, "type").when(F.col("_g") == 0, "group").otherwise("overall")
    name = F.when(F.col("_k") == 0, F.col(kind)).when(F.col("_g") == 0, F.col(group)).otherwise("Overall")
    return report.select(scope.alias("scope"), name.alias("name"), "ndcg", "hr", "mrr", "n")


def masked(records: DataFrame, rank: str, mask: Column, k: int = 10) -> DataFrame:
    """Metrics over the rows of a mask only."""
    return records.agg(*(F.avg(F.when(mask, f)).alias(n) for n, f in (("ndcg", M.ndcg(F.col(rank), k)), ("hr", M.hit_rate(F.col(rank), k)), ("mrr", M.mrr(F.col(rank))))), F.count_if(mask).alias("n"))


def weighted_mean(df: DataFrame, value: Column, weight: Column, name: str) -> DataFrame:
    return df.agg((F.sum(value * weight) / F.sum(weight)).alias(name))


def domain_weights(label: Column, weights: dict[int, float], domain: Column, only: list[int] | None = None) -> Column:
    """Supervision weight of a label: 0 for padding, its domain's weight or 1, 0 outside `only`."""
    out = F.lit(1.0)
    for d, w in weights.items():
        out = F.when(domain == d, out * w).otherwise(out)
    if only is not None:
        out = F.when(domain.isin(*only), out).otherwise(0.0)
    return F.when(label != 0, out).otherwise(0.0)


def load_balance(gates: DataFrame, expert: str, p: str, chosen: str) -> DataFrame:
    """experts * sum over experts of (share of rows routed there) * (mean gate)."""
    each = gates.groupBy(expert).agg(F.avg(F.col(chosen).cast("double")).alias("f"), F.avg(p).alias("m"))
    return each.agg((F.count("*") * F.sum(F.col("f") * F.col("m"))).alias("load_balance"))
