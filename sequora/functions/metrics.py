"""Ranking metrics of a 1-based rank (0: not found), and losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ndcg(rank: Column, k: int) -> Column:
    return F.when(rank.between(1, k), 1.0 / F.log2(rank + 1.0)).otherwise(0.0)


def hit_rate(rank: Column, k: int) -> Column:
    return rank.between(1, k).cast("double")


def mrr(rank: Column, floor: int | None = None) -> Column:
    """1 / rank; not found is 0, or 1 / floor if given."""
    return F.when(rank > 0, 1.0 / rank).otherwise(1.0 / floor if floor else 0.0)


def composite(overall: Column, ads: Column) -> Column:
    return 0.4 * overall + 0.6 * ads


def log_softmax_loss(positive: Column, negatives: Column, temperature: float = 0.05) -> Column:
    """-log of the positive's softmax share among itself and an array of negative logits (already masked), in stable form."""
    p = positive / temperature
    top = F.greatest(p, F.array_max(negatives))
    total = F.exp(p - top) + F.aggregate(negatives, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    return top + F.log(total) - p


def bce(logit: Column, target: Column) -> Column:
    """Binary cross entropy with logits, in stable form."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def bce_pair(positive: Column, negative: Column) -> Column:
    """Half the cross entropy of a positive logit (target 1) and a sampled negative one (target 0); the weight masks invalid negatives."""
    return (bce(positive, F.lit(1)) + bce(negative, F.lit(0))) * 0.5
