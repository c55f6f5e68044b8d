"""Two-class scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from padron.lookups import TOXIC_THRESHOLD


def softmax_positive(negative: Column, positive: Column) -> Column:
    """Probability of the second class, stable for large logits."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(negative - positive))


def argmax_label(negative: Column, positive: Column) -> Column:
    """0 on a tie, as the first of equal maxima."""
    return F.when(positive > negative, F.lit(1)).otherwise(F.lit(0))


def over_threshold(score: Column, threshold: float = TOXIC_THRESHOLD) -> Column:
    return F.coalesce(score >= F.lit(threshold), F.lit(False))
