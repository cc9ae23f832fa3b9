"""Join helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; keeps the left keys."""
    renamed = right.selectExpr(*[f"`{k}` as `__r_{k}`" if k in keys else f"`{k}`"
                                 for k in right.columns])
    cond = F.expr(" and ".join(f"`{k}` <=> `__r_{k}`" for k in keys))
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])
