"""Queries that feed their own result until nothing changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.shared import shared_root


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = 100) -> DataFrame:
    """Applies ``step`` until the set of rows stays the same. Lineage is cut by a reliable checkpoint in every round."""
    spark = start.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    now = start.distinct().checkpoint()
    for _ in range(rounds):
        following = step(now).distinct().checkpoint()
        if following.count() == now.count() and following.exceptAll(now).isEmpty():
            return following
        now = following
    raise RuntimeError(f"no fixed point after {rounds} rounds")
