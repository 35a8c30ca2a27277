"""Joins of solution sets on shared variables (D-1, D-3, D-4, D-6).

Solution sets are DataFrames with one column per variable, so the shared
variables of two of them are simply their common column names.  No join
strategy is forced: Spark picks broadcast when its size estimate (or AQE's
runtime measurement) is under the threshold, sort-merge otherwise, and AQE
splits skewed join partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def shared_variables(left: DataFrame, right: DataFrame) -> list[str]:
    """D-6: the variables bound on both sides, in the left side's order."""
    right_cols = set(right.columns)
    return [c for c in left.columns if c in right_cols]


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """D-1: inner join on *all* shared variables, each kept once."""
    on = shared_variables(left, right)
    if not on:
        raise ValueError("the two sides share no variable; refusing a cross product")
    return left.join(right, on=on, how="inner")


def semijoin(left: DataFrame, right: DataFrame) -> DataFrame:
    """D-3 / D-4: rows of ``left`` with a partner in ``right`` on all shared variables.

    Only the distinct keys of ``right`` matter; deduplicating them map-side
    means a key repeated across a third of ``right`` reaches the join as one
    row per task (AQE can split a skewed semi-join only on its left side).
    """
    on = shared_variables(left, right)
    if not on:
        raise ValueError("the two sides share no variable")
    return left.join(right.select(*on).distinct(), on=on, how="left_semi")
