"""Joins back to a key that may be null, and joins row by row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def join_rows(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with a side of as many rows on the row id; neither side is sent to the driver.

    Spark takes the compressed size of a stage table, scaled by the width of the columns read, as the size of a side. That promises
    too little: some columns of millions of rows look small enough to broadcast.
    """
    return left.join(right.hint("merge"), "source_row_id", how)


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on equal keys, where null equals null; the keys come from ``left``."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (left[k].eqNullSafe(other[f"_right_{k}"]) for k in keys))
    return left.join(other, same, how).drop(*[f"_right_{k}" for k in keys])
