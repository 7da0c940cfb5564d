"""Joins with lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def with_lookup(df: DataFrame, lookup: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join with a lookup table that is normally small. Spark broadcasts it if its size allows that, by estimate or at run time;
    otherwise the join shuffles, and adaptive execution splits partitions of frequent keys."""
    return df.join(lookup, on, how)
