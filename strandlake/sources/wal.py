"""Write-ahead entries: what was begun and not committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def pending(entries: DataFrame, commits: DataFrame, key: str = "seq") -> DataFrame:
    return entries.join(commits.select(key).distinct(), key, "left_anti")


def cleared(entries: DataFrame, upto: int, key: str = "seq") -> DataFrame:
    """What stays after the log was cleared up to a number."""
    return entries.filter(F.col(key) > upto)
