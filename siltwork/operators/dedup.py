"""First and last row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, key: Column, order: Column, last: bool = False, as_key: str | None = None) -> DataFrame:
    """One whole row per ``key``: the first by ``order``, or the last. Rows with a null key are dropped.

    A partial minimum per map task goes before the shuffle, so a key with many rows costs one row a task. With
    ``as_key`` the key itself takes the place of that column; what is grouped by it next needs no shuffle.
    """
    best = (F.max_by if last else F.min_by)(F.struct(*df.columns), order)
    kept = df.where(key.isNotNull()).groupBy(key.alias("_key")).agg(best.alias("_row"))
    if as_key is None:
        return kept.select("_row.*")
    return kept.select(F.col("_key").alias(as_key), *[F.col("_row")[c].alias(c) for c in df.columns if c != as_key])
