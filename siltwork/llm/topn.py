"""Top N items within every group (problem 2).

A ``row_number`` window ordered by score and identifier with a filter on the rank: the optimiser places a group limit
before the shuffle (each map task sends at most so many rows of a group) and another after it, so a group with a third
of all rows never comes together. The window runs over the rows as they are, and keeps ``WIDER`` times N of each group,
as an item may repeat: in this order an item comes first with its best score, so the first N different items are the
ones wanted. Groups whose repeats leave fewer than N items, though they have more rows, are done again with one row per
item: an aggregate on (group, item), balanced however large a group is, then the same window.

Edge cases: rows with a null group, item or score, or a NaN score, do not count; 0.0 equals -0.0; ties go to the
greater item in byte order; groups with fewer than N items give all of them; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltwork.session import stored

#: Rows of a group looked at first, in times N.
WIDER = 3


def counted_rows(rows: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """``(_group, _item, _score)`` of the rows that count."""
    value = F.col(score).cast("double")
    value = F.when(value == 0.0, F.lit(0.0)).otherwise(value)
    # names of the caller's columns come back at the end, so they cannot clash with these
    named = rows.select(F.col(group).alias("_group"), F.col(item).alias("_item"), value.alias("_score"))
    return named.where("_group is not null and _item is not null and _score is not null and not isnan(_score)")


def _ranked(best: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("_group").orderBy(F.col("_score").desc(), F.col("_item").desc())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def first_items(counted: DataFrame, n: int, wide: int) -> DataFrame:
    """``(_group, _item, _score, rank, done)`` out of the first ``wide`` rows of each group, in one shuffle.

    ``done`` says that the group has ``n`` items among them, or no other rows.
    """
    best = _ranked(counted, wide).groupBy("_group", "_item").agg(F.max("_score").alias("_score"), F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("_group")
    done = (F.count(F.lit(1)).over(whole) >= n) | (F.sum("c").over(whole) < wide)
    return _ranked(best.withColumn("done", done), n).select("_group", "_item", "_score", "rank", "done")


def top_items(rows: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """``(group, item, score, rank)`` of the first ``n`` items of every group."""
    counted = counted_rows(rows, group, item, score)
    first = stored(first_items(counted, n, WIDER * n), "first-items")
    ranked = first.where("done").drop("done")
    again = first.where("not done").select("_group").distinct()
    if not again.isEmpty():
        best = counted.join(again, "_group", "left_semi").groupBy("_group", "_item").agg(F.max("_score").alias("_score"))
        ranked = ranked.unionByName(_ranked(best, n))
    return ranked.select(F.col("_group").alias(group), F.col("_item").alias(item), F.col("_score").alias("score"), "rank")
