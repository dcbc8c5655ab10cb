"""Places in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltwork.session import stored


def with_place(df: DataFrame, by: list[str], within: list[str] | None = None, place: str = "place") -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of ``by``, for each value of ``within`` if given.

    Rows are written in ranges of the order. A range counts its rows; the counts, at most one per range and value, are
    summed up in order; and each row is numbered within its range only. Ties must not matter, as their order is free.
    """
    group = within or []
    ranged = stored(df.repartitionByRange(*group, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    upto = (Window.partitionBy(*group) if group else Window).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    within_range = Window.partitionBy("_range", *group).orderBy(*by)
    numbered = ranged.withColumn("_i", F.row_number().over(within_range) - 1).join(offsets, ["_range", *group])
    return numbered.withColumn(place, F.col("_before") + F.col("_i")).select(*df.columns, place)
