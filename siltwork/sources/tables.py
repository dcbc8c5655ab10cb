"""Tables of a data folder, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_key(column: Column | str) -> Column:
    """Form in which ids are compared: outer white space removed, lower case. Null stays null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def is_blank(column: Column | str) -> Column:
    """True for null and for texts of white space alone."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.regexp_replace(c, r"(?U)\s+", ""), F.lit("")) == ""


def current_rows(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per ``key`` with the latest ``order``: its ``columns`` as they are.

    Rows without a key are left out; a null ``order`` is earlier than any other; of rows that tie, one is kept
    (they are equal by definition of the tables). A partial maximum per map task goes before the shuffle, so a key
    with a third of all rows costs one row per task.
    """
    latest = F.coalesce(F.col(order), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz" if dict(df.dtypes)[order] == "timestamp_ntz" else "timestamp"))
    best = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(F.struct(*columns), latest).alias("_row"))
    )
    return best.select(key, *[F.col("_row")[c].alias(c) for c in columns])
