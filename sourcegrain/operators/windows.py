"""Operators over ordered rows: islands, gaps, first and last occurrences, bounded frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k).drop("_place")


def with_islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers maximal stretches of rows from 0; `breaks` may use lag columns made before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def previous(col: str, keys: list[str], order: list[str]) -> Column:
    return F.lag(col).over(Window.partitionBy(*keys).orderBy(*order))


def following(col: str, keys: list[str], order: list[str]) -> Column:
    return F.lead(col).over(Window.partitionBy(*keys).orderBy(*order))


def count_ahead(flag: Column, keys: list[str], order: list[str], reach: int) -> Column:
    """How many of the next `reach` rows have the flag."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, reach)
    return F.coalesce(F.sum(F.when(flag, 1).otherwise(0)).over(w), F.lit(0))


def numbering_gaps(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """A row for each stretch of numbers missing between two present ones, and for each step back or
    repetition when numbers are read in ascending order of `ord` if there is one."""
    order = ["ord"] if "ord" in df.columns else [number]
    step = df.withColumn("next_number", following(number, keys, order))
    gap = step.where(F.col("next_number") != F.col(number) + 1)
    kind = F.when(F.col("next_number") > F.col(number) + 1, "missing").otherwise("out_of_order")
    return gap.select(*keys, kind.alias("kind"), (F.col(number) + 1).alias("first_missing"), (F.col("next_number") - 1).alias("last_missing"))
