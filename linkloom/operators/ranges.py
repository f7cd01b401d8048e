"""Order within groups that no task could sort whole: groups are cut into slices, and sums of slices place every row.

A group may hold any share of the rows. Slices are ranges of a number that rises with the order, so they are bounded by its
spacing (positions, or time at a given rate of events).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(rows: DataFrame, by: list[str], slice_of: Column, order: list[Column | str], name: str = "_rank") -> DataFrame:
    """Adds the rank, from 1, of every row in its group: rows of the slices before, and the place in its own."""
    sliced = rows.withColumn("_slice", slice_of)
    counts = sliced.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", _earlier("_n", by)).drop("_n")
    place = F.row_number().over(W.partitionBy(*by, "_slice").orderBy(*order))
    return sliced.join(before, [*by, "_slice"]).withColumn(name, F.col("_before") + place).drop("_slice", "_before")


def _earlier(amount: str, by: list[str]) -> Column:
    """The sum over a group's earlier slices, a row per slice."""
    return F.coalesce(F.sum(amount).over(W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def running_sum(rows: DataFrame, by: list[str], slice_of: Column, order: list[Column | str], amount: str, name: str) -> DataFrame:
    """Adds the sum of an amount over the rows of a group before each one."""
    sliced = rows.withColumn("_slice", slice_of)
    sums = sliced.groupBy(*by, "_slice").agg(F.sum(amount).alias("_n"))
    before = sums.withColumn("_before", _earlier("_n", by)).drop("_n")
    within = F.coalesce(F.sum(amount).over(W.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sliced.join(before, [*by, "_slice"]).withColumn(name, F.col("_before") + within).drop("_slice", "_before")


def with_carry(rows: DataFrame, slice_of: Column, late: Column) -> DataFrame:
    """Every row in its slice, and again, marked ``_carried``, in the next one where a frame of that may reach back to it (``late``)."""
    here = F.struct(slice_of.alias("_slice"), F.lit(False).alias("_carried"))
    there = F.struct((slice_of + 1).alias("_slice"), F.lit(True).alias("_carried"))
    return rows.withColumn("_s", F.explode(F.when(late, F.array(here, there)).otherwise(F.array(here)))).select(*rows.columns, "_s._slice", "_s._carried")
