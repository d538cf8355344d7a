"""Rows in a total order over the whole table, without one task that sees them all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.plans.scratch import Scratch, partitions


def in_ranges(df: DataFrame, keys: list[str]) -> DataFrame:
    """df dealt to ranges of its keys (nulls first) and sorted in each."""
    return df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)


def numbered(df: DataFrame, keys: list[str], within: list[str], scratch: Scratch, name: str, groups: DataFrame | None = None) -> DataFrame:
    """df with i, the row's number from 0 in the order of ``keys`` within equal ``within`` (the first of the keys, nulls equal), and n, how many rows these have.

    Ranges are written with each row's place; the counts of a range and group, at most one row for each of a group's
    ranges, are summed in a window and joined back by group and range, so a group of any size meets in no task.
    ``groups`` may give further columns of each group, which reach the rows by way of these counts.
    Rows with equal keys are numbered in any order; put a column last that tells them apart where that matters.
    """
    ordered = in_ranges(df, keys).withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id())
    ordered = scratch.save(ordered, name)
    runs = ordered.groupBy(*within, "_part").agg(F.count("*").alias("_c"), F.min("_pos").alias("_first"))
    group = Window.partitionBy(*within)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *(F.col(c).alias(f"_{c}") for c in within), F.col("_part").alias("_run"), "_first",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"), F.sum("_c").over(group).alias("n"),
    )
    more = []
    if groups is not None:
        more = [c for c in groups.columns if c not in within]
        given = groups.select(*(F.col(c).alias(f"_of_{c}") for c in within), *more)
        runs = runs.join(given, reduce(lambda a, b: a & b, [F.col(f"_{c}").eqNullSafe(F.col(f"_of_{c}")) for c in within]))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in within], F.col("_part") == F.col("_run"))
    return ordered.join(runs, same).select(*df.columns, (F.col("_base") + F.col("_pos") - F.col("_first")).alias("i"), "n", *more)
