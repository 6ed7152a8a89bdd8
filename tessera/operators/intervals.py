"""Overlapping and gapped time intervals (problem 2).

Rows are first reduced to one row per entity and start day (the latest end),
with partial aggregation before the shuffle.  After that an entity has at most
one row per calendar day, however many rows it had, so its sort fits a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.norm import OPEN_DAY, day_number, day_text, end_day


def day_intervals(df: DataFrame, entity: str, start: str, end: str, end_inclusive: bool) -> DataFrame:
    """entity_id, first (day number), stop (first day after, OPEN_DAY if open).

    Rows whose entity is null, whose start is no real date, whose end is
    neither open nor a real date, or that cover no day are left out.
    """
    return df.select(
        F.col(entity).alias("entity_id"),
        day_number(start).alias("first"),
        end_day(end, end_inclusive).alias("stop"),
    ).where("entity_id is not null and first is not null and stop is not null and stop > first")


def merged_periods(intervals: DataFrame, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """Continuous periods per key: first, stop, n_starts (distinct start days merged).

    Input columns: the keys, first, stop.  Periods that touch are one.
    Repeated and nested rows change nothing; an empty table gives no rows.
    """
    days = intervals.groupBy(*keys, "first").agg(F.max("stop").alias("stop"))
    by_start = Window.partitionBy(*keys).orderBy("first")
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    labelled = days.withColumn("reach", F.max("stop").over(before)).withColumn(
        "island",
        F.sum(F.when(F.col("reach").isNull() | (F.col("first") > F.col("reach")), 1).otherwise(0)).over(
            by_start.rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    return labelled.groupBy(*keys, "island").agg(
        F.min("first").alias("first"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("n_starts")
    )


def period_gaps(periods: DataFrame, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """Gaps between consecutive periods: gap_from and gap_to, first and last uncovered day."""
    order = Window.partitionBy(*keys).orderBy("first")
    return (
        periods.withColumn("next_first", F.lead("first").over(order))
        .where("next_first is not null")
        .select(*keys, day_text("stop").alias("gap_from"), day_text(F.col("next_first") - 1).alias("gap_to"))
    )


def period_table(periods: DataFrame, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """Periods with dates as text; period_to is the last covered day, null if open."""
    return periods.select(
        *keys,
        day_text("first").alias("period_from"),
        F.when(F.col("stop") < OPEN_DAY, day_text(F.col("stop") - 1)).alias("period_to"),
        "n_starts",
    )
