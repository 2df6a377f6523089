"""Positions in one global order, without one task for all rows.

A window over a whole table puts it into one task.  Here rows are dealt into ranges of the order,
each range is summed up, the sums of the ranges before are added up (as many rows as there are
ranges), and the window over rows runs within a range only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..durable import Scratch


def ordered_starts(df: DataFrame, scratch: Scratch, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows that come before in ``order``.

    Rows that tie must be few: they share a range.  Callers sum equal rows up first, so none tie.
    An empty table stays empty.
    """
    part, total, start = (f"{out}_{x}" for x in ("part", "total", "start"))
    # The range of a row is written down, so that every later step reads the same ranges.
    ranged = scratch.save(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), f"{out}-ranges", release=False)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranged.groupBy(part).agg(F.sum(value).alias(total))
              .select(part, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(start)))
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0))).join(starts, part)
            .withColumn(out, (F.col(out) + F.col(start)).cast("long")).drop(part, start))


def percent_ranks(df: DataFrame, scratch: Scratch, by: str, out: str) -> DataFrame:
    """Adds ``out``: the share of the other rows whose ``by`` is smaller, as ``percent_rank`` gives it.

    Equal values are counted first, so a value that a third of all rows have is one row; one row alone
    has rank 0, and nulls come before all values, as one value.
    """
    times, before, same, key = (f"{out}_{x}" for x in ("times", "before", "same", "key"))
    values = df.groupBy(F.col(by).alias(key)).agg(F.count("*").alias(times))
    placed = ordered_starts(values, scratch, [F.asc_nulls_first(key)], times, before)
    rows = df.count()
    ranks = placed.select(F.col(key).alias(same), (F.col(before) / F.lit(max(rows - 1, 1))).alias(out))
    return df.join(ranks, df[by].eqNullSafe(ranks[same])).drop(same)
