"""Running totals within groups of any size, without one task per group.

A window over a group puts the whole group into one task.  Here rows are spread over buckets by a
hash of their order key, bucket totals are accumulated per group, and the window over rows runs
within a bucket only.  Where buckets are many, their totals are accumulated in the same way.  The
order is (bucket, key): arbitrary but fixed.  Equal rows are one row with a number until the end, so
that a row which comes a million times is no group of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .scratch import Scratch

#: Rows of all groups for each bucket number, and the most bucket totals of a group in one window.
BUCKET_ROWS, WINDOW_ROWS = 512, 65_536


def running_totals(df: DataFrame, scratch: Scratch, group: str, order: list[str], value: str, out: str, bucket_rows: int = BUCKET_ROWS, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group that come before.

    ``group`` must not be null; rows that tie in all order columns must be equal rows.
    """
    times, nth = f"{out}_times", f"{out}_nth"
    each = scratch.save(df.groupBy(*df.columns).agg(F.count("*").alias(times)), f"{out}-rows")
    whole = f"{out}_whole"
    found = _totals(each.withColumn(whole, F.col(value) * F.col(times)), group, order, whole, out, bucket_rows, window_rows)
    return (found.withColumn(nth, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1)))
            .withColumn(out, (F.col(out) + F.col(nth) * F.col(value)).cast("long")).drop(times, nth, whole))


def _totals(df: DataFrame, group: str, order: list[str], value: str, out: str, bucket_rows: int, window_rows: int) -> DataFrame:
    bucket, total, start, before = (f"{out}_{x}" for x in ("bucket", "total", "start", "before"))
    buckets = max(1, -(-df.count() // bucket_rows))
    placed = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    totals = placed.groupBy(group, bucket).agg(F.sum(value).alias(total))
    if buckets <= window_rows:
        so_far = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        starts = totals.select(group, bucket, F.coalesce(F.sum(total).over(so_far), F.lit(0)).alias(start))
    else:
        starts = _totals(totals, group, [bucket], total, start, bucket_rows, window_rows).drop(total)
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (placed.withColumn(before, F.coalesce(F.sum(value).over(within), F.lit(0))).join(starts, [group, bucket])
            .withColumn(out, (F.col(start) + F.col(before)).cast("long")).drop(bucket, before, start))
