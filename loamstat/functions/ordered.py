"""Global ranks and running extremes over one ordered column, without one big task.

Rows are range-partitioned on the value and frozen in a work table with their
range number.  Windows run inside a range; what crosses ranges (a count, a
minimum per range) is a table with one row per range, joined back by
broadcast.  Rows that are equal in the order share a range, so ties are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstat.functions.work import materialize


def ranged(df: DataFrame, *order: Column, parts: int | None = None) -> DataFrame:
    """``df`` range-partitioned by ``order`` and frozen, with its range in ``__range``."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranged")


def _before(frozen: DataFrame, total: Column, name: str) -> DataFrame:
    """One row per range with the sum over the ranges before it."""
    over = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return frozen.groupBy("__range").agg(total.alias("__t")).select("__range", F.coalesce(F.sum("__t").over(over), F.lit(0)).alias(name))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """Adds the 1-based rank in ``order`` (row_number semantics) over all rows."""
    frozen = ranged(df, *order, parts=parts)  # rows that tie in the first column may lie in several ranges
    before = _before(frozen, F.count(F.lit(1)), "__before")
    local = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    out = frozen.withColumn("__local", local).join(F.broadcast(before), "__range")
    return out.withColumn(name, F.col("__local") + F.col("__before")).drop("__local", "__before", "__range")


def suffix_min(ranked: DataFrame, order: Column, value: Column, name: str, parts: int | None = None) -> DataFrame:
    """Adds the minimum of ``value`` over all rows at or behind a row in ``order``.

    Rows that tie in ``order`` share the result.
    """
    frozen = ranged(ranked.withColumn("__v", value), order, parts=parts)
    over = Window.orderBy("__range").rowsBetween(1, Window.unboundedFollowing)
    after = frozen.groupBy("__range").agg(F.min("__v").alias("__t")).select("__range", F.min("__t").over(over).alias("__after"))
    local = F.min("__v").over(Window.partitionBy("__range").orderBy(order.desc()).rangeBetween(Window.unboundedPreceding, 0))
    out = frozen.withColumn("__local", local).join(F.broadcast(after), "__range")
    return out.withColumn(name, F.least("__local", "__after")).drop("__v", "__local", "__after", "__range")


def cumulative_count(df: DataFrame, order: Column, flag: Column, name: str, parts: int | None = None) -> DataFrame:
    """Adds how many rows with ``flag`` lie at or before a row in ``order`` (ties included)."""
    frozen = ranged(df.withColumn("__f", flag.cast("long")), order, parts=parts)
    before = _before(frozen, F.sum("__f"), "__before")
    local = F.sum("__f").over(Window.partitionBy("__range").orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    out = frozen.withColumn("__local", local).join(F.broadcast(before), "__range")
    return out.withColumn(name, F.col("__local") + F.col("__before")).drop("__f", "__local", "__before", "__range")


def mid_ranks(df: DataFrame, by: str, value: str) -> DataFrame:
    """``(by, value, mid, n)``: the average rank of each distinct value in its group, and the group's rows.

    Equal values are counted before they are ranged, so neither a group nor a value is one task's.
    """
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("__n"))
    frozen = ranged(counts, F.col(by), F.col(value))
    over = Window.partitionBy("__range").orderBy(by, value).rowsBetween(Window.unboundedPreceding, 0)
    upto = frozen.withColumn("__u", F.sum("__n").over(over)).join(F.broadcast(_before(frozen, F.sum("__n"), "__b")), "__range")
    upto = upto.select(F.col(by), F.col(value), "__n", (F.col("__u") + F.col("__b")).alias("__u"))
    # as a work table its size is known, so few groups are broadcast and no value is dealt by its group
    groups = materialize(upto.groupBy(F.col(by).alias("__by")).agg(F.min(F.col("__u") - F.col("__n")).alias("__start"), F.sum("__n").alias("n")), "groups")
    mid = F.col("__u") - F.col("__start") - (F.col("__n") - 1) / 2
    return upto.join(groups, F.col(by).eqNullSafe(F.col("__by"))).select(by, value, mid.alias("mid"), "n")
