"""Running sums and ranks along an order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograph.llm._common import cut, unused

PART = "_part"


def ranged(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The rows, sorted apart by group and order and written, with the number of their range in PART: a large group is several ranges."""
    dealt = df.repartitionByRange(*(F.col(g) for g in group), *order)
    return cut(dealt.withColumn(PART, F.spark_partition_id()), "ranged")


def scan(df: DataFrame, group: list[str], order: list[Column], before: dict[str, Column], whole: dict[str, Column] | None = None) -> DataFrame:
    """The rows of ranged() with the sums of integer columns over the earlier rows of their group (``before``) and over all of it (``whole``).

    Group columns must not be null.  A range of a group is summed by itself; sums of ranges are carried over to
    the later ones, so that no task sees more of a group than one range.
    """
    whole = whole or {}
    sums = {n: unused(f"_{n}", df.columns) for n in [*before, *whole]}
    parts = df.groupBy(PART, *group).agg(*(F.sum(c).alias(sums[n]) for n, c in [*before.items(), *whole.items()]))
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*group)
    carried = parts.select(
        PART,
        *group,
        *(F.coalesce(F.sum(sums[n]).over(earlier), F.lit(0)).alias(sums[n]) for n in before),
        *(F.sum(sums[n]).over(every).alias(n) for n in whole),
    )
    local = Window.partitionBy(PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = df.withColumns({n: F.coalesce(F.sum(c).over(local), F.lit(0)) for n, c in before.items()})
    return run.join(carried, [PART, *group]).withColumns({n: F.col(n) + F.col(sums[n]) for n in before}).drop(*(sums[n] for n in before))


def scan_xor(df: DataFrame, group: list[str], order: list[Column], through: dict[str, Column]) -> DataFrame:
    """As scan(), the exclusive or of a column over the rows up to and with each one."""
    sums = {n: unused(f"_{n}", df.columns) for n in through}
    parts = df.groupBy(PART, *group).agg(*(F.bit_xor(c).alias(sums[n]) for n, c in through.items()))
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(PART, *group, *(F.coalesce(F.bit_xor(sums[n]).over(earlier), F.lit(0)).alias(sums[n]) for n in through))
    local = Window.partitionBy(PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = df.withColumns({n: F.bit_xor(c).over(local) for n, c in through.items()})
    return run.join(carried, [PART, *group]).withColumns({n: F.col(n).bitwiseXOR(F.col(sums[n])) for n in through}).drop(*sums.values())
